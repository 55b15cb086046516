"""Queries over routing examples and search: anchors, ranks, distractors, top-k, line scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callmetrics.functions import similarity, stats, text
from callmetrics.operators import search
from callmetrics.operators import tool_features as tf
from callmetrics.plans.tools import FEAT, SOURCE
from callmetrics.plans.views import ABSTAIN, TOOLS, read, tools


def examples(spark, d):
    return read(spark, d, "routing_examples").withColumn("split", F.trim(F.lower("split")))


def d7_anchors(spark, d):
    """The anchor of each example: its correct tool if known, else its target; examples without either are dropped."""
    known = tools(spark, d).select("tool_id")
    r = examples(spark, d)
    by = lambda c: known.select(F.col("tool_id").alias(c), F.col("tool_id").alias(f"{c}_known"))
    j = r.join(by("correct_tool_id"), "correct_tool_id", "left").join(by("target_tool_id"), "target_tool_id", "left")
    return j.select("id", F.coalesce("correct_tool_id_known", "target_tool_id_known").alias("anchor")).where("anchor IS NOT NULL")


def d12_tool_mentions(spark, d):
    """Examples by tool that is their correct or their target one: two equi-joins and a distinct instead of an OR."""
    r, t = examples(spark, d), tools(spark, d).select("tool_id")
    either = r.select("id", F.col("correct_tool_id").alias("tool_id")).union(r.select("id", "target_tool_id")).distinct()
    return either.join(t, "tool_id").groupBy("tool_id").agg(F.count(F.lit(1)).alias("examples"))


def f12_gold_rank(spark, d):
    rank = F.nullif(F.array_position("candidate_tool_ids", F.col("correct_tool_id")), F.lit(0))
    return examples(spark, d).select("id", rank.alias("gold_rank"), F.coalesce(rank <= 3, F.lit(False)).alias("hit_at_3"))


def e4_routing_summary(spark, d):
    """By level, by split and in all: hit rate and mean gold rank (examples whose gold isn't among the candidates skipped)."""
    r = examples(spark, d).withColumn("rank", F.nullif(F.array_position("candidate_tool_ids", F.col("correct_tool_id")), F.lit(0)))
    r = r.withColumns({"split": F.coalesce("split", F.lit("unknown")), "gold": F.col("correct_tool_id") != ABSTAIN})
    return r.groupingSets([[F.col("distractor_level")], [F.col("split")], []], "distractor_level", "split").agg(
        F.count(F.lit(1)).alias("examples"), F.count_if("gold").alias("positives"), stats.mean(F.coalesce(F.col("rank") <= 3, F.lit(False))).alias("hit_at_3"),
        F.round(F.avg("rank") + stats.TIE, 4).alias("avg_gold_rank"), stats.mean(F.col("candidate_set_size")).alias("avg_candidates"), F.grouping_id("distractor_level", "split").alias("grain"),
    )


def e24_distractors(spark, d):
    """Mean name similarity of candidates with their anchor, by level: candidates exploded, both sides joined on ids."""
    names = tools(spark, d, "tool_name").select("tool_id", F.array_distinct(text.distractor_tokens(F.col("tool_name"))).alias("w"))
    c = examples(spark, d).join(d7_anchors(spark, d), "id").select("id", "distractor_level", "anchor", "correct_tool_id", "target_tool_id", F.explode("candidate_tool_ids").alias("tool_id"))
    c = c.where("tool_id <> correct_tool_id AND tool_id <> target_tool_id")
    j = c.join(names, "tool_id").join(names.select(F.col("tool_id").alias("anchor"), F.col("w").alias("aw")), "anchor")
    return j.groupBy("distractor_level").agg(F.count(F.lit(1)).alias("candidates"), stats.mean(F.round(similarity.jaccard(F.col("w"), F.col("aw")), 4)).alias("avg_name_similarity"))


#: Pairs of verbs that oppose one another.
OPPOSITE = (("read", "write"), ("search", "fetch"), ("create", "update"), ("create", "delete"), ("list", "create"), ("get", "set"))


def opposed(a, b, ea, eb):
    """Whether two tools' words hold opposite verbs, or one reads and the other changes things."""
    out = ((ea == "read") & eb.isin(*tf.MUTATING)) | ((eb == "read") & ea.isin(*tf.MUTATING))
    for x, y in OPPOSITE:
        out = out | (F.array_contains(a, x) & F.array_contains(b, y)) | (F.array_contains(a, y) & F.array_contains(b, x))
    return out


def hard_scores(spark, d):
    """Relation and score of each candidate with its example's anchor: names, texts, arguments, domain, effect, opposite verbs."""
    t = tf.features(tools(spark, d, *SOURCE))
    tokens = lambda *c: F.array_distinct(text.distractor_tokens(F.concat_ws(" ", *c)))
    f = t.select("tool_id", F.struct(
        tokens("tool_name").alias("name"), tokens("tool_name", "tool_purpose").alias("text"), F.coalesce(F.array_distinct("arguments.name"), F.array().cast("array<string>")).alias("args"),
        F.coalesce(F.lower("domain"), F.lit("")).alias("domain"), F.col("side_effect_type").alias("effect"),
    ).alias("f"))
    c = examples(spark, d).join(d7_anchors(spark, d), "id").select("id", "distractor_level", "anchor", "correct_tool_id", "target_tool_id", F.explode("candidate_tool_ids").alias("tool_id"))
    c = c.where("tool_id <> correct_tool_id AND tool_id <> target_tool_id").join(f.withColumnRenamed("f", "b"), "tool_id").join(f.select(F.col("tool_id").alias("anchor"), F.col("f").alias("a")), "anchor")
    sim = lambda k: similarity.jaccard(F.col(f"a.{k}"), F.col(f"b.{k}"))
    same = lambda k: F.col(f"a.{k}") == F.col(f"b.{k}")
    c = c.select("id", "tool_id", "distractor_level", sim("name").alias("n"), sim("text").alias("t"), sim("args").alias("g"), same("domain").alias("d"), same("effect").alias("e"), opposed(F.col("a.text"), F.col("b.text"), F.col("a.effect"), F.col("b.effect")).alias("o"))
    score = 3 * F.col("n") + 2 * F.col("t") + 2 * F.col("g") + F.col("d").cast("double") + 0.5 * F.col("e").cast("double") + 1.5 * F.col("o").cast("double")
    near = (F.col("n") >= 0.35) | (F.col("g") >= 0.35) | (F.col("d") & (F.col("t") >= 0.25))
    relation = F.when(F.col("o"), "opposite_action").when(near, "near_miss").when(F.col("d"), "same_domain").otherwise("different_domain")
    return c.select("id", "tool_id", "distractor_level", relation.alias("relation"), F.col("d").alias("same_domain"), score.alias("score"))


def m3_hard_scores(spark, d):
    """Candidates by level and relation with their anchor, and the mean score."""
    return hard_scores(spark, d).groupBy("distractor_level", "relation").agg(F.count(F.lit(1)).alias("candidates"), stats.mean(F.col("score")).alias("avg_hard_score"))


def jitter():
    """A number for ties that depends on nothing but the ids."""
    return F.md5(F.concat_ws("|", F.lit("17"), "id", "tool_id"))


def f8_jittered(spark, d):
    """The three candidates of each example of the highest score, ties in an order made by hashes."""
    s = hard_scores(spark, d).distinct().withColumn("score", F.round(F.col("score") + stats.TIE, 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), jitter(), "tool_id"))).where("rank <= 3").select("id", "tool_id", "score", "rank")


def f10_levels(spark, d):
    """Three distractors of each level for each example out of its candidates: those the level is for first, then others by score.

    Easy: of another domain, in hashed order; medium: of the same domain and no near miss; hard: of any score above 0; adversarial:
    near misses and opposite actions.
    """
    s = hard_scores(spark, d).distinct().withColumn("score", F.round(F.col("score") + stats.TIE, 6))
    fits = {"easy": ~F.col("same_domain"), "medium": F.col("same_domain") & (F.col("relation") != "near_miss"), "hard": F.col("score") > 0, "adversarial": F.col("relation").isin("near_miss", "opposite_action")}
    s = s.select("id", "tool_id", "score", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("fits")) for k, c in fits.items()])).alias("l")).select("id", "tool_id", "score", "l.*")
    by_score = F.when((F.col("level") == "easy") & F.col("fits"), 0.0).otherwise(F.col("score"))
    w = Window.partitionBy("id", "level").orderBy(F.desc("fits"), by_score.desc(), jitter(), "tool_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id", "level", "tool_id", (~F.col("fits")).alias("fallback"), "rank")


def f10_distractors(spark, d):
    """Three tools of the same domain for each tool, fewer only if the domain has fewer, in an order made by hashes.

    Tools of a domain stand in 256 hashed rows; a tool's distractors are the next ones in its row, and at the row's end the
    heads of the domain's other rows and then of its own, as if the rows were one ring. So no domain is gathered in one task
    and no pairs of a domain are made: three heads a row, at most 768 a domain, are brought together.
    """
    t = tools(spark, d, "domain").withColumns({"domain": F.coalesce(F.nullif(text.normalized_request(F.col("domain")), F.lit("")), F.lit("general")), "k": F.md5(F.concat(F.lit("9|"), "tool_id"))})
    t = t.withColumn("row", F.substring("k", 1, 2))
    w = Window.partitionBy("domain", "row").orderBy("k")
    near = F.array_compact(F.array(*[F.lead("tool_id", i).over(w) for i in (1, 2, 3)]))
    t = t.withColumns({"near": near, "i": F.row_number().over(w)})
    heads = t.where("i <= 3").groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("row", "i", "tool_id"))).alias("h"))
    rows = heads.select("domain", "h", F.explode(F.array_distinct("h.row")).alias("row"))
    part = lambda test: F.filter("h", test)["tool_id"]
    others = F.slice(F.concat(part(lambda x: x["row"] > F.col("row")), part(lambda x: x["row"] < F.col("row"))), 1, 3)
    rows = rows.select("domain", "row", F.concat(others, part(lambda x: x["row"] == F.col("row"))).alias("next"))
    ring = F.slice(F.array_distinct(F.array_remove(F.concat("near", "next"), F.col("tool_id"))), 1, 3)
    return t.join(rows, ["domain", "row"]).select("tool_id", F.posexplode(ring).alias("rank", "distractor"))


def f7_search(spark, d):
    """The three tools of each held-out item with the highest lexical score over their purposes and snippets."""
    t = tools(spark, d, "tool_purpose", "doc_snippets").select(F.col("tool_id").alias("id"), F.concat_ws(" ", "tool_purpose", F.array_join("doc_snippets", " ")).alias("text"))
    q = read(spark, d, "heldout_items").select(F.col("item_id").alias("id"), "text")
    return search.top_k(t, q).select(F.col("query_id").alias("item_id"), F.col("id").alias("tool_id"), "score", "rank")


def error_lines(spark, d):
    """Lines that report an error number, and whether a rejection or refusal stands within two lines of them.

    The window of five lines is taken within the row, over the list of its lines: nothing is shuffled.
    """
    marks = F.transform(F.split("text", "\n"), lambda x: F.struct(x.rlike("error [0-9]+").alias("hit"), F.lower(x).rlike("reject|refus").alias("near")))
    lines = tf.once(read(spark, d, "documents").select("doc_id", marks.alias("m")))
    around = lambda x, i: F.struct(x["hit"].alias("hit"), F.exists(F.slice("m", F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.lit(5))), lambda y: y["near"]).alias("near"))
    found = tf.once(lines.select("doc_id", F.filter(F.transform("m", around), lambda x: x["hit"]).alias("f")))
    return found.where(F.size("f") > 0).select("doc_id", F.size("f").cast("long").alias("errors"), F.size(F.filter("f", lambda x: x["near"])).cast("long").alias("with_marker"))


def n29_progress(spark, d):
    """Of the plan (each example at each model), the part done: distinct keys of records that are in the plan, and those that aren't."""
    p = read(spark, d, "predictions").select("task_id", "model_slug").distinct()
    plan = examples(spark, d).select(F.col("source_control_id").alias("task_id")).distinct()
    done = p.join(plan.withColumn("planned", F.lit(True)), "task_id", "left")
    return done.groupBy("model_slug").agg(F.count("planned").alias("completed"), F.count_if(F.col("planned").isNull()).alias("ignored"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "defkmn" and k[1:2].isdigit()} | {"x_error_lines": error_lines}

M = lambda x: f"round(coalesce(avg(CAST({x} AS DOUBLE)), 0) + 1e-9::DOUBLE, 4)"
W = f"WITH {TOOLS}"
DIST = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda x: length(x) > 1))"
ANCHORS = f"{W}, an AS (SELECT id, coalesce(c.tool_id, t.tool_id) AS anchor FROM routing_examples r LEFT JOIN tl c ON c.tool_id = r.correct_tool_id LEFT JOIN tl t ON t.tool_id = r.target_tool_id WHERE coalesce(c.tool_id, t.tool_id) IS NOT NULL)"
TERMS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9_./*?-]+')"
PAIRED = "list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))"
LJ = lambda k: f"CASE WHEN len(list_distinct(list_concat(a.{k}, b.{k}))) = 0 THEN 0 ELSE len(list_intersect(a.{k}, b.{k}))::DOUBLE / len(list_distinct(list_concat(a.{k}, b.{k}))) END"
OPPOSED = "((a.effect = 'read' AND b.effect IN ('write', 'delete', 'execute', 'external_communication')) OR (b.effect = 'read' AND a.effect IN ('write', 'delete', 'execute', 'external_communication')) OR " + " OR ".join(f"(list_contains(a.text, '{x}') AND list_contains(b.text, '{y}')) OR (list_contains(a.text, '{y}') AND list_contains(b.text, '{x}'))" for x, y in OPPOSITE) + ")"
HARD = f"""{FEAT}, an AS (SELECT id, coalesce(c.tool_id, t.tool_id) AS anchor FROM routing_examples r LEFT JOIN tl c ON c.tool_id = r.correct_tool_id LEFT JOIN tl t ON t.tool_id = r.target_tool_id WHERE coalesce(c.tool_id, t.tool_id) IS NOT NULL),
  fx AS (SELECT tool_id, {DIST('tool_name')} AS name, {DIST("concat_ws(' ', tool_name, tool_purpose)")} AS text, coalesce(list_distinct(list_transform(arguments, lambda a: a.name)), []) AS args, coalesce(lower(domain), '') AS domain, side_effect_type AS effect FROM ft),
  c AS (SELECT id, distractor_level, correct_tool_id, target_tool_id, unnest(candidate_tool_ids) AS tool_id FROM routing_examples),
  p AS (SELECT c.id, c.tool_id, distractor_level, {LJ('name')} AS n, {LJ('text')} AS t, {LJ('args')} AS g, a.domain = b.domain AS d, a.effect = b.effect AS e, {OPPOSED} AS o FROM c JOIN an USING (id) JOIN fx a ON a.tool_id = anchor JOIN fx b ON b.tool_id = c.tool_id WHERE c.tool_id <> correct_tool_id AND c.tool_id <> target_tool_id),
  h AS (SELECT id, tool_id, distractor_level, d, CASE WHEN o THEN 'opposite_action' WHEN n >= 0.35 OR g >= 0.35 OR (d AND t >= 0.25) THEN 'near_miss' WHEN d THEN 'same_domain' ELSE 'different_domain' END AS relation, 3 * n + 2 * t + 2 * g + d::INT + 0.5::DOUBLE * e::INT + 1.5::DOUBLE * o::INT AS score FROM p)"""
JITTER = "j AS (SELECT DISTINCT id, tool_id, d, relation, round(score + 1e-9::DOUBLE, 6) AS score, md5('17|' || id || '|' || tool_id) AS k FROM h)"
SQL = {
    "m3_hard_scores": f"{HARD} SELECT distractor_level, relation, count(*) AS candidates, {M('score')} AS avg_hard_score FROM h GROUP BY 1, 2",
    "f8_jittered": f"{HARD}, {JITTER} SELECT id, tool_id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k, tool_id) AS r FROM j) WHERE r <= 3",
    "f10_levels": f"""{HARD}, {JITTER}, l AS (SELECT *, 'easy' AS level, NOT d AS fits FROM j UNION ALL SELECT *, 'medium', d AND relation <> 'near_miss' FROM j UNION ALL SELECT *, 'hard', score > 0 FROM j UNION ALL SELECT *, 'adversarial', relation IN ('near_miss', 'opposite_action') FROM j)
      SELECT id, level, tool_id, NOT fits AS fallback, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, level ORDER BY fits DESC, CASE WHEN level = 'easy' AND fits THEN 0 ELSE score END DESC, k, tool_id) AS r FROM l) WHERE r <= 3""",
    "d7_anchors": f"{ANCHORS} SELECT id, anchor FROM an",
    "d12_tool_mentions": f"{W} SELECT tl.tool_id, count(*) AS examples FROM tl JOIN routing_examples r ON tl.tool_id = r.correct_tool_id OR tl.tool_id = r.target_tool_id GROUP BY 1",
    "f12_gold_rank": "SELECT id, nullif(list_position(candidate_tool_ids, correct_tool_id), 0) AS gold_rank, coalesce(nullif(list_position(candidate_tool_ids, correct_tool_id), 0) <= 3, false) AS hit_at_3 FROM routing_examples",
    "e4_routing_summary": f"""WITH r AS (SELECT distractor_level, candidate_set_size, coalesce(trim(lower(split)), 'unknown') AS split, correct_tool_id <> '__abstain__' AS gold, nullif(list_position(candidate_tool_ids, correct_tool_id), 0) AS rank FROM routing_examples)
      SELECT distractor_level, split, count(*) AS examples, count_if(gold) AS positives, {M('coalesce(rank <= 3, false)')} AS hit_at_3, round(avg(rank) + 1e-9::DOUBLE, 4) AS avg_gold_rank, {M('candidate_set_size')} AS avg_candidates, grouping(distractor_level, split) AS grain
      FROM r GROUP BY GROUPING SETS ((distractor_level), (split), ())""",
    "e24_distractors": f"""{ANCHORS}, nm AS (SELECT tool_id, {DIST('tool_name')} AS w FROM tl), c AS (SELECT id, distractor_level, correct_tool_id, target_tool_id, unnest(candidate_tool_ids) AS tool_id FROM routing_examples),
      j AS (SELECT distractor_level, CASE WHEN len(list_distinct(list_concat(n.w, m.w))) = 0 THEN 0 ELSE round(len(list_intersect(n.w, m.w))::DOUBLE / len(list_distinct(list_concat(n.w, m.w))), 4) END AS s
        FROM c JOIN an USING (id) JOIN nm n ON n.tool_id = c.tool_id JOIN nm m ON m.tool_id = an.anchor WHERE c.tool_id <> correct_tool_id AND c.tool_id <> target_tool_id)
      SELECT distractor_level, count(*) AS candidates, {M('s')} AS avg_name_similarity FROM j GROUP BY 1""",
    "f10_distractors": f"""{W}, t AS (SELECT tool_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(domain, '')), '\\s+', ' ', 'g')), ''), 'general') AS domain, md5('9|' || tool_id) AS k FROM tl),
      n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY domain) AS c FROM t)
      SELECT a.tool_id, CAST(r AS INT) AS rank, b.tool_id AS distractor FROM n a, range(3) x(r), n b WHERE a.domain = b.domain AND b.i = (a.i + r + 1) % a.c AND r + 1 < a.c""",
    "f7_search": f"""{W}, d AS (SELECT tool_id, unnest({PAIRED}) AS w FROM (SELECT tool_id, {TERMS("concat_ws(' ', tool_purpose, array_to_string(list_filter(doc_snippets, lambda x: x IS NOT NULL), ' '))")} AS t FROM tl)),
      q AS (SELECT item_id, unnest({PAIRED}) AS w FROM (SELECT item_id, {TERMS('text')} AS t FROM heldout_items)),
      s AS (SELECT item_id, tool_id, CAST(sum(CASE WHEN contains(w, ' ') THEN 4 ELSE 2 END) AS BIGINT) AS score FROM d JOIN q USING (w) GROUP BY 1, 2)
      SELECT item_id, tool_id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tool_id) AS r FROM s) WHERE r <= 3""",
    "x_error_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
      n AS (SELECT *, max(regexp_matches(lower(t), 'reject|refus')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
      SELECT doc_id, count(*) AS errors, CAST(sum(near) AS BIGINT) AS with_marker FROM n WHERE regexp_matches(t, 'error [0-9]+') GROUP BY 1""",
    "n29_progress": "WITH p AS (SELECT DISTINCT task_id, model_slug FROM predictions) SELECT model_slug, count_if(task_id IN (SELECT source_control_id FROM routing_examples)) AS completed, count_if(NOT coalesce(task_id IN (SELECT source_control_id FROM routing_examples), false)) AS ignored FROM p GROUP BY 1",
}
