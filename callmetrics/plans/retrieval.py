"""Queries that score requests against candidate tools and their texts, and the tokenizers they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions import stats, text
from callmetrics.operators import learners
from callmetrics.operators import requests as rq
from callmetrics.operators import routing as ro
from callmetrics.operators import tool_features as tf
from callmetrics.plans.views import TASKS, TOOLS, read, tasks, tools

NONE = "array<string>"
TOKENIZERS = {
    "h3_memory_tokens": text.memory_tokens, "h4_boundary_tokens": text.boundary_tokens, "h5_doc_tokens": text.doc_tokens, "h6_behavior_tokens": lambda t: F.array_distinct(text.behavior_tokens(t)), "h7_semantic_tokens": text.semantic_tokens,
    "h8_bigrams": lambda t: F.array_distinct(text.bigrams(text.retrieval_tokens(t))),
}


def tokenized(name):
    def query(spark, d):
        df = tasks(spark, d, "user_request").select("task_id", F.array_sort(TOKENIZERS[name](F.col("user_request"))).alias("t"))
        return df.select("task_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", "|")).alias("digest"))

    query.__doc__ = "Number of distinct tokens of each request, and a digest of them in order."
    return query


def h10_name_variants(spark, d):
    return tools(spark, d, "tool_name").where("tool_name IS NOT NULL").select("tool_id", F.array_join(text.name_variants(F.col("tool_name")), "|").alias("variants"))


def h12_directories(spark, d):
    """Directory names of tools: of the typed domain and the name."""
    return tools(spark, d, "tool_name", "domain").select("tool_id", text.safe_directory(F.concat_ws("/", "domain", "tool_name"), 50).alias("directory"))


def h13_lines(spark, d):
    """Snippets of each tool: distinct ones, the first three, and the first one cut to twelve words."""
    t = tools(spark, d, "doc_snippets").where("doc_snippets IS NOT NULL").select("tool_id", text.distinct_lines(F.filter("doc_snippets", lambda x: x.isNotNull())).alias("lines"))
    return t.select("tool_id", F.size("lines").alias("lines"), F.md5(F.array_join(F.slice("lines", 1, 3), "|")).alias("first_three"), text.trimmed_words(F.try_element_at("lines", F.lit(1)), 12).alias("short"))


def candidates(spark, d) -> DataFrame:
    """A row for each example and candidate tool: id, task_id, tool_id."""
    return read(spark, d, "routing_examples").select("id", F.col("source_control_id").alias("task_id"), F.explode("candidate_tool_ids").alias("tool_id")).distinct()


def pairs(spark, d, asked: dict, offered: dict, *columns: str) -> DataFrame:
    """Candidates with what the scores need of request (``asked``) and tool (``offered``), made once a row before the joins.

    The pairs are those of the candidate lists: requests and tools are joined on their keys, never all with all.
    """
    q = tasks(spark, d, "user_request").select("task_id", *[c.alias(n) for n, c in asked.items()])
    t = tools(spark, d, "tool_name", *columns).select("tool_id", *[c.alias(n) for n, c in offered.items()])
    return candidates(spark, d).join(q, "task_id").join(t, "tool_id")


SEARCHED = ("tool_purpose", "doc_snippets", "usage_warnings", "arguments")


def sides(spark, d, *fields: str) -> DataFrame:
    """Pairs with those fields of the request (``q``) and of the tool's text (``t``)."""
    return pairs(spark, d, {"q": ro.request_side(F.col("user_request"), *fields)}, {"t": ro.text_side(ro.search_text(), *[f for f in fields if f != "plain"]), "name": F.col("tool_name"), "args": F.col("arguments.name")}, *SEARCHED)


def m5_overlap(spark, d):
    """Lexical overlap of each request with each of its candidates."""
    return sides(spark, d, *ro.OVERLAP).select("id", "tool_id", ro.overlap(F.col("q"), F.col("t")).alias("score"))


def m6_router_overlap(spark, d):
    return sides(spark, d, "low", "tokens").select("id", "tool_id", ro.router_overlap(F.col("q"), F.col("t")).alias("score"))


def m7_boundary_penalty(spark, d):
    """Twice the tokens a request shares with a candidate's warnings, at most eight."""
    lines = F.coalesce(F.array_distinct(F.flatten(F.transform("usage_warnings", text.boundary_tokens))), F.array().cast(NONE))
    p = pairs(spark, d, {"q": text.boundary_tokens(F.col("user_request"))}, {"w": lines}, "usage_warnings")
    return p.select("id", "tool_id", F.least(F.lit(8), 2 * ro.common(F.col("q"), F.col("w"))).alias("penalty"))


def m8_intent_bonus(spark, d):
    p = pairs(spark, d, {"low": F.lower(F.coalesce("user_request", F.lit("")))}, {"name": F.coalesce("tool_name", F.lit("")), "args": F.col("arguments.name")}, "arguments")
    return p.select("id", "tool_id", ro.intent_bonus(F.col("low"), F.col("name"), F.col("args")).alias("bonus")).where("bonus <> 0")


def m9_mentions(spark, d):
    p = pairs(spark, d, {"plain": text.routing_text(F.col("user_request"))}, {"name": F.col("tool_name")})
    return p.select("id", "tool_id", ro.mention_adjustment(F.col("plain"), F.coalesce("name", F.lit(""))).alias("adjustment"))


def ranked(df: DataFrame, by: list[str], score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the highest score by ``by``; the group limit is pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))).where(F.col("rank") <= k)


def d9_candidate_ranking(spark, d):
    """The three best candidates of each example: overlap, intent bonus and mentions; ties by name, then id."""
    q, name = F.col("q"), F.coalesce("name", F.lit(""))
    total = ro.overlap(q, F.col("t")) + ro.intent_bonus(q["low"], name, F.col("args")) + ro.mention_adjustment(q["plain"], name)
    return ranked(sides(spark, d, *ro.OVERLAP, "plain").select("id", "tool_id", name.alias("name"), total.alias("score")), ["id"], "score", 3, "name", "tool_id").select("id", "tool_id", "score", "rank")


def documents_of(spark, d) -> DataFrame:
    """The texts of each tool in order: purpose, snippets, warnings, arguments with their descriptions."""
    part = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast(NONE))
    texts = F.concat(F.array("tool_purpose"), part("doc_snippets", lambda x: x), part("usage_warnings", lambda x: x), part("arguments", lambda a: F.when(a["description"] != "", F.concat(a["name"], F.lit(": "), a["description"]))))
    return tools(spark, d, *SEARCHED).select("tool_id", F.posexplode(texts).alias("place", "text")).where("text <> ''")


def d10_doc_ranking(spark, d):
    """Of each example's candidates: the summed scores of their texts that score at all, and the best text (the first of equal ones)."""
    q = tasks(spark, d, "user_request").select("task_id", ro.request_side(F.col("user_request"), *ro.OVERLAP).alias("q"))
    t = documents_of(spark, d).select("tool_id", "place", F.md5("text").alias("text"), ro.text_side(F.col("text"), *ro.OVERLAP).alias("t"))
    s = candidates(spark, d).join(q, "task_id").join(t, "tool_id").select("id", "tool_id", "place", "text", ro.overlap(F.col("q"), F.col("t")).alias("score")).where("score > 0")
    best = s.groupBy("id", "tool_id").agg(F.sum("score").alias("score"), F.max("score").alias("best_score"), F.max_by("text", F.struct("score", -F.col("place"))).alias("best_text"))
    return ranked(best, ["id"], "score", 3, "tool_id")


def acted(spark, d, *more: str) -> DataFrame:
    """Pairs with memory tokens and families of actions of both sides."""
    r = F.coalesce("user_request", F.lit(""))
    said = F.lower(F.concat_ws(" ", F.coalesce("tool_name", F.lit("")), F.coalesce("tool_purpose", F.lit(""))))
    about = F.concat_ws(" ", F.regexp_replace(F.coalesce("tool_name", F.lit("")), "_", " "), F.coalesce("tool_purpose", F.lit("")), F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(said.contains(m), label) for m, label in tf.HINTS]))), " "))
    asked = {"low": F.lower(r), "plain": text.routing_text(r), "memory": text.memory_tokens(r), "actions": ro.families(text.memory_tokens(r), F.lower(r))}
    argued = F.concat_ws(" ", F.coalesce(F.flatten(F.transform("arguments", lambda a: F.array(F.regexp_replace(a["name"], "_", " "), a["description"]))), F.array().cast(NONE)))
    offered = {
        "name": F.coalesce("tool_name", F.lit("")), "name_tokens": text.memory_tokens(F.regexp_replace(F.coalesce("tool_name", F.lit("")), "_", " ")), "purpose_tokens": text.memory_tokens(F.coalesce("tool_purpose", F.lit(""))),
        "argument_tokens": text.memory_tokens(argued), "tool_actions": ro.families(text.memory_tokens(about), F.lower(about)),
    }
    return pairs(spark, d, asked, offered, "tool_purpose", "arguments", *more)


def c21_conflicts(spark, d):
    """Candidates whose families of actions conflict with the request's, or that change things a request wants only looked at."""
    p = acted(spark, d).select("id", "tool_id", ro.conflict(F.col("actions"), F.col("tool_actions")).alias("action_conflict"), ro.read_write_conflict(F.col("low"), F.col("tool_actions")).alias("read_write_conflict"))
    return p.groupBy("action_conflict", "read_write_conflict").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("id").alias("examples"))


#: Weights of the features.
WEIGHTS = {
    "bias": -0.5, "explicit_tool_request": 5.0, "tool_name_overlap": 2.5, "purpose_overlap": 2.0, "argument_overlap": 1.2, "action_family_overlap": 2.0, "action_family_conflict": -4.8, "negative_marker": -4.0, "no_tool_marker": -5.5,
    "missing_info_marker": -3.5, "read_write_conflict": -5.5,
}
#: What of the features is a risk.
RISKS = {"action_family_conflict": 1.5, "read_write_conflict": 1.5, "negative_marker": 1.0, "no_tool_marker": 1.0, "missing_info_marker": 0.8}


def feature_columns() -> dict:
    one = lambda c: c.cast("double")
    return {
        "bias": F.lit(1.0), "explicit_tool_request": one(rq.selects(F.col("plain"), F.col("name"))), "tool_name_overlap": ro.normalized_overlap(F.col("memory"), F.col("name_tokens")), "purpose_overlap": ro.normalized_overlap(F.col("memory"), F.col("purpose_tokens")),
        "argument_overlap": ro.normalized_overlap(F.col("memory"), F.col("argument_tokens")), "action_family_overlap": one(ro.common(F.col("actions"), F.col("tool_actions"))), "action_family_conflict": one(ro.conflict(F.col("actions"), F.col("tool_actions"))),
        **{k: one(rq.any_of(F.col("low"), m)) for k, m in ro.MARKERS.items()}, "read_write_conflict": one(ro.read_write_conflict(F.col("low"), F.col("tool_actions"))),
    }


def i16_features(spark, d) -> DataFrame:
    """Features of each request and candidate, their weighted sum, and its risk."""
    p = acted(spark, d).select("id", "tool_id", *[c.alias(k) for k, c in feature_columns().items()])
    raw = sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    risk = F.greatest(F.lit(0.0), sum((F.lit(w) * F.col(k) for k, w in RISKS.items()), F.lit(0.0)) - F.greatest(raw, F.lit(0.0)) * 0.1)
    return p.select("id", "tool_id", *[F.round(F.col(k), 6).alias(k) for k in feature_columns() if k != "bias"], F.round(raw, 6).alias("raw_score"), F.round(risk, 6).alias("risk"))


def n9_thresholds(spark, d):
    """Thresholds of a router from the means of right and wrong candidates' scores: half their distance within [0, 10], a tenth of it as the margin."""
    gold = read(spark, d, "routing_examples").select("id", "correct_tool_id")
    s = i16_features(spark, d).join(gold, "id").withColumn("gold", F.col("tool_id") == F.col("correct_tool_id"))
    g = s.agg(F.avg(F.when(F.col("gold"), F.col("raw_score"))).alias("right"), F.avg(F.when(~F.col("gold"), F.col("raw_score"))).alias("wrong"))
    far = F.col("right") - F.col("wrong")
    return g.select(F.round("right", 4).alias("mean_right"), F.round("wrong", 4).alias("mean_wrong"), F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), far * 0.5)), 4).alias("threshold"), F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.1), far * 0.1)), 4).alias("margin"))


def training_rows(spark, d) -> DataFrame:
    """(tool_id, id, label, features in order): at most ``learners.MOST_ROWS`` rows a tool and ``MOST_ALL`` in all, by hash."""
    gold = read(spark, d, "routing_examples").select("id", "correct_tool_id")
    names = list(feature_columns())
    f = i16_features(spark, d).withColumn("bias", F.lit(1.0)).join(gold, "id")
    return f.select("tool_id", "id", F.when(F.col("tool_id") == F.col("correct_tool_id"), 1.0).otherwise(-1.0).alias("label"), F.array(*names).alias("x"), F.md5(F.concat_ws("|", "tool_id", "id")).alias("k"))


def i13_router_weights(spark, d):
    """Weights of a margin perceptron over a bounded sample of candidates, in order of their hashes: start, trained, and trained again on what it got wrong."""
    return learners.global_policy(training_rows(spark, d), WEIGHTS)


def i15_tool_policies(spark, d):
    """The same for each tool that has a right and a wrong row, over at most ``learners.MOST_ROWS`` rows a tool."""
    return learners.tool_policies(training_rows(spark, d), WEIGHTS)


def m11_overlaps(spark, d):
    """Mean normalised overlaps of the right candidate and of the others."""
    gold = read(spark, d, "routing_examples").select("id", "correct_tool_id")
    p = acted(spark, d).join(gold, "id").select((F.col("tool_id") == F.col("correct_tool_id")).alias("gold"), *[ro.normalized_overlap(F.col("memory"), F.col(f"{k}_tokens")).alias(k) for k in ("name", "purpose", "argument")])
    return p.groupBy("gold").agg(F.count(F.lit(1)).alias("pairs"), *[stats.mean(F.col(k)).alias(k) for k in ("name", "purpose", "argument")])


def f26_hard_negatives(spark, d):
    """Of each example's wrong candidates the five that share most with the request: tokens in common, one more for a conflict of actions."""
    gold = read(spark, d, "routing_examples").select("id", "correct_tool_id")
    signature = F.array_union(F.array_union("name_tokens", "purpose_tokens"), F.col("argument_tokens"))
    p = acted(spark, d).join(gold, "id").where("tool_id <> correct_tool_id")
    p = p.select("id", "tool_id", "name", (ro.common(F.col("memory"), signature) + ro.conflict(F.col("actions"), F.col("tool_actions")).cast("int")).alias("score")).where("score > 0")
    return ranked(p, ["id"], "score", 5, "name", "tool_id").select("id", "tool_id", "score", "rank")


def c19_triggers(spark, d):
    """Whether the skill of each candidate would be used for the request: its name or an argument's stands there, or two words are shared, and no boundary says otherwise."""
    trigger = F.concat_ws(" ", F.regexp_replace(F.coalesce("tool_name", F.lit("")), "_", " "), F.coalesce("tool_purpose", F.lit("")), F.coalesce(F.flatten(F.transform("arguments", lambda a: F.array(F.regexp_replace(a["name"], "_", " "), a["description"]))), F.array().cast(NONE)))
    low = F.lower(F.coalesce("user_request", F.lit("")))
    bounded = F.coalesce(F.transform(F.filter("usage_warnings", lambda w: F.lower(w).rlike("adjacent|do not use")), lambda w: F.array_distinct(text.behavior_tokens(w))), F.array().cast("array<array<string>>"))
    p = pairs(spark, d, {"low": low, "q": F.array_distinct(text.behavior_tokens(F.col("user_request")))}, {"name": F.lower(F.coalesce("tool_name", F.lit(""))), "args": F.coalesce(F.transform("arguments", lambda a: F.lower(a["name"])), F.array().cast(NONE)), "trigger": F.array_distinct(text.behavior_tokens(trigger)), "bounds": bounded}, "tool_purpose", "arguments", "usage_warnings")
    named = F.col("low").contains(F.col("name")) | F.exists("args", lambda a: F.col("low").contains(a))
    stopped = F.exists("bounds", lambda b: ro.common(F.col("q"), b) >= 4)
    out = (F.size("q") > 0) & ~stopped & (F.coalesce(named, F.lit(False)) | (ro.common(F.col("q"), F.col("trigger")) >= 2))
    return p.select("id", "tool_id", out.alias("triggers"))


#: Prototypes a tool has at most of each kind, and the weights of negative categories.
PROTOTYPES = {True: 8, False: 12}
CATEGORY_WEIGHTS = {"out_of_domain_request": 0.75, "similar_tool_should_be_used": 1.25, "near_miss_intent": 1.25, "destructive_vs_readonly_mismatch": 1.25}
LEFT_OUT = ("unrelated", "related", "target", "distractor")


def prototypes(spark, d) -> DataFrame:
    """The first requests of each tool and kind that have tokens, as (tool_id, positive, proto_id, tokens, weight)."""
    t = tools(spark, d, "tool_name", "tool_purpose").select("tool_id", text.memory_tokens(F.concat_ws(" ", F.regexp_replace(F.coalesce("tool_name", F.lit("")), "_", " "), F.coalesce("tool_purpose", F.lit("")))).alias("signature"))
    e = tasks(spark, d, "tool_id", "user_request", "should_trigger", "negative_category").where("tool_id IS NOT NULL").join(t, "tool_id")
    positive, own = F.coalesce("should_trigger", F.lit(True)), text.memory_tokens(F.col("user_request"))
    tokens = F.array_sort(F.when(positive, own).otherwise(F.array_except(F.array_except(own, F.col("signature")), F.array(*map(F.lit, LEFT_OUT)))))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv]), F.col("negative_category")), F.lit(1.0))
    e = e.select("tool_id", positive.alias("positive"), F.col("task_id").alias("proto_id"), F.slice(tokens, 1, 48).alias("tokens"), weight.alias("weight")).where("size(tokens) > 0")
    most = F.when(F.col("positive"), PROTOTYPES[True]).otherwise(PROTOTYPES[False])
    first = e.withColumn("part", F.pmod(F.hash("proto_id"), F.lit(16))).withColumn("k", F.row_number().over(Window.partitionBy("tool_id", "positive", "part").orderBy("proto_id"))).where(F.col("k") <= most)
    return first.withColumn("k", F.row_number().over(Window.partitionBy("tool_id", "positive").orderBy("proto_id"))).where(F.col("k") <= most).select("tool_id", "positive", "proto_id", "tokens", "weight")


def m10_prototypes(spark, d):
    """Of each candidate the best positive and negative prototype for the request (ties: the first), and whether the negative one wins clearly."""
    q = tasks(spark, d, "user_request").select("task_id", text.memory_tokens(F.col("user_request")).alias("q"))
    s = candidates(spark, d).join(q, "task_id").join(prototypes(spark, d), "tool_id").withColumn("score", ro.prototype_score(F.col("q"), F.col("tokens"), F.col("weight")))
    best = s.groupBy("id", "tool_id").agg(F.coalesce(F.max(F.when(F.col("positive"), F.col("score"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(~F.col("positive"), F.col("score"))), F.lit(0.0)).alias("n"))
    return best.select("id", "tool_id", F.round("p", 4).alias("positive_score"), F.round("n", 4).alias("negative_score"), ((F.col("p") - F.col("n") <= -6) & (F.col("n") >= F.col("p") + 4)).alias("negative_boundary"))


def n23_distinctive_terms(spark, d):
    """The first four words of each example's right tool that none of the other candidates has: of four letters or more, not numbers."""
    t = tools(spark, d, *SEARCHED, "tool_name").select("tool_id", text.retrieval_tokens(ro.search_text()).alias("w"))
    c = read(spark, d, "routing_examples").select("id", "correct_tool_id", F.explode("candidate_tool_ids").alias("tool_id")).distinct().where("tool_id <> correct_tool_id").join(t.select("tool_id", F.array_distinct("w").alias("w")), "tool_id")
    others = c.groupBy("id", "correct_tool_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("others"))
    own = others.join(t.select(F.col("tool_id").alias("correct_tool_id"), F.filter(F.array_distinct("w"), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$")).alias("w")), "correct_tool_id")
    return own.select("id", F.array_join(F.slice(F.array_except("w", "others"), 1, 4), "|").alias("terms"))


def n12_close_calls(spark, d):
    """Examples whose two best candidates score within one point of each other."""
    r = d9_candidate_ranking(spark, d).where("rank <= 2").groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return r.where("second IS NOT NULL AND first - second <= 1").select("id", "first", "second")


QUERIES = {k: tokenized(k) for k in TOKENIZERS} | {k: f for k, f in globals().items() if callable(f) and k[0] in "cdfhimn" and k[1:2].isdigit()}

LOW = lambda x: f"lower(coalesce({x}, ''))"
ROUTE = lambda x: f"trim(regexp_replace(regexp_replace({LOW(x)}, '[_./:-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
STOPS = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
RETR = lambda x: f"regexp_extract_all({LOW(x)}, '[a-z0-9_./*?-]+')"
PARTS = lambda tokens, gaps: f"flatten(list_transform({tokens}, lambda t: list_concat([t], regexp_split_to_array(t, '{gaps}'))))"
VARY = lambda tokens, *cases: f"list_distinct(flatten(list_transform({tokens}, lambda t: list_filter([t, {', '.join(cases)}], lambda z: z IS NOT NULL))))"
S_, ING, ED = "ends_with(t, 's') AND length(t) > 4", "ends_with(t, 'ing') AND length(t) > 5", "ends_with(t, 'ed') AND length(t) > 4"
CUTS = lambda cond, n, more="": f"CASE WHEN {cond} THEN left(t, length(t) - {n}){more} END"
KEPT = f"lambda t: length(t) > 1 AND t NOT IN {STOPS(text.MEMORY_STOP)}"
MEM = lambda x: VARY(f"list_filter({PARTS(f'''list_filter(list_transform(regexp_extract_all({LOW(x)}, '[a-z0-9_./-]+'), lambda t: trim(t, '.')), {KEPT})''', '[_./-]+')}, {KEPT})", CUTS(S_, 1), CUTS(ING, 3))
BOUND = lambda x: VARY(f"list_filter({PARTS(RETR(x), '[-_/.]+')}, lambda t: length(t) > 2 AND t NOT IN {STOPS(text.BOUNDARY_STOP)})", CUTS(ING, 3), CUTS(ING, 3, " || 'e'"), CUTS(ED, 2), CUTS(ED, 1), CUTS(S_, 1))
GROUPS = "MAP {" + ", ".join(f"'{w}': {LIST(g)}" for g in text.ALIAS_GROUPS for w in g) + "}"
STEM = lambda tokens: f"list_distinct(flatten(list_transform(list_transform(list_filter(list_transform({tokens}, lambda t: trim(t, '._-/*?')), lambda t: length(t) > 1), lambda t: CASE WHEN {ING} THEN left(t, length(t) - 3) WHEN {ED} THEN left(t, length(t) - 2) WHEN {S_} THEN left(t, length(t) - 1) ELSE t END), lambda t: list_concat([t], coalesce({GROUPS}[t], [])))))"
SEM = lambda x: STEM(PARTS(RETR(x), "[-_./*?]+"))
DOC = lambda x: STEM(PARTS(f"regexp_extract_all({LOW(x)}, '[a-z0-9_./-]+')", "[-_./]+"))
BEH = lambda x: f"list_distinct(list_filter(list_transform({RETR(x)}, lambda t: trim(t, '.,;:!?')), lambda t: length(t) > 1 AND t NOT IN {STOPS(text.BEHAVIOR_STOP)}))"
BIG = lambda x: f"(SELECT list_distinct(list_transform(range(1, len(z)), lambda i: z[i] || ' ' || z[i + 1])) FROM (SELECT {RETR(x)} AS z))"
WORDS_OF = {"h3_memory_tokens": MEM, "h4_boundary_tokens": BOUND, "h5_doc_tokens": DOC, "h6_behavior_tokens": BEH, "h7_semantic_tokens": SEM, "h8_bigrams": BIG}
ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, '" + w.replace("'", "''") + "')" for w in words) + ")"
BOTH = lambda a, b: f"len(list_intersect({a}, {b}))"
ST = "list_filter(list_concat([tool_name, tool_purpose], coalesce(doc_snippets, []), coalesce(usage_warnings, []), coalesce(flatten(list_transform(arguments, lambda a: [a.name, a.description])), [])), lambda x: x <> '')"
SIDE = lambda x: f"{LOW(x)} AS low, list_distinct({RETR(x)}) AS tokens, {BIG(x)} AS pairs, {SEM(x)} AS meant"
BASE = f"""WITH {TOOLS}, {TASKS}, ca AS (SELECT DISTINCT id, source_control_id AS task_id, unnest(candidate_tool_ids) AS tool_id FROM routing_examples),
q AS (SELECT task_id, {SIDE('user_request')}, {ROUTE('user_request')} AS tx, coalesce(user_request, '') AS user_request FROM ev)"""
FOUND = f"""{BASE}, t AS (SELECT tool_id, coalesce(tool_name, '') AS name, coalesce(list_transform(arguments, lambda a: a.name), []) AS args, {ROUTE('tool_name')} AS nm, {SIDE('st')} FROM (SELECT *, array_to_string({ST}, ' ') AS st FROM tl)),
p AS (SELECT id, tool_id, q.low AS ql, t.low AS tlow, q.tokens AS qt, t.tokens AS tt, q.pairs AS qp, t.pairs AS tp, q.meant AS qm, t.meant AS tm, tx, nm, name, args FROM ca JOIN q USING (task_id) JOIN t USING (tool_id))"""
OVERLAP = f"2 * {BOTH('qt', 'tt')} + len(list_filter(list_intersect(qm, tm), lambda x: NOT (list_contains(qt, x) AND list_contains(tt, x)))) + 4 * {BOTH('qp', 'tp')} + CASE WHEN contains(tlow, ql) THEN 6 ELSE 0 END"
BONUS = " + ".join(f"CASE WHEN list_has_any(args, {LIST(a)}) AND {ANY('ql', c)} THEN {b} ELSE 0 END" for a, c, b in ro.CUES) + f""" + CASE WHEN len(list_distinct(args)) = 1 AND list_contains(args, 'path') AND contains(name, 'create') AND (({ANY('ql', ro.MAKING)} AND {ANY('ql', ro.PLACES)}) OR (contains(ql, 'make sure') AND {ANY('ql', ro.EXISTING)})) THEN 8 ELSE 0 END
  + CASE WHEN len(list_distinct(args)) = 1 AND list_contains(args, 'path') AND contains(name, 'list') AND {ANY('ql', ro.LISTING)} THEN 8 ELSE 0 END"""


def mention_sql() -> str:
    from callmetrics.plans.tasks import FORBIDS, SELECTS

    return f"CASE WHEN {FORBIDS} THEN -80 ELSE 0 END + CASE WHEN {SELECTS} THEN 18 ELSE 0 END"


FAMILY = lambda mem, low: "list_filter([" + ", ".join(f"CASE WHEN list_has_any({mem}, {LIST(ts)}) OR {ANY(f'''(' ' || {low} || ' ')''', [f' {x} ' for x in ts])} THEN '{f}' END" for f, ts in ro.ACTIONS.items()) + "], lambda z: z IS NOT NULL)"
HINTED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(said, '{m}')''' for m, y in tf.HINTS if y == x)} THEN '{x}' END" for x in dict.fromkeys(y for _, y in tf.HINTS)) + "], lambda z: z IS NOT NULL), ' ')"
ARGUED = "array_to_string(list_filter(coalesce(flatten(list_transform(arguments, lambda a: [replace(a.name, '_', ' '), a.description])), []), lambda z: z IS NOT NULL), ' ')"
NO = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {BOTH(a, b)} / sqrt(len({b})) END"
ACTED = f"""{BASE}, t0 AS (SELECT tool_id, coalesce(tool_name, '') AS name, {ROUTE('tool_name')} AS nm, coalesce(tool_purpose, '') AS purpose, replace(coalesce(tool_name, ''), '_', ' ') AS spaced, {ARGUED} AS argued, lower(coalesce(tool_name, '') || ' ' || coalesce(tool_purpose, '')) AS said FROM tl),
t1 AS (SELECT *, spaced || ' ' || purpose || ' ' || {HINTED} AS about FROM t0), t2 AS (SELECT tool_id, name, nm, {MEM('spaced')} AS nt, {MEM('purpose')} AS pt, {MEM('argued')} AS gt, {MEM('about')} AS am, lower(about) AS al FROM t1),
t AS (SELECT *, {FAMILY('am', 'al')} AS ta FROM t2), qq AS (SELECT *, {MEM('user_request')} AS m FROM q), qa AS (SELECT task_id, tx, low, m, {FAMILY('m', 'low')} AS ra FROM qq),
p AS (SELECT ca.id, tool_id, name, nm, tx, low, m, nt, pt, gt, ra, ta, len(ra) > 0 AND len(ta) > 0 AND NOT list_has_any(ra, ta) AS ac, {ANY('low', ro.READ_ONLY)} AND list_has_any(ta, {LIST(ro.WRITING)}) AS rw FROM ca JOIN qa USING (task_id) JOIN t USING (tool_id))"""


def acted_sql() -> str:
    from callmetrics.plans.tasks import SELECTS

    cols = {"explicit_tool_request": f"{SELECTS}::INT", "tool_name_overlap": NO("m", "nt"), "purpose_overlap": NO("m", "pt"), "argument_overlap": NO("m", "gt"), "action_family_overlap": BOTH("ra", "ta"), "action_family_conflict": "ac::INT",
            **{k: f"{ANY('low', w)}::INT" for k, w in ro.MARKERS.items()}, "read_write_conflict": "rw::INT"}
    raw = " + ".join([f"{WEIGHTS['bias']}::DOUBLE", *[f"({WEIGHTS[k]}::DOUBLE) * {k}" for k in cols]])
    risk = " + ".join(f"{w}::DOUBLE * {k}" for k, w in RISKS.items())
    return f"{ACTED}, f AS (SELECT id, tool_id, {', '.join(f'({c})::DOUBLE AS {k}' for k, c in cols.items())} FROM p), g AS (SELECT *, {raw} AS raw FROM f) SELECT id, tool_id, {', '.join(f'round({k}, 6) AS {k}' for k in cols)}, round(raw, 6) AS raw_score, round(greatest(0, {risk} - greatest(raw, 0) * 0.1::DOUBLE), 6) AS risk FROM g"


TOP = lambda cte, ties, k: f"SELECT * EXCLUDE (r), CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, {ties}) AS r FROM ({cte})) WHERE r <= {k}"
RANKING = f"{FOUND} SELECT id, tool_id, score, rank FROM ({TOP(f'SELECT id, tool_id, name, {OVERLAP} + {BONUS} + {mention_sql()} AS score FROM p', 'name, tool_id', 3)})"
PROTO = f"""{BASE}, sg AS (SELECT tool_id, {MEM("replace(coalesce(tool_name, ''), '_', ' ') || ' ' || coalesce(tool_purpose, '')")} AS s FROM tl),
pe AS (SELECT ev.tool_id, coalesce(should_trigger, true) AS pos, task_id, CASE negative_category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_WEIGHTS.items())} ELSE 1 END AS w, {MEM('user_request')} AS m, s FROM ev JOIN sg ON sg.tool_id = ev.tool_id),
pf AS (SELECT tool_id, pos, task_id, w, list_sort(CASE WHEN pos THEN m ELSE list_filter(m, lambda x: NOT list_contains(s, x) AND x NOT IN {STOPS(LEFT_OUT)}) END)[1:48] AS tk FROM pe),
po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool_id, pos ORDER BY task_id) AS k FROM pf WHERE len(tk) > 0) WHERE k <= CASE WHEN pos THEN {PROTOTYPES[True]} ELSE {PROTOTYPES[False]} END)"""
SQL = {k: f"WITH {TASKS}, x AS (SELECT task_id, list_sort({f('user_request')}) AS t FROM ev) SELECT task_id, len(t) AS tokens, md5(array_to_string(t, '|')) AS digest FROM x" for k, f in WORDS_OF.items()} | {
    "h10_name_variants": f"WITH {TOOLS} SELECT tool_id, array_to_string(list_sort(list_filter(list_distinct([{ROUTE('tool_name')}, {ROUTE('''replace(tool_name, '_', ' ')''')}, {ROUTE('''replace(tool_name, '-', ' ')''')}, {ROUTE('''replace(tool_name, '.', ' ')''')}]), lambda x: x <> '')), '|') AS variants FROM tl WHERE tool_name IS NOT NULL",
    "h12_directories": f"WITH {TOOLS} SELECT tool_id, left(regexp_replace(concat_ws('/', domain, tool_name), '[^A-Za-z0-9._-]+', '_', 'g'), 50) AS directory FROM tl",
    "h13_lines": rf"""WITH {TOOLS}, x AS (SELECT tool_id, list_filter(list_transform(list_filter(doc_snippets, lambda s: s IS NOT NULL), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM tl WHERE doc_snippets IS NOT NULL),
      y AS (SELECT tool_id, list_filter(l, lambda s, i: list_position(l, s) = i) AS l FROM x), z AS (SELECT tool_id, l, string_split(l[1], ' ') AS w FROM y)
      SELECT tool_id, len(l) AS lines, md5(array_to_string(l[1:3], '|')) AS first_three, CASE WHEN l[1] IS NULL THEN '' WHEN len(w) <= 12 THEN l[1] ELSE regexp_replace(array_to_string(w[1:12], ' '), '[.,]+$', '') || '.' END AS short FROM z""",
    "m5_overlap": f"{FOUND} SELECT id, tool_id, {OVERLAP} AS score FROM p",
    "m6_router_overlap": f"{FOUND} SELECT id, tool_id, 2 * {BOTH('qt', 'tt')} + CASE WHEN contains(tlow, ql) THEN 5 ELSE 0 END AS score FROM p",
    "m7_boundary_penalty": f"{BASE}, qb AS (SELECT task_id, {BOUND('user_request')} AS b FROM q), wb AS (SELECT tool_id, coalesce(list_distinct(flatten(list_transform(usage_warnings, lambda x: {BOUND('x')}))), []) AS w FROM tl) SELECT id, tool_id, least(8, 2 * {BOTH('b', 'w')}) AS penalty FROM ca JOIN qb USING (task_id) JOIN wb USING (tool_id)",
    "m8_intent_bonus": f"{FOUND} SELECT id, tool_id, {BONUS} AS bonus FROM p WHERE {BONUS} <> 0",
    "m9_mentions": f"{FOUND} SELECT id, tool_id, {mention_sql()} AS adjustment FROM p",
    "d9_candidate_ranking": RANKING,
    "n12_close_calls": f"WITH r AS ({RANKING}) SELECT a.id, a.score AS first, b.score AS second FROM r a JOIN r b USING (id) WHERE a.rank = 1 AND b.rank = 2 AND a.score - b.score <= 1",
    "d10_doc_ranking": f"""{BASE}, dx AS (SELECT tool_id, unnest(list_concat([tool_purpose], coalesce(doc_snippets, []), coalesce(usage_warnings, []), coalesce(list_transform(arguments, lambda a: CASE WHEN a.description <> '' THEN a.name || ': ' || a.description END), []))) AS x,
      unnest(range(1 + coalesce(len(doc_snippets), 0) + coalesce(len(usage_warnings), 0) + coalesce(len(arguments), 0))) AS place FROM tl), t AS (SELECT tool_id, place, x, {SIDE('x')} FROM dx WHERE x <> ''),
      p AS (SELECT id, tool_id, place, x, q.low AS ql, t.low AS tlow, q.tokens AS qt, t.tokens AS tt, q.pairs AS qp, t.pairs AS tp, q.meant AS qm, t.meant AS tm FROM ca JOIN q USING (task_id) JOIN t USING (tool_id)), s AS (SELECT id, tool_id, place, x, {OVERLAP} AS score FROM p),
      b AS (SELECT id, tool_id, CAST(sum(score) AS BIGINT) AS score, max(score) AS best_score, md5(arg_max(x, (score, -place))) AS best_text FROM s WHERE score > 0 GROUP BY 1, 2) {TOP('SELECT * FROM b', 'tool_id', 3)}""",
    "c21_conflicts": f"{ACTED} SELECT ac AS action_conflict, rw AS read_write_conflict, count(*) AS pairs, count(DISTINCT id) AS examples FROM p GROUP BY 1, 2",
    "i16_features": acted_sql(),
    "n9_thresholds": f"WITH f AS ({acted_sql()}), g AS (SELECT avg(raw_score) FILTER (tool_id = correct_tool_id) AS r, avg(raw_score) FILTER (tool_id <> correct_tool_id) AS w FROM f JOIN routing_examples USING (id)) SELECT round(r, 4) AS mean_right, round(w, 4) AS mean_wrong, round(least(10, greatest(0, (r - w) * 0.5::DOUBLE)), 4) AS threshold, round(least(2, greatest(0.1::DOUBLE, (r - w) * 0.1::DOUBLE)), 4) AS margin FROM g",
    "m11_overlaps": f"{ACTED} SELECT tool_id = correct_tool_id AS gold, count(*) AS pairs, " + ", ".join(f"round(coalesce(avg(({NO('m', c)})::DOUBLE), 0) + 1e-9::DOUBLE, 4) AS {k}" for k, c in (("name", "nt"), ("purpose", "pt"), ("argument", "gt"))) + " FROM p JOIN routing_examples USING (id) GROUP BY 1",
    "f26_hard_negatives": f"{ACTED} SELECT id, tool_id, score, rank FROM ({TOP(f'SELECT p.id, tool_id, name, {BOTH("m", "list_concat(nt, pt, gt)")} + ac::INT AS score FROM p JOIN routing_examples r USING (id) WHERE tool_id <> correct_tool_id AND {BOTH("m", "list_concat(nt, pt, gt)")} + ac::INT > 0', 'name, tool_id', 5)})",
    "c19_triggers": f"""{BASE}, qb AS (SELECT task_id, low, {BEH('user_request')} AS b FROM q), t AS (SELECT tool_id, {LOW('tool_name')} AS name, coalesce(list_transform(arguments, lambda a: lower(a.name)), []) AS args, {BEH(f"replace(coalesce(tool_name, ''), '_', ' ') || ' ' || coalesce(tool_purpose, '') || ' ' || {ARGUED}")} AS g,
      coalesce(list_transform(list_filter(usage_warnings, lambda w: regexp_matches(lower(w), 'adjacent|do not use')), lambda w: {BEH('w')}), []) AS bs FROM tl)
      SELECT id, tool_id, len(b) > 0 AND len(list_filter(bs, lambda x: {BOTH('b', 'x')} >= 4)) = 0 AND (contains(low, name) OR len(list_filter(args, lambda a: contains(low, a))) > 0 OR {BOTH('b', 'g')} >= 2) AS triggers FROM ca JOIN qb USING (task_id) JOIN t USING (tool_id)""",
    "m10_prototypes": f"""{PROTO}, qm AS (SELECT task_id, {MEM('user_request')} AS m FROM q), s AS (SELECT ca.id, ca.tool_id, pos, CASE WHEN {BOTH('m', 'tk')} = 0 THEN 0 ELSE w::DOUBLE * (2 * {BOTH('m', 'tk')} + {BOTH('m', 'tk')} / sqrt(len(tk))) END AS sc FROM ca JOIN qm USING (task_id) JOIN po ON po.tool_id = ca.tool_id),
      b AS (SELECT id, tool_id, coalesce(max(sc) FILTER (pos), 0) AS p, coalesce(max(sc) FILTER (NOT pos), 0) AS n FROM s GROUP BY 1, 2) SELECT id, tool_id, round(p, 4) AS positive_score, round(n, 4) AS negative_score, p - n <= -6 AND n >= p + 4 AS negative_boundary FROM b""",
    "n23_distinctive_terms": f"""{BASE}, t AS (SELECT tool_id, {RETR(f"array_to_string({ST}, ' ')")} AS w FROM tl), c AS (SELECT DISTINCT id, correct_tool_id, unnest(candidate_tool_ids) AS tool_id FROM routing_examples), o AS (SELECT id, correct_tool_id, flatten(list(w)) AS others FROM c JOIN t USING (tool_id) WHERE tool_id <> correct_tool_id GROUP BY 1, 2)
      SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains(others, x))[1:4], '|') AS terms FROM o JOIN t ON t.tool_id = correct_tool_id""",
}
