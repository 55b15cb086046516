"""Queries over labelled requests: sampling, set operations, audits, predicates, generation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.operators import requests as rq
from callmetrics.operators import validation
from callmetrics.plans.views import ABSTAIN, TASKS, TOOLS, read, tasks, tools

SPLIT = "trim(lower(split))"


def requests(spark, d):
    t = tasks(spark, d, "tool_id", "tool_name", "user_request", "split", "source", "should_trigger", "negative_category", "difficulty")
    return t.withColumns({"split": F.expr(SPLIT), "request": text.normalized_request(F.col("user_request")), "should_trigger": F.coalesce("should_trigger", F.lit(True)), "difficulty": F.lower("difficulty")})


def is_train():
    return F.col("split").startswith("train")


def g3_shared_requests(spark, d):
    """Requests, normalised, that stand in the training split and in another."""
    r = requests(spark, d).where("request <> ''")
    return r.where(is_train()).select("request").intersect(r.where(~is_train()).select("request")).select(F.md5("request").alias("request"))


def g4_leak_rate(spark, d):
    """Of each evaluation split, the records whose exact request stands in the training split."""
    r = requests(spark, d).where("request <> ''")
    seen = r.where(is_train()).select("request").distinct().withColumn("hit", F.lit(1))
    return r.where(~is_train()).join(seen, "request", "left").groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count("hit").alias("leaked"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("rate"))


def g5_unreferenced(spark, d):
    """Tools no task refers to, by source type."""
    return tools(spark, d, "source_type").join(tasks(spark, d, "tool_id").select("tool_id").where("tool_id IS NOT NULL").distinct(), "tool_id", "left_anti").groupBy("source_type").agg(F.count(F.lit(1)).alias("tools"))


def d19_known_tasks(spark, d):
    return tasks(spark, d, "tool_id").join(tools(spark, d).select("tool_id"), "tool_id", "left_semi").agg(F.count(F.lit(1)).alias("known"))


def d20_orphans(spark, d):
    """Tasks whose tool is null or unknown."""
    return tasks(spark, d, "tool_id").join(tools(spark, d).select("tool_id"), "tool_id", "left_anti").select("task_id")


def g6_ambiguous(spark, d):
    """Requests that name more than one tool: counts are combined before the shuffle, no group is gathered."""
    r = requests(spark, d).where("request <> ''").groupBy("request").agg(F.countDistinct("tool_name").alias("tools"), F.count(F.lit(1)).alias("records"))
    return r.where("tools > 1").select(F.md5("request").alias("request"), "tools", "records")


def g7_coverage(spark, d):
    """Tools with under two positive or two negative tasks, tools without tasks included."""
    n = requests(spark, d).groupBy("tool_id").agg(F.count_if("should_trigger").alias("p"), F.count_if(~F.col("should_trigger")).alias("n"))
    j = tools(spark, d).select("tool_id").join(n, "tool_id", "left").select("tool_id", F.coalesce("p", F.lit(0)).alias("positive"), F.coalesce("n", F.lit(0)).alias("negative"))
    return j.where("positive < 2 OR negative < 2")


def g8_audit(spark, d):
    """Check rows: what must hold of the tasks, with the number of violations as evidence."""
    raw, r = read(spark, d, "eval_tasks"), requests(spark, d)
    checks = {
        "repeated_task_ids": raw.groupBy("task_id").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")),
        "missing_split": r.agg(F.count_if(F.col("split").isNull()).alias("n")),
        "blank_requests": r.agg(F.count_if(F.col("request") == "").alias("n")),
        "negatives_without_category": r.agg(F.count_if(~F.col("should_trigger") & F.col("negative_category").isNull()).alias("n")),
        "unknown_tools": r.join(tools(spark, d).select("tool_id"), "tool_id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    rows = [c.select(F.lit(k).alias("check_id"), F.lit("error" if k in ("repeated_task_ids", "unknown_tools") else "warning").alias("severity"), (F.col("n") == 0).alias("ok"), F.col("n").alias("evidence")) for k, c in checks.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def f6_balanced(spark, d):
    """The first two positives and two negatives of each tool, by task id.

    Ranks are taken within hashed parts of a tool first, so that a tool with a third of all tasks isn't sorted in one task.
    """
    r = requests(spark, d).select("task_id", "tool_id", "should_trigger").where("tool_id IS NOT NULL")
    part = F.pmod(F.hash("task_id"), F.lit(16))
    first = r.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("tool_id", "should_trigger", "part").orderBy("task_id"))).where("k <= 2")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("tool_id", "should_trigger").orderBy("task_id"))).where("rank <= 2").select("task_id", "tool_id", "should_trigger", "rank")


def f22_rewritten(spark, d):
    """Second and later records of a request, which get their id as a suffix."""
    r = requests(spark, d).where("request <> ''")
    first = r.groupBy("request").agg(F.min("task_id").alias("first"))
    suffix = F.concat("user_request", F.lit(" Use benchmark item id "), "task_id", F.lit(" to distinguish this item."))
    return r.join(first, "request").where("task_id <> first").select("task_id", F.md5(suffix).alias("rewritten"))


def e11_control_stats(spark, d):
    r = requests(spark, d).withColumns({"split": F.coalesce("split", F.lit("default")), "category": F.coalesce("negative_category", F.lit("none"))})
    return r.groupBy("split", "category", "difficulty").agg(F.count(F.lit(1)).alias("controls"), F.countDistinct(F.coalesce("tool_id", "tool_name")).alias("tools"))


def e12_control_summary(spark, d):
    """Over tools, the fewest and most tasks of either kind."""
    per = requests(spark, d).groupBy("tool_id").agg(F.count_if("should_trigger").alias("p"), F.count_if(~F.col("should_trigger")).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("tools"), F.min("p").alias("min_positive"), F.min("n").alias("min_negative"), F.max("p").alias("max_positive"), F.max("n").alias("max_negative"))


def gold(spark, d):
    """Each task's gold arguments as a map, with the argument names of its tool."""
    t = tools(spark, d, "arguments").select("tool_id", F.col("arguments.name").alias("known"), F.filter("arguments", lambda a: a["required"])["name"].alias("required"))
    e = tasks(spark, d, "tool_id", "expected_arguments").select("task_id", "tool_id", F.from_json("expected_arguments", "map<string,string>").alias("args"))
    return e.where("args IS NOT NULL").join(t, "tool_id")


def c8_arguments(spark, d):
    """Gold arguments the tool doesn't list, and the share of its required ones that are there."""
    g = gold(spark, d).withColumn("keys", F.map_keys("args")).where("size(known) > 0")
    need = F.size("required")
    recall = F.when(need <= 0, 1.0).otherwise(F.round(F.size(F.array_intersect("required", "keys")) / F.greatest(need, F.lit(1)), 4))
    return g.select("task_id", F.size("keys").alias("given"), F.size(F.array_except("keys", "known")).alias("unlisted"), recall.alias("recall"))


def c9_gold_issues(spark, d):
    """Issues of gold arguments under their tool's schema, by code and difficulty."""
    t = tools(spark, d, "input_schema_raw", "arguments").withColumnRenamed("input_schema_raw", "schema")
    e = tasks(spark, d, "tool_id", "expected_arguments", "difficulty").withColumnRenamed("expected_arguments", "expected")
    found = validation.validated(e.join(t, "tool_id"))
    return found.join(e.select("task_id", F.lower("difficulty").alias("difficulty")), "task_id").groupBy("code", "difficulty").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("task_id").alias("tasks"))


def c1_canonical_arguments(spark, d):
    """How often each set of gold arguments is given, members in order."""
    c = F.to_json(F.try_parse_json("expected_arguments"))
    return tasks(spark, d, "expected_arguments").where("expected_arguments IS NOT NULL").groupBy(F.md5(c).alias("arguments")).agg(F.count(F.lit(1)).alias("tasks"))


def i17_contrast_terms(spark, d):
    """Of each domain, the eight words that mark requests to call a tool (or not to) most: at least as many (more) requests of
    the one kind than of the other have them; ties by word. A request counts a word once; counts are combined before the shuffle."""
    t = tools(spark, d, "domain").select("tool_id", F.coalesce(F.nullif(text.normalized_request(F.col("domain")), F.lit("")), F.lit("general")).alias("domain"))
    r = requests(spark, d).join(t, "tool_id").select("domain", "should_trigger", F.explode(F.array_distinct(text.distractor_tokens(F.col("user_request")))).alias("term"))
    n = r.groupBy("domain", "term").agg(F.count_if("should_trigger").alias("p"), F.count_if(~F.col("should_trigger")).alias("n"))
    kind = F.when(F.col("n") > F.col("p"), "negative").when(F.col("p") >= F.greatest(F.lit(1), F.col("n")), "positive")
    n = n.withColumns({"kind": kind, "count": F.greatest("p", "n")})
    w = Window.partitionBy("domain", "kind").orderBy(F.desc("count"), "term")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("domain", "kind", "rank", "term", "count")


def slot_values(spark, d):
    """Of each argument name in gold arguments: how often it is given, its distinct values, and the least one."""
    e = tasks(spark, d, "expected_arguments").select(F.explode(F.from_json("expected_arguments", "map<string,string>")).alias("argument", "value"))
    return e.groupBy("argument").agg(F.count(F.lit(1)).alias("given"), F.countDistinct("value").alias("distinct_values"), F.min("value").alias("least"))


#: Variants of generated requests: (category, split parity, text with {} for the tool's name as words).
TEMPLATES = (
    ("positive_direct", 0, "Please use {} for this item now."),
    ("positive_named", 1, "The correct tool is {} and it should run with the values I gave."),
    ("planning_only", 0, "Explain how {} works, but do not actually call it."),
    ("checklist", 1, "I only want a checklist of inputs for {}."),
    ("missing_input", 0, "I may use {} later, i do not know the required field yet."),
    ("wrong_tool", 1, "Answer without using {} please."),
    ("preview", 0, "Only preview what would change with {}, do not delete a thing."),
    ("out_of_domain", 1, "My question about the weather is unrelated to {}."),
)


def generated(spark, d):
    t = tools(spark, d, "tool_name").where("tool_name IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("parity"), F.concat(F.lit(x.split("{}")[0]), F.regexp_replace("tool_name", "_", " "), F.lit(x.split("{}")[1])).alias("user_request")) for c, s, x in TEMPLATES])
    return t.select("tool_id", "tool_name", F.posexplode(rows).alias("i", "r")).select(F.concat("tool_id", F.lit("-"), "i").alias("control_id"), "tool_id", "tool_name", "r.*")


def j1_controls(spark, d):
    """A control for each tool and variant, with its split by parity."""
    g = generated(spark, d)
    return g.select("control_id", "category", F.when(F.col("parity") == 0, "dev").otherwise("test").alias("split"), F.col("category").startswith("positive").alias("should_trigger"), F.when(F.col("category").startswith("positive"), F.col("tool_name")).otherwise(ABSTAIN).alias("gold_tool"), F.md5("user_request").alias("request"))


def c16_boundaries(spark, d):
    """What the predicates say of generated requests about their own tool."""
    g = generated(spark, d)
    r, t = F.col("user_request"), F.col("tool_name")
    g = g.select("category", rq.forbids(r, t).alias("forbids"), rq.selects(r, t).alias("selects"), F.coalesce(rq.abstention(r), F.lit("none")).alias("reason"))
    return g.groupBy("category", "forbids", "selects", "reason").agg(F.count(F.lit(1)).alias("controls"))


def c18_abstentions(spark, d):
    return requests(spark, d).groupBy(F.coalesce(rq.abstention(F.col("user_request")), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("tasks"))


def late_by_day(spark, d):
    """Days between creation and delivery of task rows."""
    return read(spark, d, "eval_tasks").groupBy(F.floor((F.unix_micros("ingested_at") - F.unix_micros("created_at")) / 86_400_000_000).alias("days")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and (k[0] in "cdefgijn" and k[1:2].isdigit())} | {"x_late_rows": late_by_day, "x_slot_values": slot_values}

RQ = f"""WITH {TASKS}, {TOOLS}, r AS (SELECT task_id, tool_id, tool_name, user_request, source, negative_category, lower(difficulty) AS difficulty, trim(lower(split)) AS split, coalesce(should_trigger, true) AS should_trigger,
  trim(regexp_replace(lower(coalesce(user_request, '')), '\\s+', ' ', 'g')) AS request FROM ev)"""
ROUTE = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[_./:-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
GEN = f"WITH {TOOLS}, ge AS (" + " UNION ALL ".join(f"SELECT tool_id || '-{i}' AS control_id, tool_id, tool_name, '{c}' AS category, {s} AS parity, '{x.split('{}')[0]}' || replace(tool_name, '_', ' ') || '{x.split('{}')[1]}' AS user_request FROM tl WHERE tool_name IS NOT NULL" for i, (c, s, x) in enumerate(TEMPLATES)) + ")"
NAMED = lambda ps: "(nm <> '' AND (" + " OR ".join(f"contains(tx, '{p.split('{}')[0]}' || nm || '{p.split('{}')[1]}')" for p in ps) + "))"
REASON = "CASE WHEN tx = '' THEN 'empty_request' " + " ".join("WHEN " + " AND ".join("(" + " OR ".join(f"regexp_matches(tx, '{p[1:]}')" if p[0] == "~" else f"contains(tx, '{p}')" for p in g) + ")" for g in gs) + f" THEN '{x}'" for x, gs in rq.ABSTAIN) + " ELSE 'none' END"
GOLD = f"""WITH {TASKS}, {TOOLS}, g AS (SELECT task_id, json_keys(expected_arguments) AS keys, list_transform(arguments, lambda a: a.name) AS known, list_transform(list_filter(arguments, lambda a: a.required), lambda a: a.name) AS required
  FROM ev JOIN tl ON ev.tool_id = tl.tool_id WHERE expected_arguments IS NOT NULL)"""
FAR = f"(nm <> '' AND (regexp_matches(tx, '{rq.BEFORE}' || regexp_escape(nm) || '\\b') OR regexp_matches(tx, '\\bnot\\s+' || regexp_escape(nm) || '\\b{rq.AFTER}')))"
FORBIDS = f"({NAMED(rq.FORBID)} OR {FAR})"
SELECTS = f"(NOT {FORBIDS} AND {NAMED(rq.SELECT)})"
SQL = {
    "g3_shared_requests": f"{RQ} SELECT md5(request) AS request FROM (SELECT request FROM r WHERE request <> '' AND starts_with(split, 'train') INTERSECT SELECT request FROM r WHERE request <> '' AND NOT starts_with(split, 'train'))",
    "g4_leak_rate": f"{RQ} SELECT split, count(*) AS records, count_if(request IN (SELECT request FROM r WHERE starts_with(split, 'train'))) AS leaked, round(count_if(request IN (SELECT request FROM r WHERE starts_with(split, 'train'))) / count(*), 4) AS rate FROM r WHERE request <> '' AND NOT starts_with(split, 'train') GROUP BY 1",
    "g5_unreferenced": f"{RQ} SELECT source_type, count(*) AS tools FROM tl WHERE tool_id NOT IN (SELECT tool_id FROM ev WHERE tool_id IS NOT NULL) GROUP BY 1",
    "d19_known_tasks": f"{RQ} SELECT count(*) AS known FROM ev WHERE tool_id IN (SELECT tool_id FROM tl)",
    "d20_orphans": f"{RQ} SELECT task_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.tool_id = ev.tool_id)",
    "g6_ambiguous": f"{RQ} SELECT md5(request) AS request, count(DISTINCT tool_name) AS tools, count(*) AS records FROM r WHERE request <> '' GROUP BY request HAVING count(DISTINCT tool_name) > 1",
    "g7_coverage": f"{RQ} SELECT tl.tool_id, count(r.task_id) FILTER (should_trigger) AS positive, count(r.task_id) FILTER (NOT should_trigger) AS negative FROM tl LEFT JOIN r ON tl.tool_id = r.tool_id GROUP BY 1 HAVING positive < 2 OR negative < 2",
    "g8_audit": f"""{RQ}, k AS (SELECT 'repeated_task_ids' AS check_id, 'error' AS severity, (SELECT count(*) FROM (SELECT task_id FROM eval_tasks GROUP BY 1 HAVING count(*) > 1)) AS evidence
      UNION ALL SELECT 'missing_split', 'warning', (SELECT count(*) FROM r WHERE split IS NULL) UNION ALL SELECT 'blank_requests', 'warning', (SELECT count(*) FROM r WHERE request = '')
      UNION ALL SELECT 'negatives_without_category', 'warning', (SELECT count(*) FROM r WHERE NOT should_trigger AND negative_category IS NULL)
      UNION ALL SELECT 'unknown_tools', 'error', (SELECT count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.tool_id = r.tool_id))) SELECT check_id, severity, evidence = 0 AS ok, evidence FROM k""",
    "f6_balanced": f"{RQ} SELECT task_id, tool_id, should_trigger, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tool_id, should_trigger ORDER BY task_id) AS k FROM r WHERE tool_id IS NOT NULL) WHERE k <= 2",
    "f22_rewritten": f"{RQ} SELECT task_id, md5(user_request || ' Use benchmark item id ' || task_id || ' to distinguish this item.') AS rewritten FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY task_id) AS k FROM r WHERE request <> '') WHERE k > 1",
    "e11_control_stats": f"{RQ} SELECT coalesce(split, 'default') AS split, coalesce(negative_category, 'none') AS category, difficulty, count(*) AS controls, count(DISTINCT coalesce(tool_id, tool_name)) AS tools FROM r GROUP BY 1, 2, 3",
    "e12_control_summary": f"{RQ}, p AS (SELECT tool_id, count_if(should_trigger) AS p, count_if(NOT should_trigger) AS n FROM r GROUP BY 1) SELECT count(*) AS tools, min(p) AS min_positive, min(n) AS min_negative, max(p) AS max_positive, max(n) AS max_negative FROM p",
    "c8_arguments": f"{GOLD} SELECT task_id, CAST(len(keys) AS INT) AS given, CAST(len(list_filter(keys, lambda k: NOT list_contains(known, k))) AS INT) AS unlisted, CASE WHEN len(required) = 0 THEN 1 ELSE round(len(list_filter(required, lambda k: list_contains(keys, k)))::DOUBLE / len(required), 4) END AS recall FROM g WHERE len(known) > 0",
    "x_slot_values": f"WITH {TASKS}, x AS (SELECT argument, json_extract_string(expected_arguments, '$.\"' || argument || '\"') AS value FROM (SELECT expected_arguments, unnest(json_keys(expected_arguments)) AS argument FROM ev WHERE expected_arguments IS NOT NULL)) SELECT argument, count(*) AS given, count(DISTINCT value) AS distinct_values, min(value) AS least FROM x GROUP BY 1",
    "j1_controls": f"{GEN} SELECT control_id, category, CASE WHEN parity = 0 THEN 'dev' ELSE 'test' END AS split, starts_with(category, 'positive') AS should_trigger, CASE WHEN starts_with(category, 'positive') THEN tool_name ELSE '__abstain__' END AS gold_tool, md5(user_request) AS request FROM ge",
    "c16_boundaries": f"{GEN}, x AS (SELECT category, {ROUTE('user_request')} AS tx, {ROUTE('tool_name')} AS nm FROM ge) SELECT category, {FORBIDS} AS forbids, {SELECTS} AS selects, {REASON} AS reason, count(*) AS controls FROM x GROUP BY 1, 2, 3, 4",
    "c18_abstentions": f"WITH {TASKS}, x AS (SELECT {ROUTE('user_request')} AS tx FROM ev) SELECT {REASON} AS reason, count(*) AS tasks FROM x GROUP BY 1",
    "x_late_rows": "SELECT CAST(floor((epoch_us(ingested_at) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS days, count(*) AS rows FROM eval_tasks GROUP BY 1",
    "c1_canonical_arguments": f"""WITH {TASKS}, c AS (SELECT '{{' || array_to_string(list_transform(list_sort(json_keys(expected_arguments)), lambda k: '"' || k || '":' || json_extract(expected_arguments, '$."' || k || '"')::VARCHAR), ',') || '}}' AS c FROM ev WHERE expected_arguments IS NOT NULL)
      SELECT md5(c) AS arguments, count(*) AS tasks FROM c GROUP BY 1""",
    "i17_contrast_terms": f"""{RQ}, t AS (SELECT tool_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(domain, '')), '\\s+', ' ', 'g')), ''), 'general') AS domain FROM tl),
      x AS (SELECT domain, should_trigger, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(user_request, '')), '[a-z0-9]+'), lambda x: length(x) > 1))) AS term FROM r JOIN t ON t.tool_id = r.tool_id),
      c AS (SELECT domain, term, count_if(should_trigger) AS p, count_if(NOT should_trigger) AS n FROM x GROUP BY 1, 2), k AS (SELECT domain, term, CASE WHEN n > p THEN 'negative' ELSE 'positive' END AS kind, greatest(p, n) AS count FROM c)
      SELECT domain, kind, CAST(rank AS INT) AS rank, term, count FROM (SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY count DESC, term) AS rank FROM k) WHERE rank <= 8""",
}
