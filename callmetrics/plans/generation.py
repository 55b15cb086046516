"""Queries that make rows: requests of every variant for each tool, sample arguments, counterexamples; and checks of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.plans.tools import COLLAPSE, FEAT, NAME, d13_adjacent, featured
from callmetrics.plans.tools import SQL as TOOL_SQL
from callmetrics.plans.views import ABSTAIN, TOOLS, tools

#: Variants of requests, as (family, category, difficulty, text with the tool T, its purpose P, another tool O and its purpose Q).
VARIANTS = (
    ("positive", "direct", "easy", "Use {T} to {P}."), ("positive", "paraphrased", "medium", "I need help with this task: {P}."), ("positive", "handled", "medium", "Please handle the request to {P}; include these details where applicable."),
    ("positive", "pressed", "hard", "I am trying to get this done without using {O}: {P}. Use the best matching tool."), ("negative", "out_of_domain_request", "easy", "Plan a three-day museum itinerary; this is unrelated to {T}."),
    ("negative", "adjacent_wrong_intent", "medium", "I need to {Q}. This is adjacent to {T}, but the intended capability is {O}."), ("negative", "explanation_instead_of_action", "medium", "Explain when someone should use {T}; do not actually call it or perform the action."),
    ("negative", "known_path_no_search_needed", "medium", "I already know the exact path docs/known_file.md, so no search or discovery is needed with {T}."), ("negative", "read_vs_search_mismatch", "medium", "Read the exact item I named directly; do not search, retrieve candidates, or browse with {T}."),
    ("negative", "near_miss_intent", "hard", "This sounds close to {T}, but I only want a checklist for how to {P}; no tool call yet."), ("negative", "destructive_vs_readonly_mismatch", "hard", "Only inspect what would happen before using {T}; do not create, update, delete, send, execute, or mutate anything."),
    ("negative", "similar_tool_should_be_used", "hard", "Use {O} to {Q}; {T} is a distractor and should not be called."), ("negative", "missing_required_info", "hard", "I may need {T} to {P}, but I do not know the required input yet."),
    ("negative", "ambiguous_request", "hard", "Maybe do something with {T}; actually, I am not sure what input or action is intended."),
)


def filled(pattern: str, values: dict[str, Column]) -> Column:
    """The pattern with its places filled."""
    parts, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        parts += [F.lit(before), values[key]]
    return F.concat(*parts, F.lit(rest))


def split_of(family: Column, difficulty: Column, variant: Column) -> Column:
    """Easy ones are for development, medium ones by parity, hard ones for the test, or, if negative, by parity."""
    even = variant % 2 == 0
    return F.when(difficulty == "easy", "dev").when(difficulty == "medium", F.when(even, "dev").otherwise("test")).when(family == "positive", "test").otherwise(F.when(even, "test").otherwise("dev"))


def j2_requests(spark, d):
    """Every variant for every named tool and two parities, with its neighbour's name and purpose: (control_id, family, category, difficulty, split, gold_tool, digest of the request)."""
    title, purpose = F.regexp_replace("tool_name", "_", " "), F.coalesce(F.nullif(F.lower(text.collapsed(F.col("tool_purpose"))), F.lit("")), F.lit("do its task"))
    t = tools(spark, d, "tool_name", "tool_purpose").select("tool_id", "tool_name", title.alias("T"), purpose.alias("P"))
    near = d13_adjacent(spark, d).join(t.select(F.col("tool_id").alias("adjacent"), F.col("T").alias("O"), F.col("P").alias("Q")), "adjacent", "left")
    j = t.where("tool_name IS NOT NULL").join(near, "tool_id", "left").withColumns({"O": F.coalesce("O", F.lit("a different tool")), "Q": F.coalesce("Q", F.lit("handle the neighboring task"))})
    values = {k: F.col(k) for k in "TPOQ"}
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("family"), F.lit(c).alias("category"), F.lit(h).alias("difficulty"), filled(x, values).alias("request")) for i, (f, c, h, x) in enumerate(VARIANTS)])
    g = j.select("tool_id", "tool_name", F.explode(rows).alias("r")).select("tool_id", "tool_name", "r.*").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    gold = F.when(F.col("family") == "positive", F.col("tool_name")).otherwise(ABSTAIN)
    return g.select(F.concat_ws("-", "tool_id", "i", "variant").alias("control_id"), "family", "category", "difficulty", split_of(F.col("family"), F.col("difficulty"), F.col("variant")).alias("split"), gold.alias("gold_tool"), F.md5("request").alias("request"))


def sample(name: Column, kind: Column, enum: Column, variant: int) -> Column:
    """A value for an argument as JSON text, by its enumeration, type and name in that order."""
    n, has = F.lower(F.coalesce(name, F.lit("value"))), lambda *m: F.lower(F.coalesce(name, F.lit("value"))).rlike("|".join(m))
    number = F.when(has("limit", "count", "head", "tail", "top", "max"), F.lit(str((3, 5, 10, 20, 50)[variant % 5]))).when(has("year"), "2026").otherwise(str(variant + 1))
    word = (
        F.when(has("path", "file"), f"docs/control_{variant}.md").when(has("dir", "folder"), "docs").when(has("content", "text", "body"), f"control note {variant}").when(has("pattern", "glob"), "**/*.md").when(has("query", "search"), "reliability evaluation")
        .when(has("city", "location"), "Boston").when(has("timezone") | (n == "tz"), "America/New_York").when(has("url", "uri"), "https://example.com/resource").when(has("email"), "researcher@example.com").when(has("id"), f"item-{variant}").otherwise(F.concat(n, F.lit(f"_{variant}")))
    )
    chosen = F.element_at(enum, F.lit(variant) % F.size(enum) + 1)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    typed = F.when(kind.isin("integer", "number", "float"), number).when(kind == "boolean", F.lit("true" if variant % 2 == 0 else "false")).when(kind == "array", F.lit(f'["item_{variant}"]')).when(kind == "object", F.lit(f'{{"value":"object_{variant}"}}')).otherwise(quoted(word))
    return F.when(F.size(enum) > 0, quoted(chosen)).otherwise(typed)


def j4_sample_arguments(spark, d):
    """Of each tool sample arguments for two variants: the required ones, and with the second also those of the first two places."""
    a = tools(spark, d, "arguments").select("tool_id", F.posexplode("arguments").alias("i", "a")).where("a.name IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), (F.coalesce("a.required", F.lit(False)) | (F.lit(v == 1) & (F.col("i") < 2))).alias("used"), sample(F.col("a.name"), F.coalesce("a.type", F.lit("string")), F.col("a.enum"), v).alias("value")) for v in (0, 1)])
    return a.select("tool_id", F.col("a.name").alias("name"), F.col("i").alias("place"), F.explode(rows).alias("r")).where("r.used").select("tool_id", "name", "place", "r.variant", "r.value")


def j10_counterexamples(spark, d):
    """Up to four counterexamples of each tool's contract: a required argument missing, an unknown one, a wrong type, a value off the list."""
    t = tools(spark, d, "arguments").where(F.size("arguments") > 0)
    first = lambda p: F.try_element_at(F.filter("arguments", p), F.lit(1))["name"]
    case = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("argument")))
    cases = F.array_compact(F.array(
        case("missing_required", first(lambda a: a["required"])), F.struct(F.lit("unknown_argument").alias("kind"), F.lit("unsupported_option").alias("argument")),
        case("wrong_type", first(lambda a: a["type"].isin("integer", "number", "boolean"))), case("off_list", first(lambda a: F.size(a["enum"]) > 0)),
    ))
    return t.select("tool_id", F.explode(cases).alias("c")).select("tool_id", "c.*")


def guidance() -> Column:
    none = F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(F.array("tool_purpose"), F.coalesce("doc_snippets", none), F.coalesce("usage_warnings", none)), lambda x: x.isNotNull()), "\n")


#: Codes of issues with their severity, section and whether they can be repaired.
ISSUES = {
    "missing_purpose": ("error", "summary", True), "missing_non_usage_boundary": ("warning", "when_not_to_use", True), "unsupported_option_in_text": ("warning", "guidance", True), "excessive_verbosity": ("warning", "guidance", True),
    "no_arguments": ("error", "arguments", False), "duplicate_argument": ("error", "arguments", True),
}


def text_issues(spark, d) -> DataFrame:
    """A row for each issue of a tool's texts: tool_id, code, evidence."""
    t = tools(spark, d, "tool_name", "tool_purpose", "doc_snippets", "usage_warnings", "arguments").withColumn("g", guidance())
    names = F.coalesce(F.col("arguments.name"), F.array().cast("array<string>"))
    options = F.array_distinct(F.filter(F.regexp_extract_all("g", F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.regexp_replace(x, "_", "").rlike(r"^[\p{L}\p{N}]+$") & (x != F.coalesce("tool_name", F.lit("")))))
    n = F.size(F.filter(F.split("g", r"\s+"), lambda x: x != ""))
    issue = lambda code, cond, evidence: F.when(cond, F.array(F.struct(F.lit(code).alias("code"), evidence.cast("string").alias("evidence")))).otherwise(F.array().cast("array<struct<code:string,evidence:string>>"))
    none = F.lit(None).cast("string")
    found = F.concat(
        issue("missing_purpose", F.trim(F.coalesce("tool_purpose", F.lit(""))) == "", none), issue("missing_non_usage_boundary", F.coalesce(F.size("usage_warnings"), F.lit(0)) <= 0, none), issue("excessive_verbosity", n > 60, n), issue("no_arguments", F.coalesce(F.size("arguments"), F.lit(0)) <= 0, none),
        issue("duplicate_argument", F.size(F.array_distinct(names)) < F.size(names), none), F.transform(F.array_except(options, names), lambda x: F.struct(F.lit("unsupported_option_in_text").alias("code"), x.alias("evidence"))),
    )
    return t.select("tool_id", F.explode(found).alias("x")).select("tool_id", "x.*")


def described(k: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, v in ISSUES.items() for x in (c, v[k])]), F.col("code"))


def c10_text_issues(spark, d):
    """Issues of tools' texts, each with severity, section, whether it can be repaired, and its evidence."""
    return text_issues(spark, d).select("tool_id", "code", described(0).alias("severity"), described(1).alias("section"), described(2).alias("repairable"), "evidence")


def c12_valid(spark, d):
    """Whether each tool is valid, that is without an error, and its numbers of issues."""
    n = text_issues(spark, d).withColumn("error", described(0) == "error").groupBy("tool_id").agg(F.count_if("error").alias("errors"), F.count_if(~F.col("error")).alias("warnings"))
    j = tools(spark, d).select("tool_id").join(n, "tool_id", "left").select("tool_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    return j.select("tool_id", (F.col("errors") == 0).alias("valid"), "errors", "warnings")


def e18_package_summary(spark, d):
    """Of each source type: tools, share of valid ones, mean size of the texts, and how often each issue occurs."""
    t = tools(spark, d, "source_type", "tool_purpose", "doc_snippets", "usage_warnings").select("tool_id", "source_type", F.length(guidance()).alias("size"))
    j = t.join(c12_valid(spark, d), "tool_id")
    g = j.groupBy("source_type").agg(F.count(F.lit(1)).alias("tools"), F.round(F.avg(F.col("valid").cast("double")) + 1e-9, 4).alias("valid_rate"), F.round(F.avg("size") + 1e-9, 4).alias("avg_size"))
    codes = text_issues(spark, d).join(t.select("tool_id", "source_type"), "tool_id").groupBy("source_type", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("source_type").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "code", "n"))), ";").alias("issues"))
    return g.join(codes, "source_type", "left")


#: Patterns of instructions within documents that tell a reader to act against the schema.
INJECTIONS = (
    r"\b(?:ignore|disregard|override|forget)\b.{0,48}\b(?:schema|contract|validation|validator|instructions|system|developer|rules|requirements)\b", r"\b(?:bypass|skip|disable)\b.{0,48}\b(?:schema|contract|validation|validator|safety|boundary|gate|checks)\b",
    r"\b(?:invent|fabricate|hallucinate|make up)\b.{0,48}\b(?:argument|arguments|parameter|parameters|field|fields|input|inputs|value|values|id|identifier)\b", r"\b(?:always|force)\b.{0,30}\b(?:call|invoke|execute|use)\b", r"\b(?:set|return)\b.{0,40}\bshould_call\b.{0,20}\btrue\b",
    r"\b(?:instead|rather)\b.{0,30}\b(?:call|invoke|execute|use)\b", r"\b(?:call|invoke|execute|use)\b.{0,30}\b(?:another|other|different)\b.{0,16}\btool\b",
)


def c20_shield(spark, d):
    """Distinct snippets of each tool that are kept or held back: instructions against the schema, or changes by a tool that reads."""
    t = featured(spark, d).where("doc_snippets IS NOT NULL").select("tool_id", "side_effect_type", F.explode(text.distinct_lines(F.filter("doc_snippets", lambda x: x.isNotNull()))).alias("s"))
    low = F.lower("s")
    injected = low.rlike("|".join(INJECTIONS))
    acting = F.arrays_overlap(text.doc_tokens(F.col("s")), F.array(*[F.lit(w) for g in text.ALIAS_GROUPS[2:6] for w in g]))
    reason = F.when(injected, "instruction_injection_conflict").when((F.col("side_effect_type") == "read") & acting, "side_effect_conflict").otherwise("kept")
    return t.groupBy(reason.alias("reason"), "side_effect_type").agg(F.count(F.lit(1)).alias("snippets"), F.countDistinct("tool_id").alias("tools"))


def b16_tool_ir(spark, d):
    """A row for each argument of each tool as parsed: place, type, whether required, numbers of listed values and nested members, digest of the default."""
    a = tools(spark, d, "arguments").select("tool_id", F.posexplode("arguments").alias("place", "a"))
    nested = F.coalesce(F.size(F.map_keys(F.try_variant_get(F.try_parse_json("a.properties"), "$", "map<string,variant>"))), F.lit(0))
    return a.select("tool_id", "place", F.col("a.name").alias("name"), F.coalesce("a.type", F.lit("string")).alias("type"), F.coalesce("a.required", F.lit(False)).alias("required"), F.greatest(F.coalesce(F.size("a.enum"), F.lit(0)), F.lit(0)).alias("listed"), nested.alias("members"), F.md5("a.default_value").alias("default_digest"))


def n27_deep_scan(spark, d):
    """Tools whose schema marks any node, at any depth, as nullable, by source type."""
    t = featured(spark, d).withColumn("hit", F.col("schema_json").rlike('"nullable":true'))
    return t.groupBy("source_type").agg(F.count(F.lit(1)).alias("tools"), F.count_if("hit").alias("nullable"))


def e25_conversion(spark, d):
    """Of each source type: tools, those a conversion keeps, and why the others are skipped, as counts in one text."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    why = F.when(blank("tool_name"), "missing_name").when(blank("tool_purpose"), "missing_description").when(F.col("input_schema_raw").isNull(), "missing_schema").when(F.try_parse_json("input_schema_raw").isNull(), "unreadable_schema")
    n = tools(spark, d, "source_type", "tool_name", "tool_purpose", "input_schema_raw").groupBy("source_type", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))
    reasons = F.array_join(F.sort_array(F.collect_list(F.when(F.col("why").isNotNull(), F.concat_ws("=", "why", "n")))), "; ")
    return n.groupBy("source_type").agg(F.sum("n").alias("tools"), F.sum(F.when(F.col("why").isNull(), F.col("n")).otherwise(0)).alias("converted"), reasons.alias("skip_reasons"))


def g6_shared_prefix(spark, d):
    """Tools of one source type whose names begin with the same two words, and how many of these there are: counts, no groups."""
    parts = F.slice(F.split(text.tool_name(F.col("tool_name")), "_"), 1, 2)
    t = tools(spark, d, "source_type", "tool_name").select("source_type", F.array_join(parts, "_").alias("prefix"))
    return t.groupBy("source_type", "prefix").agg(F.count(F.lit(1)).alias("tools")).where("tools > 1")


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "bcegjn" and k[1:2].isdigit()}
QUERIES.pop("d13_adjacent", None)


def sql_filled(x: str) -> str:
    for k in "TPOQ":
        x = x.replace("{" + k + "}", f"' || {k} || '")
    return f"'{x}'"


W = f"WITH {TOOLS}"
SPLIT = "CASE WHEN difficulty = 'easy' THEN 'dev' WHEN difficulty = 'medium' THEN CASE WHEN v = 0 THEN 'dev' ELSE 'test' END WHEN family = 'positive' THEN 'test' WHEN v = 0 THEN 'test' ELSE 'dev' END"
HAS = lambda *m: f"regexp_matches(n, '{'|'.join(m)}')"


def sample_sql(v: int) -> str:
    word = f"""CASE WHEN {HAS('path', 'file')} THEN 'docs/control_{v}.md' WHEN {HAS('dir', 'folder')} THEN 'docs' WHEN {HAS('content', 'text', 'body')} THEN 'control note {v}' WHEN {HAS('pattern', 'glob')} THEN '**/*.md' WHEN {HAS('query', 'search')} THEN 'reliability evaluation' WHEN {HAS('city', 'location')} THEN 'Boston'
      WHEN {HAS('timezone')} OR n = 'tz' THEN 'America/New_York' WHEN {HAS('url', 'uri')} THEN 'https://example.com/resource' WHEN {HAS('email')} THEN 'researcher@example.com' WHEN {HAS('id')} THEN 'item-{v}' ELSE n || '_{v}' END"""
    return f"""CASE WHEN len(a.enum) > 0 THEN '"' || a.enum[{v} % len(a.enum) + 1] || '"' WHEN k IN ('integer', 'number', 'float') THEN CASE WHEN {HAS('limit', 'count', 'head', 'tail', 'top', 'max')} THEN '{(3, 5, 10, 20, 50)[v]}' WHEN {HAS('year')} THEN '2026' ELSE '{v + 1}' END
      WHEN k = 'boolean' THEN '{'true' if v % 2 == 0 else 'false'}' WHEN k = 'array' THEN '["item_{v}"]' WHEN k = 'object' THEN '{{"value":"object_{v}"}}' ELSE '"' || {word} || '"' END"""


GUIDE = "array_to_string(list_filter(list_concat([tool_purpose], coalesce(doc_snippets, []), coalesce(usage_warnings, [])), lambda x: x IS NOT NULL), chr(10))"
ISSUED = rf"""{W}, g AS (SELECT *, {GUIDE} AS g, coalesce(list_transform(arguments, lambda a: a.name), []) AS names FROM tl), n AS (SELECT *, len(list_filter(regexp_split_to_array(g, '\s+'), lambda x: x <> '')) AS n FROM g),
i AS (SELECT tool_id, 'missing_purpose' AS code, NULL AS evidence FROM n WHERE trim(coalesce(tool_purpose, '')) = '' UNION ALL SELECT tool_id, 'missing_non_usage_boundary', NULL FROM n WHERE coalesce(len(usage_warnings), 0) = 0 UNION ALL SELECT tool_id, 'excessive_verbosity', n::VARCHAR FROM n WHERE n > 60
  UNION ALL SELECT tool_id, 'no_arguments', NULL FROM n WHERE len(names) = 0 UNION ALL SELECT tool_id, 'duplicate_argument', NULL FROM n WHERE len(list_distinct(names)) < len(names)
  UNION ALL SELECT tool_id, 'unsupported_option_in_text', x FROM (SELECT tool_id, tool_name, names, unnest(list_distinct(regexp_extract_all(g, '`([^`]+)`', 1))) AS x FROM n) WHERE x <> coalesce(tool_name, '') AND NOT list_contains(names, x) AND regexp_matches(replace(x, '_', ''), '^[\p{{L}}\p{{N}}]+$'))"""
KIND = lambda k: "CASE code " + " ".join(f"WHEN '{c}' THEN {v[k]!r}" for c, v in ISSUES.items()) + " END"
VALID = f"{ISSUED}, v AS (SELECT tl.tool_id, source_type, count_if(coalesce({KIND(0)} = 'error', false)) AS errors, count_if(coalesce({KIND(0)} = 'warning', false)) AS warnings FROM tl LEFT JOIN i USING (tool_id) GROUP BY 1, 2)"
SQL = {
    "j2_requests": f"""WITH ad AS ({TOOL_SQL['d13_adjacent']}), {TOOLS}, t AS (SELECT tool_id, tool_name, replace(tool_name, '_', ' ') AS T, coalesce(nullif(lower({COLLAPSE('tool_purpose')}), ''), 'do its task') AS P FROM tl),
      b AS (SELECT x.tool_id, x.tool_name, x.T, x.P, coalesce(y.T, 'a different tool') AS O, coalesce(y.P, 'handle the neighboring task') AS Q FROM t x LEFT JOIN ad USING (tool_id) LEFT JOIN t y ON y.tool_id = adjacent WHERE x.tool_name IS NOT NULL),
      r AS ({' UNION ALL '.join(f"SELECT tool_id, tool_name, {i} AS i, '{f}' AS family, '{c}' AS category, '{h}' AS difficulty, {sql_filled(x)} AS request FROM b" for i, (f, c, h, x) in enumerate(VARIANTS))})
      SELECT tool_id || '-' || i || '-' || v AS control_id, family, category, difficulty, {SPLIT} AS split, CASE WHEN family = 'positive' THEN tool_name ELSE '{ABSTAIN}' END AS gold_tool, md5(request) AS request FROM r, range(2) z(v)""",
    "j4_sample_arguments": f"""{W}, e AS (SELECT tool_id, unnest(arguments) AS a, unnest(range(len(arguments))) AS place FROM tl), n AS (SELECT *, lower(coalesce(a.name, 'value')) AS n, coalesce(a.type, 'string') AS k FROM e WHERE a.name IS NOT NULL)
      {' UNION ALL '.join(f"SELECT tool_id, a.name AS name, place, {v} AS variant, {sample_sql(v)} AS value FROM n WHERE coalesce(a.required, false) OR ({v} = 1 AND place < 2)" for v in (0, 1))}""",
    "j10_counterexamples": f"""{W}, c AS (SELECT tool_id, unnest([{{'kind': 'missing_required', 'argument': list_filter(arguments, lambda a: a.required)[1].name}}, {{'kind': 'unknown_argument', 'argument': 'unsupported_option'}}, {{'kind': 'wrong_type', 'argument': list_filter(arguments, lambda a: a.type IN ('integer', 'number', 'boolean'))[1].name}},
      {{'kind': 'off_list', 'argument': list_filter(arguments, lambda a: len(a.enum) > 0)[1].name}}]) AS c FROM tl WHERE len(arguments) > 0) SELECT tool_id, c.kind AS kind, c.argument AS argument FROM c WHERE c.argument IS NOT NULL""",
    "c10_text_issues": f"{ISSUED} SELECT tool_id, code, {KIND(0)} AS severity, {KIND(1)} AS section, {KIND(2)} AS repairable, evidence FROM i",
    "c12_valid": f"{VALID} SELECT tool_id, errors = 0 AS valid, errors, warnings FROM v",
    "e18_package_summary": f"""{VALID}, s AS (SELECT v.source_type, count(*) AS tools, round(avg((errors = 0)::INT) + 1e-9::DOUBLE, 4) AS valid_rate, round(avg(length(g)) + 1e-9::DOUBLE, 4) AS avg_size FROM v JOIN g USING (tool_id) GROUP BY 1),
      k AS (SELECT source_type, code, count(*) AS n FROM i JOIN tl USING (tool_id) GROUP BY 1, 2), l AS (SELECT source_type, array_to_string(list_sort(list(code || '=' || n)), ';') AS issues FROM k GROUP BY 1) SELECT * FROM s LEFT JOIN l USING (source_type)""",
}


SQL |= {
    "b16_tool_ir": f"{W}, e AS (SELECT tool_id, unnest(arguments) AS a, unnest(range(len(arguments))) AS place FROM tl) SELECT tool_id, place, a.name AS name, coalesce(a.type, 'string') AS type, coalesce(a.required, false) AS required, coalesce(len(a.enum), 0) AS listed, CASE WHEN json_valid(a.properties) AND json_type(a.properties) = 'OBJECT' THEN len(json_keys(a.properties)) ELSE 0 END AS members, md5(a.default_value) AS default_digest FROM e",
    "n27_deep_scan": f"""{FEAT} SELECT source_type, count(*) AS tools, count_if(contains(j::VARCHAR, '"nullable":true')) AS nullable FROM ft GROUP BY 1""",
    "e25_conversion": f"""{W}, y AS (SELECT source_type, CASE WHEN trim(coalesce(tool_name, '')) = '' THEN 'missing_name' WHEN trim(coalesce(tool_purpose, '')) = '' THEN 'missing_description' WHEN input_schema_raw IS NULL THEN 'missing_schema' WHEN NOT json_valid(input_schema_raw) THEN 'unreadable_schema' END AS why, count(*) AS n FROM tl GROUP BY 1, 2)
      SELECT source_type, CAST(sum(n) AS BIGINT) AS tools, CAST(coalesce(sum(n) FILTER (why IS NULL), 0) AS BIGINT) AS converted, coalesce(array_to_string(list_sort(list(why || '=' || n) FILTER (why IS NOT NULL)), '; '), '') AS skip_reasons FROM y GROUP BY 1""",
    "g6_shared_prefix": f"{W} SELECT source_type, array_to_string(string_split({NAME('tool_name')}, '_')[1:2], '_') AS prefix, count(*) AS tools FROM tl GROUP BY 1, 2 HAVING count(*) > 1",
}


def shield_sql() -> str:
    from callmetrics.plans.retrieval import DOC, LIST

    acting = LIST([w for g in text.ALIAS_GROUPS[2:6] for w in g])
    bad = "|".join(INJECTIONS)
    return rf"""{FEAT}, s AS (SELECT tool_id, side_effect_type, unnest(list_distinct(list_filter(list_transform(list_filter(doc_snippets, lambda s: s IS NOT NULL), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> ''))) AS s FROM ft)
      SELECT CASE WHEN regexp_matches(lower(s), '{bad}') THEN 'instruction_injection_conflict' WHEN side_effect_type = 'read' AND list_has_any({DOC('s')}, {acting}) THEN 'side_effect_conflict' ELSE 'kept' END AS reason, side_effect_type, count(*) AS snippets, count(DISTINCT tool_id) AS tools FROM s GROUP BY 1, 2"""


SQL["c20_shield"] = shield_sql()
