"""Queries over tool records: normalisation, features, dedupe, caps, sampling, similarity, texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callmetrics.functions import similarity, stats, text
from callmetrics.operators import tool_features as tf
from callmetrics.plans.views import SCHEMAS, TOOLS, read, tools

SOURCE = ("tool_name", "tool_purpose", "server_name", "domain", "source_type", "arguments", "doc_snippets", "input_schema_raw")
LETTERS = ("tool_id", "normalized_name", "summary", "documentation_length")


def featured(spark, d):
    return tf.features(tools(spark, d, *SOURCE))


def b1_normalized(spark, d):
    """The canonical projection: records without a name or purpose are dropped."""
    df = featured(spark, d).where("normalized_name <> '' AND documentation_length > 0")
    return df.select(*LETTERS, F.initcap(F.regexp_replace("normalized_name", "_", " ")).alias("title"))


def b4_complexity(spark, d):
    return featured(spark, d).select("tool_id", "num_arguments", "num_required", (F.col("num_arguments") - F.col("num_required")).alias("num_optional"), "num_enum", "has_object", "has_array", "has_boolean", "documentation_length")


def b7_ambiguity(spark, d):
    return featured(spark, d).select("tool_id", "ambiguity", "completeness")


def b9_inferred_domain(spark, d):
    return featured(spark, d).select("tool_id", "inferred_domain")


def b11_source_category(spark, d):
    return featured(spark, d).groupBy("source_category").agg(F.count(F.lit(1)).alias("tools"))


def b12_side_effect(spark, d):
    return featured(spark, d).select("tool_id", "side_effect_type", "auth_required", "hints")


def b13_difficulty(spark, d):
    return featured(spark, d).groupBy("side_effect_type", "difficulty").agg(F.count(F.lit(1)).alias("tools"))


def b19_ambiguity_flags(spark, d):
    """Flag counts: a missing purpose, no arguments, arguments without a description."""
    df = featured(spark, d)
    flags = F.array_compact(F.array(F.when(F.col("documentation_length") == 0, "missing_tool_description"), F.when(F.col("num_arguments") == 0, "empty_input_schema"), F.when(F.col("undescribed") > 0, "missing_argument_description")))
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("tools"))


def b33_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"), text.word_count(F.col("text")).alias("blank_words"))


def b33_tokens_by_kind(spark, d):
    df = read(spark, d, "documents").withColumn("t", text.token_count(F.col("text")))
    return df.groupBy("doc_kind", F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("documents"), F.sum("t").cast("long").alias("tokens"), F.max("t").alias("longest"))


def c23_violations(spark, d):
    """Raw records that lack a required field, by field."""
    df = tools(spark, d, "tool_name", "tool_purpose", "server_name", "domain")
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return df.agg(*[blank(c).alias(c) for c in ("tool_name", "tool_purpose", "server_name", "domain")]).unpivot([], ["tool_name", "tool_purpose", "server_name", "domain"], "field", "missing")


def typed_domain():
    """A domain as it was typed, without regard to case and blanks."""
    return F.coalesce(F.nullif(text.normalized_request(F.col("domain")), F.lit("")), F.lit("general"))


def b8_domains(spark, d):
    """Canonical domains: aliases resolved, missing ones inferred from the texts."""
    return featured(spark, d).groupBy("resolved_domain", F.col("canonical").isNull().alias("inferred")).agg(F.count(F.lit(1)).alias("tools"))


def e7_dataset_stats(spark, d):
    df = featured(spark, d).withColumn("domain", F.col("resolved_domain"))
    return df.groupBy("source_type", "domain", "side_effect_type").agg(F.count(F.lit(1)).alias("tools"), F.countDistinct("server_name").alias("servers"), stats.mean(F.col("num_arguments")).alias("avg_arguments"), stats.mean(F.col("ambiguity")).alias("avg_ambiguity"))


def e8_domain_complexity(spark, d):
    df = featured(spark, d).withColumn("domain", F.col("resolved_domain"))
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("tools"), stats.mean(F.col("num_arguments")).alias("avg_arguments"), stats.mean(F.col("num_required")).alias("avg_required"), F.count_if("has_object").alias("nested"), F.count_if("has_array").alias("arrays"), F.sum("num_enum").cast("long").alias("enums"), stats.mean(F.col("documentation_length")).alias("avg_doc"), F.count_if(F.col("difficulty") == "hard").alias("hard"))


def e9_difficulty_by_domain(spark, d):
    return featured(spark, d).groupBy("inferred_domain", "difficulty").agg(F.count(F.lit(1)).alias("tools"), F.count_if("auth_required").alias("auth"))


def e10_histograms(spark, d):
    """Value counts of several columns in one pass."""
    cols = ("side_effect_type", "difficulty", "source_type", "inferred_domain")
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])
    return featured(spark, d).select(F.explode(pairs).alias("p")).groupBy(F.col("p.c").alias("column_name"), F.col("p.v").alias("value")).agg(F.count(F.lit(1)).alias("tools"))


def e30_document_frequency(spark, d):
    """In how many documents each retrieval token stands."""
    return read(spark, d, "documents").select(F.explode(F.array_distinct(text.retrieval_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def f23_top_terms(spark, d):
    """The 32 most common name tokens with two tools or more; ties by token."""
    df = tools(spark, d, "tool_name").select(F.explode(F.array_distinct(text.distractor_tokens(F.col("tool_name")))).alias("token"))
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("tools")).where("tools >= 2").orderBy(F.desc("tools"), "token").limit(32)


def schema_hash():
    """Sixteen hex digits that name a schema: equal for equal JSON values, whatever their order of members and layout."""
    return F.substring(F.sha2(F.to_json(tf.schema(F.col("input_schema_raw"))), 256), 1, 16)


def b3_schema_hash(spark, d):
    """The first tool and the number of tools of each schema value that two tools or more have."""
    g = tools(spark, d, "input_schema_raw", "arguments").groupBy(schema_hash().alias("h")).agg(F.count(F.lit(1)).alias("tools"), F.min("tool_id").alias("first_tool"))
    return g.where("tools > 1").select("first_tool", "tools")


def f1_dedupe(spark, d):
    """The first tool of each (normalised name, schema value) and its number of copies, which are combined before the shuffle."""
    df = tools(spark, d, "tool_name", "input_schema_raw", "arguments").select("tool_id", text.tool_name(F.col("tool_name")).alias("name"), schema_hash().alias("schema"))
    return df.groupBy("name", "schema").agg(F.min("tool_id").alias("tool_id"), F.count(F.lit(1)).alias("copies")).select("name", "tool_id", "copies")


def capped(df, keys, order, cap):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= cap)


def f3_source_cap(spark, d):
    """At most 50 tools a source type, first by id."""
    return capped(tools(spark, d, "source_type"), ["source_type"], ["tool_id"], 50).select("source_type", "tool_id", "rank")


def f4_fraction_cap(spark, d):
    """Of handwritten tools as many as make a tenth of the result, first by id; all others.

    Nothing is ordered as a whole: tools are counted by the beginnings of their ids, a running sum over these few rows finds
    the beginning at the border, and only its tools are ranked.
    """
    df = tools(spark, d, "source_type").withColumn("made", F.coalesce(F.col("source_type") == "handwritten", F.lit(False)))
    cap = df.agg(F.floor(0.1 * F.count_if(~F.col("made")) / 0.9).cast("long").alias("cap")).scalar()
    mine = df.where("made").select("tool_id", "source_type", F.expr("substring(tool_id, 1, length(tool_id) - 4)").alias("begin"))
    parts = mine.groupBy("begin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.select("begin", (cap - F.coalesce("before", F.lit(0))).alias("room"), "n").where("room > 0")
    whole = mine.join(parts.where("room >= n"), "begin", "left_semi").select("tool_id", "source_type")
    border = mine.join(parts.where("room < n"), "begin").withColumn("rank", F.row_number().over(Window.partitionBy("begin").orderBy("tool_id"))).where("rank <= room").select("tool_id", "source_type")
    return df.where("NOT made").select("tool_id", "source_type").union(whole).union(border)


def f9_shuffled(spark, d):
    """A hundred tools in an order made by hashes of the ids."""
    return tools(spark, d).select("tool_id", F.md5(F.concat(F.lit("42|"), "tool_id")).alias("k")).orderBy("k").limit(100).select("tool_id")


def f18_round_robin(spark, d):
    """Sixty tools, one after another from each (source type, side effect) bucket."""
    df = featured(spark, d).select("tool_id", "source_type", "side_effect_type", F.md5(F.concat(F.lit("7|"), "tool_id")).alias("k"))
    return capped(df, ["source_type", "side_effect_type"], ["k"], 60).orderBy("rank", "source_type", "side_effect_type").limit(60).select("tool_id")


def f20_shards(spark, d):
    """Sizes of eight shards by hash of the id: what modulo sharding by position gives, without a global sort."""
    return tools(spark, d).groupBy((F.conv(F.substring(F.md5("tool_id"), 1, 8), 16, 10).cast("long") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("tools"))


def h_tokenizers(spark, d):
    """Token counts of purposes under each tokenizer."""
    df = tools(spark, d, "tool_purpose")
    p = F.col("tool_purpose")
    return df.select("tool_id", F.size(text.distractor_tokens(p)).alias("distractor"), F.size(text.retrieval_tokens(p)).alias("retrieval"), F.size(F.array_distinct(text.retrieval_tokens(p))).alias("distinct_retrieval"), F.md5(text.routing_text(p)).alias("routing_text"))


def h11_slugs(spark, d):
    """Names of at most 24 characters; longer ones end in a hash."""
    n = text.tool_name(F.col("tool_name"))
    slug = F.when(F.length(n) <= 24, n).otherwise(F.concat(F.substring(n, 1, 15), F.lit("_"), F.substring(F.sha1(n), 1, 8)))
    return tools(spark, d, "tool_name").select("tool_id", slug.alias("slug"))


#: Labels whose means are compared with every vector; more are an error.
MOST_LABELS = 10_000


def m2_cosine(spark, d):
    """The nearest label of every vector: cosine with the mean vector of each label.

    The means are one value (a scalar subquery, of a bounded number of labels); no vector meets another.
    """
    v = read(spark, d, "embeddings")
    flat = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = flat.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.col("label").alias("near"), F.transform("s", lambda s: s["m"]).alias("mean"))
    one = means.agg(F.collect_list(F.struct("near", "mean")).alias("means")).select(F.when(F.size("means") > MOST_LABELS, F.raise_error(F.lit("too many labels"))).otherwise(F.col("means")).alias("means")).scalar()
    score = lambda m: F.struct(F.round(similarity.cosine(F.col("embedding"), m["mean"]), 6).alias("c"), (-m["near"]).alias("n"))
    best = v.withColumn("means", one).select("vec_id", F.array_max(F.transform("means", score)).alias("b"))
    return best.select("vec_id", (-F.col("b.n")).alias("near"), F.col("b.c").alias("cosine"))


def asked(c):
    """Whether a tool is one of the stated set of queries: its id is divisible by 20."""
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("long") % 20 == 0


def name_tokens(spark, d):
    """The set of name tokens of each tool that has any."""
    t = tools(spark, d, "tool_name").select("tool_id", F.array_sort(F.array_distinct(text.distractor_tokens(text.tool_name(F.col("tool_name"))))).alias("w"))
    return t.where(F.size("w") > 0)


def name_classes(t):
    """Distinct sets of name tokens, each with its smallest tool, number of tools and whether any tool of it is a query."""
    return t.groupBy("w").agg(F.min("tool_id").alias("tool_id"), F.count(F.lit(1)).alias("tools"), F.bool_or(asked("tool_id")).alias("asked"))


def d8_similar_names(spark, d):
    """Near misses by name: tools whose names have a Jaccard similarity of 0.7 or more with a query tool's (id divisible by 20).

    A prefix-filtered token join of classes (equal names are one): tokens by rising frequency, n - ceil(0.7 n) + 1 of them
    needed. A class is searched if any of its tools is a query; pairs of classes, and each class with itself, are then
    expanded to the query tools and tools that they hold.
    """
    t = name_tokens(spark, d)
    c = name_classes(t)
    df = c.select("tool_id", "w", "asked", F.explode("w").alias("t"))
    freq = df.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ordered = df.join(freq, "t").groupBy("tool_id", "w", "asked").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    keep = F.size("o") - F.ceil(F.round(0.7 * F.size("o"), 9)).cast("int") + 1
    pre = ordered.select("tool_id", "w", "asked", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).select("tool_id", "w", "asked", F.col("p.t").alias("t"))
    q = pre.where("asked").select(F.col("tool_id").alias("query_class"), F.col("w").alias("qw"), "t")
    pairs = q.join(pre.drop("asked"), "t").where("query_class <> tool_id").where(F.least(F.size("w"), F.size("qw")) >= 0.7 * F.greatest(F.size("w"), F.size("qw")))
    scored = pairs.withColumn("similarity", F.round(similarity.jaccard(F.col("w"), F.col("qw")), 4)).where("similarity >= 0.7")
    own = c.where("asked AND tools > 1").select(F.col("tool_id").alias("query_class"), F.col("tool_id").alias("class"), F.lit(1.0).alias("similarity"))
    links = scored.select("query_class", F.col("tool_id").alias("class"), "similarity").distinct().union(own)
    members = t.join(c.select("w", F.col("tool_id").alias("class")), "w").select("tool_id", "class")
    queries = members.where(asked("tool_id")).select(F.col("tool_id").alias("query_id"), F.col("class").alias("query_class"))
    return links.join(queries, "query_class").join(members, "class").where("query_id <> tool_id").select("query_id", "tool_id", "similarity")


def memory_kinds(spark, d):
    """The retrieval corpus: a row for each purpose, snippet, warning and argument description, by kind."""
    t = tools(spark, d, "tool_purpose", "doc_snippets", "usage_warnings", "arguments")
    none = F.array().cast("array<string>")
    texts = {"purpose": F.array("tool_purpose"), "doc": F.col("doc_snippets"), "warning": F.col("usage_warnings"), "argument": F.col("arguments.description")}
    kinds = F.map_from_arrays(F.array(*map(F.lit, texts)), F.array(*[F.coalesce(x, none) for x in texts.values()]))
    m = t.select("tool_id", F.explode(kinds).alias("kind", "texts")).select("tool_id", "kind", F.explode("texts").alias("text")).where("trim(text) <> ''")
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("tool_id").alias("tools"), F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))


def d13_adjacent(spark, d):
    """The first other tool of each tool's domain by id, else the first of all: two minima a domain, no pairs."""
    t = tools(spark, d, "domain").select("tool_id", typed_domain().alias("domain"))
    first = t.groupBy("domain").agg(F.min("tool_id").alias("first"))
    second = t.join(first, "domain").where("tool_id <> first").groupBy("domain").agg(F.min("tool_id").alias("second"))
    overall = t.agg(F.min("tool_id").alias("any")).scalar()
    j = t.join(first, "domain").join(second, "domain", "left").withColumn("any", overall)
    return j.select("tool_id", F.coalesce(F.when(F.col("tool_id") != F.col("first"), F.col("first")).otherwise(F.col("second")), F.when(F.col("any") != F.col("tool_id"), F.col("any"))).alias("adjacent"))


def source_summary(spark, d):
    """Tools, servers and the kinds of side effect of each source type."""
    return featured(spark, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("tools"), F.countDistinct("server_name").alias("servers"), F.array_join(F.sort_array(F.collect_set("side_effect_type")), ",").alias("effects"))


def warnings_given(spark, d):
    """How often each usage warning is given, the number of arguments in its text left out."""
    t = tools(spark, d, "usage_warnings").select("tool_id", F.explode("usage_warnings").alias("w")).where("w IS NOT NULL")
    return t.groupBy(F.regexp_replace("w", "[0-9]+", "#").alias("warning")).agg(F.count(F.lit(1)).alias("times"), F.countDistinct("tool_id").alias("tools"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and (k[0] in "bcdefhmn" and k[1:2].isdigit() or k.startswith("h_"))} | {"x_warnings": warnings_given, "x_sources": source_summary, "x_memory_kinds": memory_kinds}

M = lambda x: f"round(coalesce(avg(CAST({x} AS DOUBLE)), 0) + 1e-9::DOUBLE, 4)"
MARK = lambda ms, t="txt": "(" + " OR ".join([f"regexp_matches({t}, '(^|[^a-z0-9])({'|'.join(m for m in ms if ' ' not in m)})([^a-z0-9]|$)')"] + [f"contains({t}, '{m}')" for m in ms if " " in m]) + ")"
FIRST = lambda rules, default, t: "CASE " + " ".join(f"WHEN {MARK(m, t)} THEN '{x}'" for x, m in rules) + f" ELSE {default} END"
ARGS = lambda c: f"coalesce(len(list_filter(arguments, lambda a: {c})), 0)"
COLLAPSE = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
NAME = lambda x: f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
DIST = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda x: length(x) > 1)"
RETR = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_./*?-]+')"
TYPED = lambda t: f"""regexp_matches(pj, '"type":("{t}"|\\[[^\\]]*"{t}")')"""
ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in [*((x, x) for x in tf.CANONICAL), *tf.ALIASES.items()]) + "}"
PLAIN = "replace(trim(regexp_replace(replace(lower(domain), '_', ' '), '\\s+', ' ', 'g')), ' / ', '/')"
FEAT = f"""WITH RECURSIVE {TOOLS}, {SCHEMAS}, f0 AS (SELECT *, {COLLAPSE('tool_purpose')} AS purpose, {NAME('tool_name')} AS normalized_name, lower(coalesce(tool_name, '') || ' ' || coalesce(tool_purpose, '')) AS said,
  CASE json_type(j, '$.properties') WHEN 'OBJECT' THEN json_keys(j, '$.properties') ELSE [] END AS ks, CASE json_type(j, '$.required') WHEN 'ARRAY' THEN json_extract_string(j, '$.required[*]') ELSE [] END AS rq,
  CASE json_type(j, '$.properties') WHEN 'OBJECT' THEN json_extract(j, '$.properties')::VARCHAR ELSE '' END AS pj,
  coalesce({ALIAS}[{PLAIN}], {ALIAS}[replace({PLAIN}, ' ', '_')], nullif(trim(domain), '')) AS canonical FROM sj),
f1 AS (SELECT *, len(ks) AS num_arguments, len(list_filter(ks, lambda k: list_contains(rq, k))) AS num_required, len(regexp_extract_all(j::VARCHAR, '"enum":\\[')) AS num_enum, {TYPED('array')} AS has_array, {TYPED('object')} AS has_object,
  {TYPED('boolean')} AS has_boolean, {TYPED('string')} AS has_string, length(purpose) AS documentation_length,
  len(list_filter(ks, lambda k: json_type(j, '$.properties."' || k || '"') = 'OBJECT' AND coalesce(json_extract_string(j, '$.properties."' || k || '".description'), '') = '')) AS undescribed,
  {ARGS("coalesce(a.description, '') <> ''")} AS described, coalesce(len(arguments), 0) AS listed, lower(coalesce(canonical, 'general')) || ' ' || said AS acting,
  lower(coalesce(source_type, '') || ' ' || coalesce(server_name, '') || ' ' || coalesce(tool_name, '') || ' ' || coalesce(tool_purpose, '')) AS placed FROM f0),
f2 AS (SELECT *, {FIRST(tf.SIDE_EFFECTS, "'unknown'", 'acting')} AS side_effect_type, {FIRST(tf.DOMAINS, "CASE WHEN starts_with(source_type, 'bfcl') THEN 'math/data processing' ELSE 'general' END", 'placed')} AS inferred_domain, {MARK(tf.AUTH, 'lower(purpose)')} AS auth_required,
  round(least(1, CASE WHEN documentation_length < 80 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN num_arguments = 0 THEN 0.35::DOUBLE WHEN undescribed > 0 THEN least(0.35::DOUBLE, 0.1::DOUBLE + 0.25::DOUBLE * undescribed / num_arguments) ELSE 0 END
    + CASE WHEN coalesce(json_type(j, '$.additionalProperties') = 'BOOLEAN' AND json_extract_string(j, '$.additionalProperties') = 'false', false) THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN num_enum = 0 AND has_string THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN num_arguments >= 5 THEN 0.1::DOUBLE ELSE 0 END) + 1e-9::DOUBLE, 4) AS ambiguity,
  round(least(1, CASE WHEN documentation_length > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN coalesce(len(doc_snippets), 0) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN listed > 0 THEN 0.4::DOUBLE * described / listed ELSE 0 END) + 1e-9::DOUBLE, 4) AS completeness FROM f1),
ft AS (SELECT *, CASE WHEN has_object OR has_array OR num_enum > 0 OR side_effect_type IN ('write', 'delete', 'execute', 'external_communication') OR ambiguity >= 0.45 OR regexp_matches(said, 'similar|variant|mode|filter|selector') OR num_arguments > 5 THEN 'hard'
  WHEN num_arguments BETWEEN 3 AND 5 OR num_arguments > num_required THEN 'medium' ELSE 'easy' END AS difficulty, coalesce(canonical, inferred_domain) AS resolved_domain,
  coalesce(nullif(trim(regexp_replace(lower(coalesce(domain, '')), '\\s+', ' ', 'g')), ''), 'general') AS clean_domain FROM f2)"""
#: kj: tools with a text c that is equal for schemas that are one JSON value: their (path, leaf) pairs in order.
CANON = f"""WITH {TOOLS}, {SCHEMAS}, tr AS (SELECT tool_id, unnest(list_transform(list_zip(t.k, t.v, t.y), lambda x: x)) AS x FROM (SELECT tool_id, (SELECT {{'k': list(fullkey ORDER BY fullkey), 'v': list(CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE value::VARCHAR END ORDER BY fullkey), 'y': list(type ORDER BY fullkey)}} FROM json_tree(j)) AS t FROM sj)),
kt AS (SELECT tool_id, list(x[1] || '=' || x[2] ORDER BY x[1]) AS c FROM tr GROUP BY 1), kj AS (SELECT tl.tool_id, tl.tool_name, coalesce(kt.c, []) AS c FROM tl LEFT JOIN kt USING (tool_id))"""
W = f"WITH {TOOLS}"
NAMES = f"{W}, nw AS (SELECT tool_id, w FROM (SELECT tool_id, list_sort(list_distinct({DIST(NAME('tool_name'))})) AS w FROM tl) WHERE len(w) > 0)"
SQL = {
    "b1_normalized": f"{FEAT} SELECT tool_id, normalized_name, purpose[1:180] AS summary, documentation_length, array_to_string(list_transform(string_split(replace(normalized_name, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM ft WHERE normalized_name <> '' AND documentation_length > 0",
    "b4_complexity": f"{FEAT} SELECT tool_id, num_arguments, num_required, num_arguments - num_required AS num_optional, num_enum, has_object, has_array, has_boolean, documentation_length FROM ft",
    "b7_ambiguity": f"{FEAT} SELECT tool_id, ambiguity, completeness FROM ft",
    "b9_inferred_domain": f"{FEAT} SELECT tool_id, inferred_domain FROM ft",
    "b11_source_category": f"{FEAT} SELECT source_type AS source_category, count(*) AS tools FROM ft GROUP BY 1",
    "b12_side_effect": FEAT + " SELECT tool_id, side_effect_type, auth_required, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for x, c in (("writes_data", "contains(said, 'write')"), ("creates_resource", "contains(said, 'create')"), ("deletes_resource", "contains(said, 'delete') OR contains(said, 'remove')"), ("moves_resource", "contains(said, 'move') "), ("updates_resource", "contains(said, 'update')"), ("external_communication", "contains(said, 'send')"), ("executes_code", "contains(said, 'execute') OR contains(said, 'run')"))) + "], lambda x: x IS NOT NULL), ',') AS hints FROM ft",
    "b13_difficulty": f"{FEAT} SELECT side_effect_type, difficulty, count(*) AS tools FROM ft GROUP BY 1, 2",
    "b19_ambiguity_flags": f"{FEAT} SELECT flag, count(*) AS tools FROM (SELECT unnest([CASE WHEN documentation_length = 0 THEN 'missing_tool_description' END, CASE WHEN num_arguments = 0 THEN 'empty_input_schema' END, CASE WHEN undescribed > 0 THEN 'missing_argument_description' END]) AS flag FROM ft) WHERE flag IS NOT NULL GROUP BY 1",
    "b33_tokens": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) AS tokens, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS blank_words FROM documents",
    "b33_tokens_by_kind": r"SELECT doc_kind, coalesce(lang, 'unknown') AS lang, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, max(t) AS longest FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) AS t FROM documents) GROUP BY 1, 2",
    "c23_violations": W + " ".join(f"{'' if i == 0 else 'UNION ALL'} SELECT '{c}' AS field, count(*) AS missing FROM tl WHERE trim(coalesce({c}, '')) = ''" for i, c in enumerate(("tool_name", "tool_purpose", "server_name", "domain"))),
    "e7_dataset_stats": f"{FEAT} SELECT source_type, resolved_domain AS domain, side_effect_type, count(*) AS tools, count(DISTINCT server_name) AS servers, {M('num_arguments')} AS avg_arguments, {M('ambiguity')} AS avg_ambiguity FROM ft GROUP BY 1, 2, 3",
    "e8_domain_complexity": f"{FEAT} SELECT resolved_domain AS domain, count(*) AS tools, {M('num_arguments')} AS avg_arguments, {M('num_required')} AS avg_required, count_if(has_object) AS nested, count_if(has_array) AS arrays, CAST(sum(num_enum) AS BIGINT) AS enums, {M('documentation_length')} AS avg_doc, count_if(difficulty = 'hard') AS hard FROM ft GROUP BY 1",
    "e9_difficulty_by_domain": f"{FEAT} SELECT inferred_domain, difficulty, count(*) AS tools, count_if(auth_required) AS auth FROM ft GROUP BY 1, 2",
    "e10_histograms": FEAT + " UNION ALL ".join(f" SELECT '{c}' AS column_name, {c} AS value, count(*) AS tools FROM ft GROUP BY 2" for c in ("side_effect_type", "difficulty", "source_type", "inferred_domain")),
    "e30_document_frequency": f"SELECT token, count(*) AS documents FROM (SELECT unnest(list_distinct({RETR('text')})) AS token FROM documents) GROUP BY 1",
    "f23_top_terms": f"{W} SELECT token, count(*) AS tools FROM (SELECT unnest(list_distinct({DIST('tool_name')})) AS token FROM tl) GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 32",
    "f1_dedupe": f"{CANON} SELECT {NAME('tool_name')} AS name, min(tool_id) AS tool_id, count(*) AS copies FROM kj GROUP BY 1, c",
    "b3_schema_hash": f"{CANON} SELECT min(tool_id) AS first_tool, count(*) AS tools FROM kj GROUP BY c HAVING count(*) > 1",
    "b8_domains": f"{FEAT} SELECT resolved_domain, canonical IS NULL AS inferred, count(*) AS tools FROM ft GROUP BY 1, 2",
    "f3_source_cap": f"{W} SELECT source_type, tool_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY tool_id) AS rank FROM tl) WHERE rank <= 50",
    "f4_fraction_cap": f"{W}, k AS (SELECT floor(0.1::DOUBLE * count(*) / 0.9::DOUBLE) AS cap FROM tl WHERE source_type <> 'handwritten') SELECT tool_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type = 'handwritten' ORDER BY tool_id) AS r FROM tl) WHERE source_type IS DISTINCT FROM 'handwritten' OR r <= (SELECT cap FROM k)",
    "f9_shuffled": f"{W} SELECT tool_id FROM tl ORDER BY md5('42|' || tool_id) LIMIT 100",
    "f18_round_robin": f"{FEAT} SELECT tool_id FROM (SELECT *, row_number() OVER (PARTITION BY source_type, side_effect_type ORDER BY md5('7|' || tool_id)) AS rank FROM ft) ORDER BY rank, source_type, side_effect_type LIMIT 60",
    "f20_shards": f"{W} SELECT ('0x' || md5(tool_id)[1:8])::BIGINT % 8 AS shard, count(*) AS tools FROM tl GROUP BY 1",
    "h_tokenizers": f"{W} SELECT tool_id, len({DIST('tool_purpose')}) AS distractor, len({RETR('tool_purpose')}) AS retrieval, len(list_distinct({RETR('tool_purpose')})) AS distinct_retrieval, md5(trim(regexp_replace(regexp_replace(lower(coalesce(tool_purpose, '')), '[_./:-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS routing_text FROM tl",
    "h11_slugs": f"{W} SELECT tool_id, CASE WHEN length(n) <= 24 THEN n ELSE n[1:15] || '_' || sha1(n)[1:8] END AS slug FROM (SELECT tool_id, {NAME('tool_name')} AS n FROM tl)",
    "m2_cosine": """WITH m AS (SELECT label AS near, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
      c AS (SELECT vec_id, near, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS cosine FROM embeddings, m) SELECT vec_id, near, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, near) AS r FROM c) WHERE r = 1""",
    "d8_similar_names": f"{NAMES} SELECT query_id, tool_id, s AS similarity FROM (SELECT a.tool_id AS query_id, b.tool_id, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 4) AS s FROM nw a, nw b WHERE a.tool_id <> b.tool_id AND regexp_extract(a.tool_id, '([0-9]+)$', 1)::BIGINT % 20 = 0) WHERE s >= 0.7",
    "x_memory_kinds": f"""{W}, mm AS (SELECT tool_id, 'purpose' AS kind, tool_purpose AS txt FROM tl UNION ALL SELECT tool_id, 'doc', unnest(doc_snippets) FROM tl UNION ALL SELECT tool_id, 'warning', unnest(usage_warnings) FROM tl
      UNION ALL SELECT tool_id, 'argument', a.description FROM (SELECT tool_id, unnest(arguments) AS a FROM tl))
      SELECT kind, count(*) AS rows, count(DISTINCT tool_id) AS tools, CAST(sum(len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM mm WHERE trim(txt) <> '' GROUP BY 1""",
    "d13_adjacent": f"{FEAT} SELECT a.tool_id, coalesce((SELECT min(b.tool_id) FROM ft b WHERE b.clean_domain = a.clean_domain AND b.tool_id <> a.tool_id), (SELECT CASE WHEN min(b.tool_id) <> a.tool_id THEN min(b.tool_id) END FROM ft b)) AS adjacent FROM ft a",
    "x_sources": f"{FEAT} SELECT source_type, count(*) AS tools, count(DISTINCT server_name) AS servers, array_to_string(list_sort(list(DISTINCT side_effect_type)), ',') AS effects FROM ft GROUP BY 1",
    "x_warnings": f"{W} SELECT regexp_replace(w, '[0-9]+', '#', 'g') AS warning, count(*) AS times, count(DISTINCT tool_id) AS tools FROM (SELECT tool_id, unnest(usage_warnings) AS w FROM tl) WHERE w IS NOT NULL GROUP BY 1",
}
