"""Queries on nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.operators import inlining


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inlining.nodes(spark.read.parquet(f"{sf_dir}/tools.parquet"))


def p5_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type is used at each depth of the schemas; the depth is kept beside the types, so schemas are parsed once."""
    rows = inlining.parsed(inlining.sources(spark.read.parquet(f"{sf_dir}/tools.parquet")), ["depth", "type"])
    return rows.select("depth", F.explode("type").alias("type")).groupBy("depth", "type").agg(F.count(F.lit(1)).alias("nodes"))


def b5_schema_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tool's schema: nodes below the root, depth, enumerations at any level, and whether a type occurs below the root."""
    rows = inlining.parsed(inlining.sources(spark.read.parquet(f"{sf_dir}/tools.parquet")), ["tool_id", "parent_path", "depth", "enum", "type"])
    below = F.col("parent_path").isNotNull()
    has = lambda t: F.bool_or(below & F.array_contains("type", t)).alias(f"has_{t}")
    return rows.groupBy("tool_id").agg(F.count_if(below).alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.size("enum") > 0).alias("enums"), has("object"), has("array"), has("boolean"))


QUERIES = {"p5_found": p5_found, "p5_node_types": p5_node_types, "b5_schema_shapes": b5_schema_shapes}

PART = lambda m: f"""CASE json_type(j, '$.{m}') WHEN 'ARRAY' THEN list_transform(range(0, json_array_length(j, '$.{m}')::BIGINT), lambda i: {{'s': '.{m}[' || i || ']', 'j': json_extract(j, '$.{m}[' || i || ']')}}) ELSE [] END"""
TREE = f"""WITH RECURSIVE tl AS (SELECT DISTINCT ON (tool_id) tool_id, input_schema_raw AS s, arguments FROM tools ORDER BY tool_id, collected_at DESC),
u AS (SELECT *, CASE WHEN json_valid(s) THEN CASE json_type(s) WHEN 'OBJECT' THEN s WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(s, '$')) AND json_type(json_extract_string(s, '$')) = 'OBJECT' THEN json_extract_string(s, '$') END END END AS good,
  '{{"type":"object","properties":{{' || array_to_string(list_transform(arguments, lambda a: to_json(a.name) || ':{{' || concat_ws(',', '"type":' || coalesce(to_json(a.type), 'null'), CASE WHEN a.enum IS NOT NULL THEN '"enum":' || to_json(a.enum) END, CASE WHEN json_valid(a.items_schema) THEN '"items":' || a.items_schema END, CASE WHEN json_valid(a.properties) THEN '"properties":' || a.properties END) || '}}'), ',') || '}}}}' AS built FROM tl),
n AS (SELECT tool_id, '$' AS node_path, NULL::VARCHAR AS parent_path, 0 AS depth, coalesce(good, built, '{{"type":"object"}}')::JSON AS j FROM u
  UNION ALL SELECT tool_id, node_path || c.s, node_path, depth + 1, c.j FROM (SELECT tool_id, node_path, depth, unnest(list_concat(
    CASE json_type(j, '$.properties') WHEN 'OBJECT' THEN list_transform(json_keys(j, '$.properties'), lambda k: {{'s': '.properties.' || k, 'j': json_extract(j, '$.properties."' || k || '"')}})
      WHEN 'ARRAY' THEN list_transform(list_filter(range(0, json_array_length(j, '$.properties')::BIGINT), lambda i: json_type(j, '$.properties[' || i || '].name') = 'VARCHAR'), lambda i: {{'s': '.properties.' || json_extract_string(j, '$.properties[' || i || '].name'), 'j': json_extract(j, '$.properties[' || i || ']')}}) ELSE [] END,
    CASE json_type(j, '$.items') WHEN 'OBJECT' THEN [{{'s': '.items', 'j': json_extract(j, '$.items')}}] ELSE {PART("items")} END, {PART("anyOf")}, {PART("oneOf")}, {PART("allOf")})) AS c FROM n))"""
HAS = "coalesce(bool_or(parent_path IS NOT NULL AND (json_extract_string(j, '$.type') = '{t}' OR list_contains(json_extract_string(j, '$.type[*]'), '{t}'))), false) AS has_{t}"
SQL = {
    "p5_found": f"{TREE} SELECT DISTINCT tool_id, node_path, parent_path FROM n WHERE parent_path IS NOT NULL",
    "p5_node_types": f"{TREE}, k AS (SELECT depth, json_extract_string(j, '$.type') AS type FROM n WHERE json_type(j, '$.type') = 'VARCHAR' UNION ALL SELECT depth, unnest(json_extract_string(j, '$.type[*]')) FROM n WHERE json_type(j, '$.type') = 'ARRAY') SELECT depth, type, count(*) AS nodes FROM k GROUP BY 1, 2",
    "b5_schema_shapes": f"""{TREE} SELECT tool_id, count_if(parent_path IS NOT NULL) AS nodes, max(depth) AS depth, count_if(coalesce(json_array_length(j, '$.enum'), 0) > 0) AS enums, {HAS.format(t="object")}, {HAS.format(t="array")}, {HAS.format(t="boolean")} FROM n GROUP BY 1""",
}
