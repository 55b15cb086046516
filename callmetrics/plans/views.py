"""The input tables as relations of records, and the same relations in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABSTAIN = "__abstain__"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tools(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a tool_id (deliveries differ only in collected_at)."""
    return read(spark, sf_dir, "tools").select("tool_id", *columns).dropDuplicates(["tool_id"])


def tasks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a task_id (deliveries differ only in ingested_at)."""
    return read(spark, sf_dir, "eval_tasks").select("task_id", *columns).dropDuplicates(["task_id"])


def normalized(df: DataFrame) -> DataFrame:
    """Prediction records with their defaults: missing condition, trigger flags and tool names filled, correctness derived."""
    should = F.coalesce("should_trigger", F.lit(True))
    df = df.withColumns({"baseline_name": F.coalesce(F.nullif(F.trim(F.lower("baseline_name")), F.lit("")), F.lit("default")), "should_trigger": should})
    df = df.withColumn("triggered", F.coalesce("triggered", "should_trigger"))
    abstained = F.when(F.col("triggered"), F.col("tool_name")).otherwise(ABSTAIN)
    df = df.withColumns({
        "expected_tool_name": F.when(F.col("should_trigger"), F.col("tool_name")).otherwise(ABSTAIN),
        "selected_tool_name": F.coalesce(F.nullif(F.col("selected_tool_name"), F.lit("")), abstained),
        "argument_schema_valid": (~F.col("should_trigger") & ~F.col("triggered")) | ((F.coalesce(F.size("hallucinated_args"), F.lit(0)) <= 0) & (F.coalesce("argument_validity", F.lit(0.0)) >= 1.0)),
        "argument_exact_match": F.when(F.col("should_trigger"), F.coalesce("exact_match", F.lit(False))).otherwise(~F.col("triggered")),
        "harmful_injection": ~F.col("should_trigger") & F.col("triggered"),
    })
    df = df.withColumn("tool_selection_correct", F.coalesce(F.col("selected_tool_name") == F.col("expected_tool_name"), F.lit(False)))
    return df.withColumn("joint_exact_match", F.col("tool_selection_correct") & F.col("argument_exact_match"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised prediction records, complete duplicates dropped."""
    return normalized(read(spark, sf_dir, "predictions").dropDuplicates(["record_id"]))


TOOLS = "tl AS (SELECT DISTINCT ON (tool_id) * FROM tools ORDER BY tool_id)"
#: sj: tools with their schema j, an object: the text, unwrapped once if it is JSON in a JSON string, else rebuilt from the arguments.
SCHEMAS = """s0 AS (SELECT *, input_schema_raw AS s FROM tl), s1 AS (SELECT *, CASE WHEN json_valid(s) THEN CASE json_type(s) WHEN 'OBJECT' THEN s WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(s, '$')) AND json_type(json_extract_string(s, '$')) = 'OBJECT' THEN json_extract_string(s, '$') END END END AS good,
  '{"type":"object","properties":{' || array_to_string(list_transform(arguments, lambda a: to_json(a.name) || ':{' || concat_ws(',', CASE WHEN a.type IS NOT NULL THEN '"type":' || to_json(a.type) END, CASE WHEN a.description IS NOT NULL THEN '"description":' || to_json(a.description) END, CASE WHEN a.enum IS NOT NULL THEN '"enum":' || to_json(a.enum) END,
    CASE WHEN json_valid(a.items_schema) THEN '"items":' || a.items_schema END, CASE WHEN json_valid(a.properties) THEN '"properties":' || a.properties END) || '}'), ',') || '},"required":' || to_json(list_transform(list_filter(arguments, lambda a: a.required), lambda a: a.name)) || '}' AS built FROM s0),
sj AS (SELECT * EXCLUDE (s, good, built), json(coalesce(good, built, '{"type":"object"}')) AS j FROM s1)"""
TASKS = "ev AS (SELECT DISTINCT ON (task_id) * FROM eval_tasks ORDER BY task_id)"
PREDICTIONS = """
p0 AS (SELECT DISTINCT ON (record_id) * FROM predictions ORDER BY record_id),
p1 AS (SELECT * REPLACE (coalesce(nullif(trim(lower(baseline_name)), ''), 'default') AS baseline_name, coalesce(should_trigger, true) AS should_trigger,
                         coalesce(triggered, should_trigger, true) AS triggered) FROM p0),
p2 AS (SELECT * REPLACE (coalesce(nullif(selected_tool_name, ''), CASE WHEN triggered THEN tool_name ELSE '__abstain__' END) AS selected_tool_name),
         CASE WHEN should_trigger THEN tool_name ELSE '__abstain__' END AS expected_tool_name,
         (NOT should_trigger AND NOT triggered) OR (coalesce(len(hallucinated_args), 0) = 0 AND coalesce(argument_validity, 0) >= 1) AS argument_schema_valid,
         CASE WHEN should_trigger THEN coalesce(exact_match, false) ELSE NOT triggered END AS argument_exact_match,
         NOT should_trigger AND triggered AS harmful_injection FROM p1),
p3 AS (SELECT *, coalesce(selected_tool_name = expected_tool_name, false) AS tool_selection_correct FROM p2),
pr AS (SELECT * REPLACE (tool_selection_correct AND argument_exact_match AS joint_exact_match) FROM p3)"""
