"""Arguments of calls as canonical members, their comparison, and the flattening of nested result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.text import collapsed, normalized_path


def canonical(key: Column, value: Column) -> Column:
    """The text of a variant value: members in order, 1.0 as 1, blanks of strings collapsed, paths normalised.

    A string is a path if its member is named like one or if it is written like one; strings within lists and objects stay as
    they are.
    """
    s = F.try_variant_get(value, "$", "string")
    path = F.lower(key).rlike("path|file|dir|folder") | s.contains("\\") | s.startswith("./") | s.startswith("../")
    quoted = F.to_json(F.array(F.when(path, normalized_path(s)).otherwise(collapsed(s))))
    return F.when(F.schema_of_variant(value) == "STRING", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.to_json(value))


def member(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), canonical(key, value).alias("value"))


def members(text: Column) -> Column:
    """Members of a JSON object in order of their names; null if the text is no object."""
    found = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.array_sort(F.transform(F.map_keys(found), lambda k: member(k, F.element_at(found, k))))


def matches(predicted: Column, expected: Column, defaults: Column) -> Column:
    """Equality of members; one that only repeats its default may be missing from the expected ones."""
    keys = F.transform(expected, lambda e: e["key"])
    return F.filter(predicted, lambda p: ~(F.array_contains(defaults, p) & ~F.array_contains(keys, p["key"]))) == expected


def first_present(record: Column, paths: list[str]) -> Column:
    """The number at the first of the paths that is there; one that can't be read as a number gives null and ends the search."""
    out = F.lit(None).cast("double")
    for p in reversed(paths):
        out = F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.try_variant_get(record, p, "double")).otherwise(out)
    return out


LATENCY = ["$.prediction_latency_ms", "$.latency_ms", "$.duration_ms", "$.prediction_metadata.prediction_latency_ms", "$.prediction_metadata.latency_ms"]
TOKENS = ["$.token_overhead_estimate", "$.token_overhead", "$.prompt_tokens", "$.total_tokens", "$.prediction_metadata.token_overhead_estimate", "$.prediction_metadata.prompt_tokens", "$.prediction_metadata.total_tokens"]


def parse_ok(record: Column) -> Column:
    """Whether the call of a record (variant) could be read: a right abstention, or arguments that are an object and no error."""
    flag = lambda p: F.try_variant_get(record, p, "boolean")
    abstained = F.coalesce(~flag("$.should_trigger") & ~flag("$.triggered"), F.lit(False))
    failed = F.coalesce(~flag("$.argument_parse_ok"), F.lit(False)) | F.try_variant_get(record, "$.parse_error", "variant").isNotNull() | F.coalesce(F.try_variant_get(record, "$.error", "string") == "argument_parse_error", F.lit(False))
    return abstained | (~failed & F.coalesce(F.schema_of_variant(F.try_variant_get(record, "$.predicted_arguments", "variant")).startswith("OBJECT"), F.lit(False)))


def flattened(df: DataFrame, record: str = "item") -> DataFrame:
    """A row for each behaviour result within reliability records (variant), with condition, tool and tokens of its record; records without results give none."""
    v = F.col(record)
    at = lambda x, *paths: F.coalesce(*[F.try_variant_get(x, f"$.{p}", "string") for p in paths])
    rows = df.select(
        F.coalesce(at(v, "condition", "baseline_name"), F.lit("default")).alias("baseline_name"), at(v, "tool_name").alias("own_tool"), F.try_variant_get(v, "$.reliability_score.features.token_overhead_estimate", "double").alias("token_overhead_estimate"),
        F.explode(F.try_variant_get(v, "$.behavior_report.results", "array<variant>")).alias("r"),
    ).where(F.schema_of_variant("r").startswith("OBJECT"))
    r = F.col("r")
    return rows.select("baseline_name", F.coalesce(at(r, "tool_name"), "own_tool").alias("tool_name"), at(r, "case_id", "task_id").alias("task_id"), F.lit("behavior").alias("record_type"), "token_overhead_estimate", F.try_variant_get(r, "$.triggered", "boolean").alias("triggered"), F.try_variant_get(r, "$.should_trigger", "boolean").alias("should_trigger"))
