"""Incremental scoring: new record files are normalised once and appended; batch resume by anti-join; windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callmetrics.plans.views import normalized

RECORD = """record_id long, task_id string, tool_name string, baseline_name string, model_slug string, should_trigger boolean, triggered boolean, selected_tool_name string,
exact_match boolean, argument_validity double, required_argument_recall double, hallucinated_args array<string>, joint_exact_match boolean, latency_ms double, prompt_tokens int, created_at timestamp, ingested_at timestamp"""


def scored(spark: SparkSession, source: str, delay: str = "7 days") -> DataFrame:
    """Normalised records of the files that come into a directory, complete duplicates within ``delay`` dropped."""
    rows = spark.readStream.schema(RECORD).json(source).withWatermark("ingested_at", delay)
    return normalized(rows.dropDuplicatesWithinWatermark(["record_id"]))


def run_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Takes in what is there and ends; the next call goes on from there, as the checkpoint in shared storage says."""
    return scored(spark, source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a plan without a result yet: resuming a batch."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and window of time; events later than ``late`` are dropped. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")
