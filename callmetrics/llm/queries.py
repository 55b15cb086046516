"""The pN_ queries of this subpackage: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import canonical_list, formatting, groups, leakage, overlap, packing, subjects


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.copies(table(spark, sf_dir, "tools"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed(table(spark, sf_dir, "tools"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation and training rows of eval_tasks; a null split is neither."""
    tasks, split = table(spark, sf_dir, "eval_tasks"), F.trim(F.lower("split"))
    return tasks.where(~split.startswith("train")), tasks.where(split.startswith("train"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.cross_pairs(*sides(spark, sf_dir), "task_id", "user_request")
    return pairs.select(F.least("left_id", "right_id").alias("task_a"), F.greatest("left_id", "right_id").alias("task_b")).distinct()


def p2_by_split_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records, and those of them that stand in the training split, per split and source."""
    held, train = sides(spark, sf_dir)
    hit = overlap.cross_counts(held, train, "task_id", "user_request").select(F.col("id").alias("task_id"), "links")
    held = held.select("task_id", F.trim(F.lower("split")).alias("split"), "source").distinct()
    return (
        held.join(hit, "task_id", "left")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("links").alias("leaked"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    )


def domain_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = table(spark, sf_dir, "tools").select("tool_id", F.col("domain").alias("v"))
    listed = table(spark, sf_dir, "domain_list").select(F.col("domain_id").alias("id"), F.col("domain_name").alias("name"), "aliases")
    return values, listed


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, listed = domain_values(spark, sf_dir)
    return spark.sql(
        r"SELECT DISTINCT a.tool_id, coalesce(m.id, 0L) AS domain_id FROM {a} a LEFT JOIN (SELECT v AS known, id FROM {m}) m ON a.v = m.known WHERE a.v RLIKE '[^\\s\\pZ]' AND a.tool_id IS NOT NULL",
        a=values, m=canonical_list.mapped(values, listed),
    )


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, listed = domain_values(spark, sf_dir)
    none = canonical_list.unmatched(values, canonical_list.mapped(values, listed))
    return spark.sql("SELECT a.v AS domain, count(DISTINCT a.tool_id) AS records FROM {a} a LEFT SEMI JOIN (SELECT v AS none FROM {n}) ON a.v = none GROUP BY a.v", a=values, n=none)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = overlap.near_pairs(table(spark, sf_dir, "eval_tasks"), "task_id", "user_request")
    snippets = table(spark, sf_dir, "tools").select("tool_id", F.array_join("doc_snippets", " ").alias("snippets"))
    tools = overlap.near_pairs(snippets, "tool_id", "snippets")
    return requests.select(F.lit("request").alias("kind"), "*").union(tools.select(F.lit("tool").alias("kind"), "*"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and group of each record that is near another, of both kinds."""
    requests = groups.near_groups(table(spark, sf_dir, "eval_tasks"), "task_id", "user_request")
    snippets = table(spark, sf_dir, "tools").select("tool_id", F.array_join("doc_snippets", " ").alias("snippets"))
    tools = groups.near_groups(snippets, "tool_id", "snippets")
    return requests.select(F.lit("request").alias("kind"), "*").union(tools.select(F.lit("tool").alias("kind"), "*"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the packing had to split."""
    return p6_packed(spark, sf_dir).where("token_start > 0").select("doc_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def classified(spark: SparkSession, sf_dir: str, calibrate: bool) -> DataFrame:
    return subjects.classified(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")), calibrate=calibrate)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir, True).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, mean share of sentences and expected number of annotators' namings by subject."""
    return classified(spark, sf_dir, True).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.avg("share").alias("mean_share"), F.sum("posterior").alias("expected"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
