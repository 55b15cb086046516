"""Connected groups of near texts: labels spread by alternating large-star and small-star steps over the links between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm import overlap
from callmetrics.llm.storage import checkpointed

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the smallest node of its component.

    Each round is a grouped minimum and a join: a large-star step links a node's larger neighbours with its smallest one, a
    small-star step its smaller ones. Nothing is gathered: a node with many neighbours is an aggregate and a join key that
    adaptive execution splits. Rounds grow with the logarithm of the size; the lineage is cut after each.
    """
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("a", "b", "m")
        new = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = checkpointed(new)
        if new.count() == edges.count() and not new.exceptAll(edges).limit(1).count():
            break
        edges = new
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", share: float = overlap.SHARE, least: int = overlap.LEAST_WORDS) -> DataFrame:
    """(id, class_id, group_id, links) of each record that is near another one.

    Records with the same bag of words are one class, named by its smallest id; ``links`` counts the other classes its class
    is near to; ``group_id`` is the smallest class of those connected by links. Copies aren't paired with one another, so a
    group of copies costs no more than its rows. Nulls, short texts, repeated rows and empty tables as in ``near_pairs``.
    """
    df = overlap.records(df, id_col, text_col)
    m = overlap.members(df, least).distinct()
    c = m.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    named = lambda x, y: c.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("class_id").alias(y))
    links = overlap.class_links(df, share, least).join(named("a", "a"), ["a1", "a2"]).join(named("b", "b"), ["b1", "b2"]).select("a", "b")
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    roots = components(links).select(F.col("node").alias("class_id"), "root")
    out = m.join(c, ["c1", "c2"]).join(degree, "class_id", "left").join(roots, "class_id", "left")
    out = out.where("copies > 1 OR links > 0")
    return out.select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
