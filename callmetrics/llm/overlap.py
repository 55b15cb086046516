"""Pairs of texts that share most of their words, as multisets, without a false negative.

Two texts of ``n >= m`` words are near if the words in common number at least ``share * n``. Seen as sparse bit vectors
(a bit for each word and occurrence), near texts lie within a radius of one another: at most ``r(n) = n - ceil(share n)``
bits of either vector are missing from the other.

Covering family. The universe of bits is cut into blocks and each table keeps one block (a structured mask). A pair
within the radius differs in at most ``r`` blocks on either side, so of the first ``r + 1`` non-empty blocks of a text, in
an order all texts share, at least one is common: every near pair collides in some table. With one bit a block this is
also the necessary prefix of an exact prefix filter; the order is that of rising corpus frequency, so tables are keyed on
the rarest words.

In a table, pairs must pass three bounds, none of which loses a near pair: on the lengths; on the positions (the first word
in common leaves at most the words from there on); and on the parities (each row carries 104 parity bits of its whole
vector, and those of two texts differ in at most as many bits as the vectors do). What is left is verified on the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.words import WORD, bag_id, frequent, mix, ordered_tokens, words

SHARE = 0.75
LEAST_WORDS = 8
#: Lengths stand in 24 bits; texts of more words (16 million) are held against each other without the bounds.
LONGEST = 0xFFFFFF


def needed(n: np.ndarray, share: float) -> np.ndarray:
    """Words a text of ``n`` must have in common with one no longer than itself."""
    return np.ceil(np.round(share * n, 9)).astype(np.int64)


def table_rows(lists: pa.Array, listed: np.ndarray, rank: np.ndarray, share: float, extra: int = 0) -> tuple[np.ndarray, ...]:
    """Of each text (a list of word hashes): its length, two words of parities, its keys and the keys' offsets."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    tokens = ordered_tokens(values, row, listed, rank)
    bits = mix(tokens)
    low = np.left_shift(np.uint64(1), bits & np.uint64(63))
    low[(bits >> np.uint64(6)) & np.uint64(1) == 1] = 0
    high = np.left_shift(np.uint64(1), np.uint64(24) + (bits & np.uint64(63)) % np.uint64(40))
    high[(bits >> np.uint64(6)) & np.uint64(1) == 0] = 0
    p1, p2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(tokens):
        full = np.flatnonzero(n)
        p1[full] = np.bitwise_xor.reduceat(low, offsets[full])
        p2[full] = np.bitwise_xor.reduceat(high, offsets[full])
    p2 |= np.minimum(n, LONGEST).astype(np.uint64)
    keep = np.minimum(n, n - needed(n, share) + 1 + extra)
    first = (np.arange(len(tokens)) - offsets[row]) < keep[row]
    return n, p1.view(np.int64), p2.view(np.int64), tokens[first].view(np.int64), np.r_[0, np.cumsum(keep)]


def classes(df: DataFrame, order, share: float, least: int) -> DataFrame:
    """One row for each distinct bag of words: rid (names one row of it), p1, p2 (parities, length), keys."""
    order = df.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # copies within a batch are combined here, before any shuffle
            heads = pd.DataFrame({"i": b["rid"].to_numpy(), "a": b["c1"].to_numpy(), "b": b["c2"].to_numpy()}).sort_values("i")
            b = b.take(pa.array(heads.index[~heads.duplicated(["a", "b"])].to_numpy()))
            n, p1, p2, keys, at = table_rows(b["h"], *order.value, share)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b["rid"], b["c1"], pa.array(p1), pa.array(p2), lists], ["rid", "c1", "p1", "p2", "keys"])

    c1, c2 = bag_id(F.col("w"))
    rows = (
        long_enough(df.withColumn("rid", F.xxhash64("id")), "rid", least)
        .select("rid", c1.alias("c1"), c2.alias("c2"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    )
    cut = rows.mapInArrow(prefixes, "rid long, c1 long, p1 long, p2 long, keys array<long>")
    return cut.groupBy("c1", "p1", "p2", "keys").agg(F.min("rid").alias("rid")).select("rid", "p1", "p2", "keys")


def candidates(left: DataFrame, right: DataFrame, share: float, same: bool) -> DataFrame:
    """Distinct (a, b) of rids that collide in a table and pass the bounds on lengths, positions and parities."""
    a = left.select(F.posexplode("keys").alias("i", "key"), F.col("rid").alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    b = right.select(F.posexplode("keys").alias("j", "key"), F.col("rid").alias("b"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    length = lambda x: F.col(x).bitwiseAND(F.lit(LONGEST))
    n, m = F.greatest(length("a2"), length("b2")), F.least(length("a2"), length("b2"))
    cut = F.lit(LONGEST)
    least = F.ceil(F.round(F.lit(share) * n, 9))
    differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.shiftrightunsigned(F.col("a2").bitwiseXOR(F.col("b2")), 24))
    reachable = F.least(length("a2") - F.col("i"), length("b2") - F.col("j")) >= least
    passes = (n >= cut) | ((m >= least) & reachable & (differ <= n + m - 2 * least))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) if same else F.lit(True)).where(passes)
    return pairs.select("a", "b").distinct()


def verified(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame, share: float) -> DataFrame:
    """Bags (a1, a2) and (b1, b2) of the candidates whose texts hold to the definition, counted word by word."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = regex.compile(WORD)
        for b in batches:
            ok = []
            for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist()):
                x, y = Counter(word.findall(x.lower())), Counter(word.findall(y.lower()))
                n = max(x.total(), y.total())
                ok.append((x & y).total() >= math.ceil(round(share * n, 9)))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a1", "a2", "b1", "b2"])

    ids = lambda t: bag_id(words(F.col(t)))
    both = pairs.join(texts_a.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts_b.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b").select("ta", "tb")
    (a1, a2), (b1, b2) = ids("ta"), ids("tb")
    return both.select(a1.alias("a1"), a2.alias("a2"), b1.alias("b1"), b2.alias("b2"), "ta", "tb").mapInArrow(check, "a1 long, a2 long, b1 long, b2 long").distinct()


def long_enough(df: DataFrame, name: str, least: int) -> DataFrame:
    """``name`` and words ``w`` of the texts with at least ``least`` words.

    The row number keeps the filter above the projection; pushed below, it would cut every text into words twice.
    """
    cut = df.select(name, words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("at"))
    return cut.where((F.size("w") >= least) & (F.col("at") >= 0)).select(name, "w")


def members(df: DataFrame, least: int) -> DataFrame:
    """id and bag (c1, c2) of each record with enough words."""
    c1, c2 = bag_id(F.col("w"))
    return long_enough(df, "id", least).select("id", c1.alias("c1"), c2.alias("c2"))


def texts(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("id").alias("rid"), "text")


def records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of record ids from pairs of bags."""
    l = left.select(F.col("id").alias("l"), F.col("c1").alias("a1"), F.col("c2").alias("a2"))  # noqa: E741
    r = right.select(F.col("id").alias("r"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    return pairs.join(l, ["a1", "a2"]).join(r, ["b1", "b2"]).select("l", "r")


def class_links(df: DataFrame, share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Near pairs of distinct bags of words (a1, a2, b1, b2) in ``records``; see the module for the method."""
    order = frequent(df, "text")
    c = classes(df, order, share, least)
    return verified(candidates(c, c, share, True), texts(df), texts(df), share)


def near_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """All pairs (id_a < id_b) of distinct ids whose texts share at least ``share`` of the longer one's words.

    Rows with a null id or text take no part; texts under ``least`` words neither. Rows that repeat an id with the same
    text add nothing. Identical texts are paired; they are compared once, as a class, and expanded only at the end, because
    the result asks for every pair. Other columns are ignored. An empty table gives no row.
    """
    df = records(df, id_col, text_col)
    m = members(df, least).distinct()
    other = expand(class_links(df, share, least), m, m)
    same = m.select(F.col("id").alias("l"), "c1", "c2").join(m.select(F.col("id").alias("r"), "c1", "c2"), ["c1", "c2"]).where("l < r").select("l", "r")
    return other.where("l <> r").union(same).select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b")).distinct()


def cross_pairs(left: DataFrame, right: DataFrame, id_col: str = "id", text_col: str = "text", share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Pairs (left_id, right_id) of near texts between two sets: an exact prefix-filter join.

    The left (evaluation) side's necessary prefixes are the index, the right (training) side's are the probe. Nulls, short
    texts, repeated rows and empty tables as in ``near_pairs``.
    """
    left, right = records(left, id_col, text_col), records(right, id_col, text_col)
    links = cross_links(left, right, share, least)
    return expand(links, members(left, least), members(right, least)).select(F.col("l").alias("left_id"), F.col("r").alias("right_id")).where("left_id <> right_id").distinct()


def cross_links(left: DataFrame, right: DataFrame, share: float, least: int) -> DataFrame:
    """Near bags of the left (a1, a2) and the right (b1, b2) ``records``."""
    order = frequent(left.union(right), "text")
    found = candidates(classes(left, order, share, least), classes(right, order, share, least), share, False)
    return verified(found, texts(left), texts(right), share)


def cross_counts(left: DataFrame, right: DataFrame, id_col: str = "id", text_col: str = "text", share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """(id, links) of each left record with near right ones: their number, from the sizes of the classes alone.

    No pair of records is made: a class's number is the sum of the sizes of its near classes. An id that stands on both sides
    with near texts doesn't count as its own counterpart. Every id has one text; other cases as in ``cross_pairs``.
    """
    left, right = records(left, id_col, text_col), records(right, id_col, text_col)
    links = cross_links(left, right, share, least)
    ml, mr = members(left, least).distinct(), members(right, least).distinct()
    sizes = mr.groupBy(F.col("c1").alias("b1"), F.col("c2").alias("b2")).agg(F.count(F.lit(1)).alias("n"))
    of_class = links.join(sizes, ["b1", "b2"]).groupBy(F.col("a1").alias("c1"), F.col("a2").alias("c2")).agg(F.sum("n").alias("n"))
    both = ml.select("id", F.col("c1").alias("a1"), F.col("c2").alias("a2")).join(mr.select("id", F.col("c1").alias("b1"), F.col("c2").alias("b2")), "id")
    own = both.join(links, ["a1", "a2", "b1", "b2"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    out = ml.join(of_class, ["c1", "c2"]).join(own, "id", "left").select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("links"))
    return out.where("links > 0")
