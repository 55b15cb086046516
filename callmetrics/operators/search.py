"""Top-k lexical search: a stated set of queries against all rows, with the k best combined in every partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.text import bigrams, retrieval_tokens

#: Queries of one pass; more are taken in blocks. Rows scored at once.
BLOCK, SLICE = 1_000, 512
#: Terms of so many queries of a block are common.
COMMON = 16


def terms(words: Column) -> Column:
    """Distinct tokens and neighbouring pairs as 64-bit hashes; the lowest bit says that it is a pair."""
    even = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2))
    return F.array_distinct(F.concat(F.transform(words, even), F.transform(bigrams(words), lambda x: even(x).bitwiseOR(F.lit(1)))))


class Index:
    """For each term of a block of queries the queries that have it."""

    def __init__(self, lists: list[list[int]]):
        term = np.concatenate([np.array(x, np.int64) for x in lists] or [np.empty(0, np.int64)])
        query = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(term, kind="stable")
        self.terms, first, counts = np.unique(term[order], return_index=True, return_counts=True)
        self.query, self.first, self.counts, self.size = query[order], first, counts, len(lists)
        # terms of many queries are scored by a product of matrices, the others one by one
        common = np.flatnonzero(counts >= COMMON)
        self.column = np.full(len(counts), -1)
        self.column[common] = np.arange(len(common))
        self.weights = np.zeros((len(common), len(lists)), np.float32)
        for c, t in enumerate(common):
            self.weights[c, self.query[first[t] : first[t] + counts[t]]] = 4 if self.terms[t] & 1 else 2

    def scores(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x queries: two for each common token, four for each common pair."""
        rows = len(offsets) - 1
        if not len(self.terms):
            return np.zeros((rows, self.size))
        at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
        hit = self.terms[at] == values
        at, row = at[hit], np.repeat(np.arange(rows), np.diff(offsets))[hit]
        common = self.column[at] >= 0
        has = np.zeros((rows, len(self.weights)), np.float32)
        has[row[common], self.column[at[common]]] = 1
        at, row = at[~common], row[~common]
        wide = self.counts[at]
        ends = np.cumsum(wide)
        to = np.arange(wide.sum()) - np.repeat(ends - wide, wide) + np.repeat(self.first[at], wide)
        weight = np.repeat(np.where(self.terms[at] & 1, 4.0, 2.0), wide)
        return np.bincount(np.repeat(row, wide) * self.size + self.query[to], weight, rows * self.size).reshape(rows, self.size) + has @ self.weights


def top_k(rows: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, id, score, rank): for each query (id, text) the k rows (id, text) of the highest score above 0.

    The score is twice the number of common tokens and four times that of common neighbouring pairs. Ties go to the smaller
    id. Null ids and texts take no part. Texts become hashes in the JVM, which are scored in slices of rows by queries as
    arrays. Queries are collected (they are a stated set, in blocks of ``BLOCK``); the rows are read once a block, and only k
    rows a query and partition are shuffled.
    """
    kind, qkind = dict(rows.dtypes)["id"], dict(queries.dtypes)["id"]
    hashed = lambda df: df.where("id IS NOT NULL AND text IS NOT NULL").select("id", retrieval_tokens(F.col("text")).alias("w")).select("id", terms(F.col("w")).alias("t"))
    listed = [(r["id"], r["t"]) for r in hashed(queries.select("id", "text").distinct()).toLocalIterator()]
    found, out = hashed(rows), rows.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, score long")
    for lo in range(0, len(listed), BLOCK):
        own = listed[lo : lo + BLOCK]
        known = rows.sparkSession.sparkContext.broadcast((Index([t for _, t in own]), [i for i, _ in own]))

        def best(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            index, ids = known.value
            top: list[list] = [[] for _ in ids]  # (-score, id), best first
            least = np.ones(len(ids))
            for b in batches:
                offsets = b["t"].offsets.to_numpy().astype(np.int64)
                values, names = b["t"].values.to_numpy(zero_copy_only=False), b["id"].to_pylist()
                for at in range(0, b.num_rows, SLICE):
                    cut = offsets[at : at + SLICE + 1]
                    scores = index.scores(values[cut[0] : cut[-1]], cut - cut[0])
                    for q in np.flatnonzero(scores.max(axis=0, initial=0.0) >= least):
                        column = scores[:, q]
                        floor = max(least[q], np.partition(column, -k)[-k] if len(column) >= k else 0.0)
                        top[q] = sorted(top[q] + [(-int(column[i]), names[at + i]) for i in np.flatnonzero(column >= floor)])[:k]
                        if len(top[q]) == k:
                            least[q] = -top[q][-1][0]
            flat = [(ids[q], i, -s) for q, x in enumerate(top) for s, i in x]
            if flat:
                a, c, s = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s, pa.int64())], ["query_id", "id", "score"])

        out = out.union(found.mapInArrow(best, f"query_id {qkind}, id {kind}, score long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
