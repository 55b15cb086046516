"""Passages of held-out items in corpus documents, in whole or in part.

A document leaks an item of ``n`` words if, in one stretch and in order, it has at least ``M = part * n`` of them, with at most
one word in eight of the stretch changed, dropped or added: at most M / 7 edits, which leave M / (M / 7 + 1) or more words in
one whole run. A prefix-filtered set join finds the candidates: shingles of ``q`` words (five, or as long as the shortest such
run is), counted over the whole corpus, order each item's positions by rarity; as a leak shares at least c = M - (q - 1)(M / 7 + 1)
of an item's N positions, one of its N - c + 1 rarest must be there. Candidates pass the bounds on length and on positions
(the shared shingles within a window of the item's size number c), and are verified word by word: every common run of q words
is extended both ways, edit by edit, to the furthest reach, and the best stretch is held against the definition.

Items are a stated query set: they are taken in blocks, by hash, of a bounded number of words against all rows; only one block and its index
are held at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import checkpointed
from callmetrics.llm.words import mix, words

PART = 0.5
SHINGLE = 5
#: Words of items in a block: an index of at most so many entries of 24 bytes is broadcast.
BLOCK_WORDS = 500_000
SLICE = 500
PRIME = np.uint64(0x9E3779B97F4A7C15)


def least_run(m: int) -> int:
    """The longest whole run that m words with m // 7 edits among them have at least."""
    return math.ceil(m / (m // 7 + 1))


def shape(n: int, part: float) -> tuple[int, int, int]:
    """Of an item of n words: words needed, length of its shingles, positions a leak shares at least."""
    m = max(1, math.ceil(round(part * n, 9)))
    # a longer stretch may have more edits, so the shortest run is taken over all lengths it can have
    q = min([SHINGLE, *(least_run(k) for k in range(m, n + 1))])
    return m, q, max(1, min(k - (q - 1) * (k // 7 + 1) for k in range(m, n + 1)))


def grams(values: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q values (those over the end of a text are the caller's to leave out)."""
    if len(values) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(values) - q + 1, np.uint64)
        for i in range(q):
            h = h * PRIME + mix(values[i : len(values) - q + 1 + i])
    return h


def reach(a: np.ndarray, b: np.ndarray, edits: int) -> list[int]:
    """The most words in common, in order, from the start of both with 0, 1, ... edits between them."""
    a, b = a.tolist(), b.tolist()
    na, nb = len(a), len(b)

    def slide(i: int, k: int) -> int:
        j = i - k
        while i < na and j < nb and j >= 0 and a[i] == b[j]:
            i += 1
            j += 1
        return i

    at = slide(0, 0)
    front, most = {0: (at, at)}, [at]  # diagonal -> (place in a, words in common)
    for e in range(1, edits + 1):
        new = {}
        for k in range(-e, e + 1):
            best = None
            for source, step in ((k, 1), (k - 1, 1), (k + 1, 0)):  # changed, added to a, dropped from a
                if (old := front.get(source)) is not None:
                    i = old[0] + step
                    if i <= na and 0 <= i - k <= nb and (best is None or (i, old[1]) > best):
                        best = (i, old[1])
            if best is not None:
                i = slide(best[0], k)
                new[k] = (i, best[1] + i - best[0])
        front = new
        most.append(max([most[-1], *(m for _, m in front.values())]))
        if not front:
            most += [most[-1]] * (edits - e)
            break
    return most


def leaks(doc: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, m: int, q: int) -> bool:
    """Whether the document leaks the item; (at, of) are places of common shingles in the document and the item."""
    n = len(item)
    edits = n // 7
    runs, last = [], {}
    for i, j in sorted(zip(at.tolist(), of.tolist())):
        k = last.get(i - j)
        if k is not None and runs[k][0] + runs[k][2] - q + 1 == i:
            runs[k][2] += 1
        else:
            last[i - j] = len(runs)
            runs.append([i, j, q])
    for i, j, wide in sorted(runs, key=lambda r: -r[2]):
        if wide >= m:
            return True
        ahead = reach(doc[i + wide : i + wide + 2 * n], item[j + wide :], edits)
        behind = reach(doc[max(0, i - 2 * n) : i][::-1], item[:j][::-1], edits)
        for e, x in enumerate(ahead):
            for f, y in enumerate(behind):
                if (got := wide + x + y) >= m and e + f <= got // 7:
                    return True
    return False


class Index:
    """The necessary prefixes of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], part: float, counts: dict[int, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.shapes = [shape(len(w), part) for w in self.words]
        self.full, self.prefix = {}, {}
        for q in sorted({s[1] for s in self.shapes}):
            own = [k for k, s in enumerate(self.shapes) if s[1] == q]
            found = [(grams(self.words[k], q), k) for k in own]
            h = np.concatenate([g for g, _ in found])
            k = np.concatenate([np.full(len(g), k) for g, k in found])
            place = np.concatenate([np.arange(len(g)) for g, _ in found])
            by = np.argsort(h, kind="stable")
            self.full[q] = (h[by], k[by].astype(np.int32), place[by].astype(np.int32))
            if counts is not None:
                rare, c = np.unique(h), counts[q]
                order = np.lexsort((h, c[np.searchsorted(rare, h)], k))
                start = np.r_[0, np.flatnonzero(np.diff(k[order])) + 1]
                rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
                sizes = {x: len(self.words[x]) - q + 1 - self.shapes[x][2] + 1 for x in own}
                keep = order[rank < np.array([sizes[x] for x in k[order]])]
                self.prefix[q] = np.unique(h[keep])


def texts_of(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    offsets = b[column].offsets.to_numpy().astype(np.int64)
    return b[column].values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def shingles(values: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each run of q values within a text."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = grams(values, q)
    inside = row[: len(h)] == row[len(row) - len(h) :]
    place = np.arange(len(h)) - offsets[row[: len(h)]]
    return h[inside], row[: len(h)][inside], place[inside]


def known(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h if len(sorted_) else np.zeros(len(h), bool)


def corpus_counts(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """How often each of the items' shingles stands in the corpus, over all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast({q: np.unique(h) for q, (h, _, _) in index.full.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {q: np.zeros(len(h), np.int64) for q, h in wanted.value.items()}
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                values, offsets = texts_of(b.slice(lo, SLICE), "h")
                for q, h in wanted.value.items():
                    found = shingles(values, offsets, q)[0]
                    found = found[known(h, found)]
                    totals[q] += np.bincount(np.searchsorted(h, found), minlength=len(h))
        for q, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["q", "k", "c"])

    out = {q: np.zeros(len(h), np.int64) for q, h in wanted.value.items()}
    for r in docs.select("h").mapInArrow(count, "q int, k int, c long").groupBy("q", "k").agg(F.sum("c").alias("c")).toArrow().to_pylist():
        out[r["q"]][r["k"]] = r["c"]
    return out


def block_leaks(docs: DataFrame, items: list[tuple[int, np.ndarray]], part: float) -> DataFrame:
    index = Index(items, part)
    index = docs.sparkSession.sparkContext.broadcast(Index(items, part, corpus_counts(docs, index)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                values, offsets = texts_of(s, "h")
                rows, ids = [], []
                for q, prefix in x.prefix.items():
                    h, row, place = shingles(values, offsets, q)
                    hit = np.unique(row[known(prefix, h)])
                    here = np.isin(row, hit) & known(x.full[q][0], h)
                    h, row, place = h[here], row[here], place[here]
                    fh, fk, fp = x.full[q]
                    first, end = np.searchsorted(fh, h), np.searchsorted(fh, h, "right")
                    wide = end - first
                    source = np.repeat(np.arange(len(h)), wide)
                    to = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first, wide)
                    pairs = defaultdict(list)
                    for e, key in enumerate(zip(row[source].tolist(), fk[to].tolist())):
                        pairs[key].append(e)
                    at, of = place[source], fp[to]
                    for (r, k), e in pairs.items():
                        m, _, c = x.shapes[k]
                        doc, item = values[offsets[r] : offsets[r + 1]], x.words[k]
                        if len(doc) < m or len(e) < c:
                            continue
                        spots = np.sort(at[e])
                        if c > 1 and (spots[c - 1 :] - spots[: len(spots) - c + 1]).min() > len(item) + len(item) // 7:
                            continue
                        if leaks(doc, item, at[e], of[e], m, q):
                            rows.append(r)
                            ids.append(x.ids[k])
                yield pa.RecordBatch.from_arrays([s["id"].take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], ["doc_id", "item_id"])

    return docs.mapInArrow(find, "doc_id long, item_id long").distinct()


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = F.transform(words(F.col(text_col).cast("string")), lambda w: F.xxhash64(w))
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), found.alias("h"))


def leaking(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", part: float = PART) -> DataFrame:
    """Pairs (doc_id, item_id) in which the document reproduces at least ``part`` of the item; see the module.

    Null ids and texts, and items without words, take part in nothing; repeated rows give one pair; texts are used whole
    however long; an empty table on either side gives no row; further columns are ignored.
    """
    docs = hashed(documents, doc_id, text)
    asked = hashed(items, item_id, text).where(F.size("h") > 0).distinct()
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("h"))).first()[0] or 0) / BLOCK_WORDS))
    if blocks > 1:
        asked = checkpointed(asked)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id", "h"), F.lit(blocks)) == k).collect()
        if own:
            found = block_leaks(docs, [(r["id"], np.array(r["h"], np.int64).view(np.uint64)) for r in own], part)
            out = out.union(found if blocks == 1 else checkpointed(found))  # so that only one block is held at a time
    return out.distinct()
