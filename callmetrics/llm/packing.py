"""Texts combined into containers of fixed capacity: linear grouping, configurations, substitution, best fit.

1. A text longer than the capacity is cut into full pieces and a rest; every other text is one piece.
2. The plan is made from the number of pieces of each size alone, at most ``capacity`` numbers however large the corpus:
   sizes over ``large`` of the capacity are put into groups of equal cardinality and rounded up to the largest of their
   group; over these few sizes the configurations of a container (which sizes, how often) are optimised as a linear
   program by column generation; the whole parts of its solution are containers.
3. Actual pieces take the places of the rounded ones, so room comes back; pieces left over from the rounding of the
   solution and all small ones are put by best fit, largest first, into what room is left, then into new containers.
4. Each piece finds its place by its size and its rank among the pieces of that size, which are ranked in salted groups,
   so no size, however frequent, is gathered in one task.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.storage import checkpointed

CAPACITY = 2048
GROUPS = 32
LARGE = 1 / 8
#: Pieces of one size that are ranked in one group, on average; at most so many groups a size, as their counts reach the driver.
PER_SALT, MOST_SALTS = 200_000, 1024
#: A run of letters, digits and underscores, or any other character that isn't white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1C-\x1F\x{85}]"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def grouped(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Groups of (size, count), sizes falling, of as equal cardinality as whole counts allow; a size may be in two groups."""
    total = int(counts.sum())
    share, out, room = max(1, math.ceil(total / groups)), [[]], max(1, math.ceil(total / groups))
    for s, n in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        while n:
            take = min(n, room)
            out[-1].append((s, take))
            n, room = n - take, room - take
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_, values_ = sizes[order], values[order]
    for c in range(int(sizes_[0]), capacity + 1):
        k = np.searchsorted(sizes_, c, "right")
        with_ = values_[:k] + best[c - sizes_[:k]]
        j = int(with_.argmax())
        if with_[j] > best[c - 1] + 1e-12:
            best[c], last[c] = with_[j], order[j]
        else:
            best[c], last[c] = best[c - 1], -2
    found, c = np.zeros(len(sizes)), capacity
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            found[last[c]] += 1
            c -= int(sizes[last[c]])
    return best[capacity], found


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations) and how often each is used, by column generation over the covering program."""
    basis = np.diag(np.floor(capacity / sizes)).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = knapsack(np.maximum(dual, 0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        d = np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis, x


class Rooms:
    """Runs of containers by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.by, self.order = capacity, 0, {}, []

    def put(self, bin_: int, count: int, room: int, position: int) -> None:
        if count and room:
            if room not in self.by:
                self.by[room] = []
                bisect.insort(self.order, room)
            self.by[room].append((bin_, count, position))

    def take(self, size: int) -> tuple[int, int, int, int] | None:
        at = bisect.bisect_left(self.order, size)
        if at == len(self.order):
            return None
        room = self.order[at]
        run = self.by[room].pop()
        if not self.by[room]:
            del self.by[room]
            self.order.pop(at)
        return (*run, room)

    def open(self, count: int) -> int:
        self.used += count
        return self.used - count


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> tuple[np.ndarray, int]:
    """Places for all pieces and the number of containers.

    A row (size, lo, hi, container, per, position): the pieces of that size ranked lo to hi - 1 go, ``per`` to a container,
    into the containers from ``container`` on, from ``position`` on in each.
    """
    done = dict.fromkeys(histogram, 0)
    rows, rooms = [], Rooms(capacity)
    big = np.array([s for s in histogram if s > large * capacity and s < capacity], int)
    if len(big):
        # as few sizes as groups need no rounding
        parts = [[(s, histogram[s])] for s in sorted(big.tolist(), reverse=True)] if len(big) <= groups else grouped(big, np.array([histogram[s] for s in big.tolist()]), groups)
        # groups may share a size at their border; rounded sizes that are equal are one
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in parts:
            merged.setdefault(g[0][0], []).extend(g)
        tops = np.array(list(merged))
        queues = [list(g) for g in merged.values()]
        columns, x = configurations(tops, np.array([sum(n for _, n in q) for q in queues], float), capacity)
        for j in range(len(tops)):
            times = int(math.floor(x[j] + 1e-9))
            slots = [g for g in range(len(tops)) for _ in range(int(columns[g, j]))]
            while times and slots:
                # the longest run of containers whose places hold equal sizes
                run, need = times, {g: slots.count(g) for g in set(slots)}
                run = min([run, *(sum(n for _, n in queues[g]) // k for g, k in need.items())])
                if not run:
                    break
                run = min([run, *(max(1, queues[g][0][1] // k) for g, k in need.items())])
                first, room = rooms.open(run), capacity
                for position, g in enumerate(slots):
                    left, at = run, first
                    size = queues[g][0][0]
                    while left:
                        s, n = queues[g][0]
                        t = min(left, n)
                        rows.append((s, done[s], done[s] + t, at, 1, position))
                        done[s] += t
                        queues[g][0] = (s, n - t)
                        if n == t:
                            queues[g].pop(0)
                        left, at = left - t, at + t
                        size = max(size, s)
                    room -= size
                rooms.put(first, run, room, len(slots))
                times -= run
    for s in sorted(histogram, reverse=True):
        n = histogram[s] - done[s]
        while n:
            if (run := rooms.take(s)) is None:
                per = capacity // s
                count = math.ceil(n / per)
                run = (rooms.open(count), count, 0, capacity)
            bin_, count, position, room = run
            per = room // s
            whole = min(count, n // per)
            if whole:
                rows.append((s, done[s], done[s] + whole * per, bin_, per, position))
                rooms.put(bin_, whole, room - per * s, position + per)
                done[s] += whole * per
                n -= whole * per
                bin_, count = bin_ + whole, count - whole
            if count and n and n < per:
                rows.append((s, done[s], done[s] + n, bin_, n, position))
                rooms.put(bin_, 1, room - n * s, position + n)
                done[s] += n
                bin_, count, n = bin_ + 1, count - 1, 0
            rooms.put(bin_, count, room, position)
    return np.array(sorted(rows), np.int64).reshape(-1, 6), rooms.used


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE, per_salt: int = PER_SALT) -> DataFrame:
    """container, position, doc_id, token_start, token_end: every token of every text in one place.

    Texts without tokens (null, empty, blank) take no room and give no row; rows with a null id are left out; rows are
    packed as they are, so a repeated row takes its room again; an empty table gives no row; other columns are ignored.
    Texts of any length are counted whole. Salts grow with the corpus, so a group to be ranked has some ``per_salt`` pieces
    at most, however frequent its size.
    """
    spark = df.sparkSession
    sized = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("tokens"), F.monotonically_increasing_id().alias("at"))
    sized = checkpointed(sized.where("tokens > 0 AND at >= 0").select("doc_id", "tokens"))  # texts are cut into tokens once
    whole = F.floor(F.col("tokens") / capacity)
    most = sized.groupBy(F.least("tokens", F.lit(capacity)).alias("size")).agg(F.sum(F.greatest(whole, F.lit(1))).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = min(MOST_SALTS, max(16, math.ceil(most / per_salt)))
    cuts = F.explode(F.sequence(F.lit(0), (F.col("tokens") - 1).cast("int"), F.lit(capacity)))
    pieces = sized.select("doc_id", "tokens", cuts.alias("token_start")).select(
        "doc_id", "token_start", F.least(F.col("tokens") - F.col("token_start"), F.lit(capacity)).alias("size"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "token_start"), F.lit(salts)).cast("int").alias("salt"),
    )
    counted = pieces.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("size", "salt").toArrow()
    size, salt, n = (counted[c].to_numpy().astype(np.int64) for c in ("size", "salt", "n"))
    histogram: dict[int, int] = {}
    before = np.zeros(capacity * salts + salts + 1, np.int64)
    for s, k, c in zip(size.tolist(), salt.tolist(), n.tolist()):
        before[s * salts + k] = histogram.get(s, 0)
        histogram[s] = histogram.get(s, 0) + c
    rows, _ = plan(histogram, capacity, groups, large)
    known = spark.sparkContext.broadcast((before, rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = known.value
        key = (rows[:, 0] << 44) | rows[:, 1]
        for b in batches:
            size, salt, start = (b[c].to_numpy().astype(np.int64) for c in ("size", "salt", "token_start"))
            rank = b["rank"].to_numpy().astype(np.int64) - 1 + before[size * salts + salt]
            to = rows[np.searchsorted(key, (size << 44) | rank, "right") - 1]
            step = rank - to[:, 1]
            arrays = [pa.array(to[:, 3] + step // to[:, 4]), pa.array(to[:, 5] + step % to[:, 4]), b["doc_id"], pa.array(start), pa.array(start + size)]
            yield pa.RecordBatch.from_arrays(arrays, ["container", "position", "doc_id", "token_start", "token_end"])

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "token_start")))
    kind = dict(df.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"container long, position long, doc_id {kind}, token_start long, token_end long")
