"""Words of a text and the global order of rarity the prefix filters share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import checkpointed

#: Runs of Unicode letters and digits, without the underscore.
WORD = r"[\p{L}\p{N}]+"

#: The broadcast list of words holds those of so many occurrences, but no more entries (of 16 bytes) than the bound.
LEAST_COUNT, MOST_WORDS = 8, 2_000_000


def words(text: Column) -> Column:
    """Lower-case words; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bag_id(found: Column) -> tuple[Column, Column]:
    """128 bits that name the multiset of words."""
    bag = F.sort_array(found)
    return F.xxhash64(bag), F.xxhash64(F.lit(1), bag)


def frequent(df: DataFrame, text: str, least: int = LEAST_COUNT, most: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur ``least`` times or more as 32-bit hashes (sorted) with their rank, rarest first.

    Counts cover every row and are combined before the shuffle. Words off the list occur in fewer than ``least`` texts, so
    their order among themselves hardly matters. The list grows with the corpus; where it would pass ``most`` entries, the
    least count is doubled until it doesn't. It only decides the order in which words are tried, never which pairs are
    found, so a collision of hashes does no harm.
    """
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = df.select(F.explode(hashed).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    counts = checkpointed(counts.where(F.col("c") >= least))
    sizes = {r["e"]: r["n"] for r in counts.groupBy(F.floor(F.log2(F.col("c") / least) + 1e-9).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
    step = min((e for e in range(64) if sum(n for k, n in sizes.items() if k >= e) <= most))
    rows = counts.where(F.col("c") >= least * 2**step).toArrow()
    w, c = rows["w"].to_numpy().astype(np.uint64), rows["c"].to_numpy()
    rank = np.empty(len(w), np.uint64)
    rank[np.lexsort((w, c))] = np.arange(len(w), dtype=np.uint64)
    order = np.argsort(w)
    return w[order], rank[order]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ordered_tokens(values: np.ndarray, row: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """64-bit names of the words of each row, occurrences counted apart, rarest first within the row.

    ``values`` are word hashes, ``row`` their (ascending) row numbers. Words off the list come first, in order of
    hash; listed ones follow by rising frequency. The 256th and later occurrences of a word share a name, which can
    only add candidates.
    """
    low = values & np.uint64(0xFFFFFFFF)
    base = (values >> np.uint64(9)) << np.uint64(8)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, low), len(listed) - 1)
        base = np.where(listed[at] == low, (np.uint64(1) << np.uint64(63)) | (rank[at] << np.uint64(8)), base)
    base = base[np.lexsort((base, row))]
    new = np.ones(len(base), bool)
    new[1:] = (base[1:] != base[:-1]) | (row[1:] != row[:-1])
    here = np.arange(len(base))
    occurrence = here - np.maximum.accumulate(np.where(new, here, 0))
    return base | np.minimum(occurrence, 255).astype(np.uint64)
