import math
import random
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from callmetrics.llm import overlap, queries

WORD = regex.compile(r"[^\W_]+")


def brute(rows, share=0.75, least=8):
    bags = {i: Counter(WORD.findall(t.lower())) for i, t in rows if i is not None and t is not None}
    ids = sorted(i for i, b in bags.items() if b.total() >= least)
    near = lambda a, b: (a & b).total() >= math.ceil(round(share * max(a.total(), b.total()), 9))
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(bags[a], bags[b])}


def made(seed, n=150):
    """Texts of a small vocabulary, some of them edited copies of others, with repeated words."""
    rng = random.Random(seed)
    vocabulary = ["the", "and", "of"] * 15 + [f"w{i}" for i in range(60)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "the and").split()
            for _ in range(rng.randint(0, max(1, len(words) // 3))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        rows.append((f"t{k:03}", " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("top", [0, 3, 50_000])
def test_pairs_are_all_pairs(spark, monkeypatch, seed, top):
    """Whatever the order of words, no pair is lost and none is added."""
    real = overlap.frequent
    monkeypatch.setattr(overlap, "frequent", lambda df, text: real(df, text, max(top, 1)))
    rows = made(seed)
    got = {(r.id_a, r.id_b) for r in overlap.near_pairs(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == brute(rows)


def test_cross_pairs(spark):
    rows = made(3)
    left, right = rows[::3], [r for k, r in enumerate(rows) if k % 3]
    frames = [spark.createDataFrame(x, "id string, text string") for x in (left, right)]
    got = {tuple(sorted((r.left_id, r.right_id))) for r in overlap.cross_pairs(*frames).collect()}
    ids = {i for i, _ in left}
    assert got == {p for p in brute(rows) if len({p[0] in ids, p[1] in ids}) == 2}


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"x{i % 700}" for i in range(70_000))
    eight = "one two three four five six seven eight"
    rows = [("a", long), ("b", long + " more"), ("a", long), (None, eight), ("c", None), ("d", ""), ("e", eight), ("f", eight.upper() + "!"), ("g", "one two"), ("h", "one two"), ("i", "wort " * 300), ("j", "wort " * 290)]
    df = spark.createDataFrame(rows, "id string, text string").withColumns({c: F.lit(1) for c in ("w", "c1", "rid", "keys", "a", "b", "key", "l", "r")})
    got = {(r.id_a, r.id_b) for r in overlap.near_pairs(df).collect()}
    assert got == {("a", "b"), ("e", "f"), ("i", "j")}


def test_empty(spark):
    none = spark.createDataFrame([], "id string, text string")
    assert overlap.near_pairs(none).count() == 0
    assert overlap.cross_pairs(none, spark.createDataFrame(made(1), "id string, text string")).count() == 0


def test_parities_bound_the_distance():
    """The parities of two texts differ in no more bits than the texts do."""
    import numpy as np

    rng = random.Random(5)
    texts = [[rng.getrandbits(63) for _ in range(rng.randint(8, 300))] for _ in range(40)]
    texts += [t[:-2] + [rng.getrandbits(63)] for t in texts]
    n, p1, p2, keys, at = overlap.table_rows(pa.array(texts, pa.list_(pa.int64())), np.empty(0, np.uint64), np.empty(0, np.uint64), 0.75)
    assert list(p2 & 0xFFFF) == [len(t) for t in texts]
    for i in range(40):
        a, b = Counter(texts[i]), Counter(texts[i + 40])
        differ = bin(int(p1[i] ^ p1[i + 40]) & (2**64 - 1)).count("1") + bin((int(p2[i] ^ p2[i + 40]) & (2**64 - 1)) >> 16).count("1")
        assert differ <= ((a - b) + (b - a)).total()
        assert at[i + 1] - at[i] == n[i] - math.ceil(0.75 * n[i]) + 1


def test_found_queries_agree_on_the_test_data(spark, sf):
    four = {(r.id_a, r.id_b) for r in queries.p4_found(spark, sf).where("kind = 'request'").collect()}
    tasks = spark.read.parquet(f"{sf}/eval_tasks.parquet").select("task_id", "user_request", "split").distinct().collect()
    assert four == brute({(r.task_id, r.user_request) for r in tasks})
    side = {r.task_id: r.split and r.split.strip().lower().startswith("train") for r in tasks}
    two = {(r.task_a, r.task_b) for r in queries.p2_found(spark, sf).collect()}
    assert two == {p for p in four if {side[p[0]], side[p[1]]} == {True, False}}
    tools = spark.read.parquet(f"{sf}/tools.parquet").select("tool_id", "doc_snippets").distinct().collect()
    got = {(r.id_a, r.id_b) for r in queries.p4_found(spark, sf).where("kind = 'tool'").collect()}
    assert got == brute({(r.tool_id, " ".join(x for x in r.doc_snippets if x is not None)) for r in tools if r.doc_snippets is not None})


def test_counts_are_those_of_the_pairs(spark):
    """Ids that stand on both sides don't count as their own counterparts."""
    rows = made(5)
    left, right = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 != 1]
    frames = [spark.createDataFrame(x * 2, "id string, text string") for x in (left, right)]
    pairs = Counter(r.left_id for r in overlap.cross_pairs(*frames).collect())
    assert {r.id: r.links for r in overlap.cross_counts(*frames).collect()} == dict(pairs) and pairs
