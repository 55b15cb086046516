import random

import numpy as np

from callmetrics.llm import leakage, queries


def words(rng, n):
    return [f"{rng.choice('bdfg')}{rng.randrange(10**6)}" for _ in range(n)]


def cases():
    """Items and documents with a known answer, well off the border."""
    rng = random.Random(11)
    frame = "the result of this call is sent to".split()
    items = [(k, words(rng, rng.randint(12, 120)) + frame) for k in range(30)]
    docs, want = [], set()
    for d in range(200):
        k, item = rng.choice(items)
        n, kind = len(item), d % 5
        text = words(rng, rng.randint(0, 200))
        if kind == 0:  # whole
            part = item
        elif kind == 1:  # most of it, one word in twelve changed, dropped or added
            a = rng.randrange(max(1, n // 4))
            part = []
            for i, w in enumerate(item[a : a + int(0.72 * n) + 1]):
                if i % 12 == 11:
                    part += [[], ["neu"], [w, "neu"]][rng.randrange(3)]
                else:
                    part.append(w)
        elif kind == 2:  # a short quotation
            part = item[: max(1, n // 3)]
        elif kind == 3:  # all words, scattered
            part = [x for w in item for x in (w, *words(rng, 3))]
        else:  # the frame with other matter
            part = [w if w in frame else "anders" + w for w in item]
        if kind < 2:
            want.add((d, k))
        docs.append((d, " ".join(text + part + words(rng, 40))))
    return [(k, " ".join(w)) for k, w in items], docs, want


def test_known_cases(spark):
    items, docs, want = cases()
    got = leakage.leaking(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs, want = cases()
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 700)
    got = leakage.leaking(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "x " * 300_000 + item), (5, "alpha beta gamma"), (6, "Alpha, BETA gamma; delta epsilon zeta. eta")]
    items = [(7, item), (8, None), (9, ""), (10, item), (None, item), (11, "one two")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, h int")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaking(d, i).collect()} == {(x, k) for x in (1, 4, 6) for k in (7, 10)}
    assert leakage.leaking(d.limit(0), i).count() == leakage.leaking(d, i.limit(0)).count() == 0


def test_reach():
    a = np.array([1, 2, 3, 9, 4, 5, 6, 7])
    assert leakage.reach(a, np.array([1, 2, 3, 4, 5, 6, 7]), 2) == [3, 7, 7]
    assert leakage.reach(a, np.array([1, 2, 3, 8, 4, 5, 6, 7]), 1) == [3, 7]
    assert leakage.reach(a, np.array([], np.int64), 1) == [0, 0]


def test_shapes_leave_a_shingle():
    for n in range(1, 400):
        m, q, c = leakage.shape(n, 0.5)
        assert all(k - (q - 1) * (k // 7 + 1) >= 1 for k in range(m, n + 1)) and 1 <= c <= n - q + 1


def test_on_the_test_data(spark, sf):
    """Whole items, looked for as text, are all found."""
    found = {tuple(r) for r in queries.p7_found(spark, sf).collect()}
    norm = lambda t: " " + " ".join(leakage_words(t)) + " "
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/heldout_items.parquet").collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= found


def leakage_words(text):
    import regex

    return regex.findall(r"[^\W_]+", text.lower())
