import random

import pytest

from callmetrics.llm import subjects

AREAS = ["law", "food", "sport"]
OWN = {a: [f"{a}{c}" for c in "abcdefghijkl"] for a in AREAS}
COMMON = ["the", "call", "returns", "an", "error", "page", "limit", "server", "value", "argument"]


def sentence(rng, subject=None):
    w = [rng.choice(COMMON) for _ in range(8)]
    if subject:
        w[2], w[5] = rng.choice(OWN[subject]), rng.choice(OWN[subject])
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    docs, truth, labels = [], set(), []
    for d in range(600):
        plan = []
        chosen = rng.sample(AREAS, rng.choice([0, 1, 1, 1, 2]))
        for s in chosen:
            truth.add((d, s))
            plan += [s] * 4
        plan += [None] * rng.randint(1, 6)
        rng.shuffle(plan)
        docs.append((d, " ".join(sentence(rng, s) for s in plan), rng.choice(["en", "en", None])))
        if chosen and rng.random() < 0.3:
            s = rng.choice(chosen) if rng.random() > 0.1 else rng.choice(AREAS)
            labels.append((d, "ann_a", rng.choice([s, s.upper(), f"{s} "])))
    docs += [(1000, None, "en"), (1001, "  ", "en"), (None, docs[0][1], "en"), (1002, "12 34", None)]
    labels += [(5, "ann_b", "unheard of"), (None, "ann_b", "law"), (7, "ann_b", None)]
    return (
        spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, total int"),
        spark.createDataFrame(labels, "doc_id long, annotator string, subject string"),
        spark.createDataFrame([(a,) for a in AREAS] + [(None,)], "subject string"),
        truth,
    )


def test_accuracy_against_the_truth(made):
    """Most documents have no label, and a tenth of the labels are wrong."""
    *frames, truth = made
    got = {(r.doc_id, r.subject) for r in subjects.classified(*frames).collect()}
    assert len(got & truth) >= 0.97 * len(got | truth)


def test_posteriors(made):
    *frames, _ = made
    rows = subjects.classified(*frames).collect()
    assert all(0 < r.posterior < 1 and 0.25 <= r.share <= 1 for r in rows)
    whole = [r.posterior for r in rows if r.share > 0.9]
    part = [r.posterior for r in rows if r.share < 0.6]
    assert sum(whole) / len(whole) > sum(part) / len(part)


def test_empty(spark, made):
    docs, labels, areas, _ = made
    assert subjects.classified(docs.limit(0), labels, areas).count() == 0
    assert subjects.classified(docs, labels, areas.limit(0)).count() == 0
    assert subjects.classified(docs, labels.limit(0), areas).count() == 0


def test_a_very_long_text(spark, made):
    docs, labels, areas, _ = made
    rng = random.Random(3)
    long = " ".join(sentence(rng, "law" if k % 2 else "sport") for k in range(20_000))
    got = subjects.classified(docs.union(spark.createDataFrame([(2000, long, "en", 1)], docs.schema)), labels, areas, calibrate=False)
    assert {r.subject for r in got.where("doc_id = 2000").collect()} == {"law", "sport"}
