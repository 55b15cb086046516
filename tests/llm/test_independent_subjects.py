import random

import numpy as np

from callmetrics.llm import subjects
from tests.llm.test_subjects import AREAS, COMMON, OWN, made  # noqa: F401


def both(rng):
    """A sentence that deals with two subjects alike."""
    w = [rng.choice(COMMON) for _ in range(8)]
    w[1], w[3], w[5], w[7] = rng.choice(OWN["law"]), rng.choice(OWN["law"]), rng.choice(OWN["food"]), rng.choice(OWN["food"])
    return " ".join(w).capitalize() + "."


def test_a_sentence_counts_for_each_of_its_subjects(spark, made):  # noqa: F811
    docs, labels, areas, _ = made
    rng = random.Random(5)
    more = spark.createDataFrame([(3000 + i, " ".join(both(rng) for _ in range(6)), "en", 1) for i in range(20)], docs.schema)
    got = subjects.classified(docs.union(more), labels, areas).where("doc_id >= 3000").collect()
    assert {(r.doc_id, r.subject) for r in got} == {(3000 + i, s) for i in range(20) for s in ("law", "food")}
    assert all(r.share >= 0.5 for r in got)


def test_the_curve_of_labels_decides(made):  # noqa: F811
    """p8_found's rows follow the calibrated posterior, not the raw odds."""
    score, odds = np.ones((1, 2)), np.array([[1.0, 1.0]])
    got = subjects.independent(score, odds, np.array([[0.5, -2.0], [0.5, 2.0]]))
    assert got[0, 0] < 0.5 <= got[0, 1] and (subjects.independent(score - 1, odds, None) == 0).all()


def test_curves_converge():
    """Also where hardly any sentence has the subject, and where two kinds are apart."""
    x = np.r_[np.zeros(950), np.full(30, 0.9)]
    slope, offset = subjects.logistic(x, (x > 0).astype(float), np.ones(980), (8.0, -2.0))
    assert 0 < slope < 50 and -50 < offset < 0


def test_words_of_a_small_language_are_features(spark):
    """A word in a tenth of a language's documents, though in under 0.05 % of all."""
    rows = spark.range(20_040).selectExpr("IF(id < 20000, 1, 2) AS stratum", "IF(id < 20000, 'common', IF(id < 20006, 'gemeinsam selten', 'gemeinsam')) AS text")
    assert set(subjects.vocabulary(rows, subjects.MIN_SHARE, subjects.MIN_DOCS)) == {"common", "gemeinsam", "selten"}
