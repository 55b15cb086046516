import math

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import similarity, stats, text


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_wilson(spark):
    low, high = (value(spark, c) for c in stats.wilson(F.lit(8), F.lit(10)))
    assert 0 < low < 0.8 < high < 1 and (low, high) == (0.4902, 0.9433)
    assert [value(spark, c) for c in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 0.0]


@pytest.mark.parametrize(("b", "c"), [(17, 196), (10, 219), (47, 76), (64, 27), (0, 0), (1, 1)])
def test_mcnemar(spark, b, c):
    """Against the exact complementary error function."""
    chi, p = (value(spark, x) for x in stats.mcnemar(F.lit(b), F.lit(c)))
    want = max(abs(b - c) - 1, 0) ** 2 / (b + c) if b + c else 0
    assert math.isclose(chi, want, abs_tol=1e-6) and math.isclose(p, math.erfc(math.sqrt(want / 2)), abs_tol=1e-6)


@pytest.mark.parametrize(("path", "want"), [(".\\docs\\README.md", "docs/README.md"), ("./././a", "a"), ("a//b/./c/", "a/b/c"), ("http://x/y//", "http://x/y"), ("/", "/"), ("", "."), ("a/.", "a"), (" a b ", "a b")])
def test_paths(spark, path, want):
    assert value(spark, text.normalized_path(F.lit(path))) == want


def test_sets_and_vectors(spark):
    s = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, similarity.jaccard(s("a", "b"), s("b", "c"))) == pytest.approx(1 / 3)
    assert value(spark, similarity.jaccard(s(), s())) == 0
    assert value(spark, similarity.cosine(s(1.0, 0.0), s(1.0, 1.0))) == pytest.approx(0.5**0.5)
    assert value(spark, similarity.cosine(s(1.0), s(1.0, 1.0))) == value(spark, similarity.cosine(s(0.0), s(1.0))) == 0


def test_tokenizers(spark):
    t = F.lit("Read the_file ./a/b.txt, don't stop! I")
    assert value(spark, text.distractor_tokens(t)) == ["read", "the", "file", "txt", "don", "stop"]
    assert value(spark, text.retrieval_tokens(t)) == ["read", "the_file", "./a/b.txt", "don", "t", "stop", "i"]
    assert value(spark, text.behavior_tokens(t)) == ["read", "the_file", "/a/b.txt", "don", "stop"]
    assert value(spark, text.bigrams(F.split(F.lit("a b c"), " "))) == ["a b", "b c"]
    assert value(spark, text.bigrams(F.split(F.lit("a"), " "))) == []
    assert value(spark, text.routing_text(F.lit(" Get__File:now \n x"))) == "get file now x"
    assert value(spark, text.tool_name(F.lit("--Get File!"))) == "get_file"
    assert value(spark, text.token_count(F.lit("a_b, c é!"))) == 5 and value(spark, text.token_count(F.lit(None).cast("string"))) == 0


def test_markers(spark):
    m = lambda x: value(spark, text.has_marker(F.lit(x), ("run", "api key")))
    assert [m(x) for x in ("run it", "re-run", "prune", "my api keys", "", "runs")] == [True, True, False, True, False, False]
