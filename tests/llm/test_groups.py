import random

from callmetrics.llm import groups, queries
from test_overlap import brute, made


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(7, 7)]
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items() if k != v}


def test_groups(spark):
    rows = made(7, 120) + [("z1", "one two three four five six seven eight"), ("z2", "eight seven six five four three two one")]
    want = roots(brute(rows))
    got = groups.near_groups(spark.createDataFrame(rows, "id string, text string")).collect()
    assert {r.id: r.group_id for r in got} == want
    classes = {r.id: r for r in got}
    assert classes["z2"].class_id == "z1" and classes["z2"].links == 0


def test_empty(spark):
    assert groups.near_groups(spark.createDataFrame([], "id string, text string")).count() == 0


def test_on_the_test_data(spark, sf):
    want = roots({(r.id_a, r.id_b) for r in queries.p4_found(spark, sf).where("kind = 'tool'").collect()})
    assert {r.id: r.group_id for r in queries.p4_groups(spark, sf).where("kind = 'tool'").collect()} == want
