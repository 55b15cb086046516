"""Queries that must do their whole job, against counts or SQL of their own."""

import datetime

import pytest

import __spark_entry__ as entry
from callmetrics.plans import tools as plans

QUERIES = entry.queries()


@pytest.fixture
def duck():
    duckdb = pytest.importorskip("duckdb")
    return lambda sf, *names: [c := duckdb.connect(), *[c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'") for n in names]][0]


def test_d8_every_query_tool_meets_every_similar_tool(spark, sf, duck):
    """Also query tools that aren't the smallest of their name, and tools of the same name."""
    name = f"list_sort(list_distinct({plans.DIST(plans.NAME('tool_name'))}))"
    want = duck(sf, "tools").execute(f"""{plans.W}, n AS (SELECT tool_id, {name} AS w FROM tl)
        SELECT * FROM (SELECT a.tool_id, b.tool_id, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 4) AS s FROM n a, n b
        WHERE len(a.w) > 0 AND len(b.w) > 0 AND a.tool_id <> b.tool_id AND regexp_extract(a.tool_id, '([0-9]+)$', 1)::BIGINT % 20 = 0) WHERE s >= 0.7""").fetchall()
    got = [tuple(r) for r in QUERIES["d8_similar_names"](spark, sf).select("query_id", "tool_id", "similarity").collect()]
    assert want and sorted(got) == sorted(want)


def test_d8_shared_name(spark, tmp_path):
    names = {"tl-0000000001": "send_red_note", "tl-0000000020": "SendRedNote", "tl-0000000040": "send red note", "tl-0000000007": "other_thing"}
    spark.createDataFrame([(k, v) for k, v in names.items()], "tool_id string, tool_name string").write.parquet(f"{tmp_path}/tools.parquet")
    got = {(r["query_id"][-2:], r["tool_id"][-2:]) for r in QUERIES["d8_similar_names"](spark, str(tmp_path)).collect()}
    assert {("40", "01")} <= got


def test_f10_every_tool_has_three_distractors_of_its_domain(spark, sf, duck):
    """The next three tools of the domain in a ring by hash, or all others where there are fewer."""
    rows = duck(sf, "tools").execute(f"{plans.FEAT} SELECT tool_id, clean_domain, md5('9|' || tool_id) FROM ft").fetchall()
    rings, want = {}, set()
    for i, domain, k in rows:
        rings.setdefault(domain, []).append((k, i))
    for ring in rings.values():
        ids = [i for _, i in sorted(ring)]
        want |= {(x, r, ids[(at + r + 1) % len(ids)]) for at, x in enumerate(ids) for r in range(min(3, len(ids) - 1))}
    got = [tuple(r) for r in QUERIES["f10_distractors"](spark, sf).select("tool_id", "rank", "distractor").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def outcomes(spark, path, rows):
    """Prediction records (condition, task, whether right) of one model."""
    cols = "record_id long, task_id string, tool_name string, baseline_name string, model_slug string, should_trigger boolean, triggered boolean, selected_tool_name string, exact_match boolean, argument_validity double, required_argument_recall double, hallucinated_args array<string>, joint_exact_match boolean, latency_ms double, prompt_tokens int, created_at timestamp, ingested_at timestamp"
    at = datetime.datetime(2026, 1, 1)
    full = [(i, t, "a", b, "m", True, True, "a", ok, 1.0, 1.0, [], ok, 1.0, 1, at, at) for i, (b, t, ok) in enumerate(rows)]
    spark.createDataFrame(full, cols).write.parquet(f"{path}/predictions.parquet")
    return str(path)


def test_i5_smallest_p_of_500_iterations(spark, tmp_path):
    """SURVEY's floor of 1 / 501."""
    d = outcomes(spark, tmp_path, [(b, f"t{i}", b == "skill_v1") for i in range(200) for b in ("skill_v1", "other")])
    assert [r["p_value"] for r in QUERIES["i5_randomization"](spark, d).collect()] == [0.001996]


def test_i2_intervals_are_rates_of_resamples(spark, tmp_path):
    """Of a small condition every bound is a number of hits over n, and near 0 and 1 as skew as the binomial's."""
    hits = {"few": (2, 7), "rare": (1, 100), "sure": (5, 5)}
    d = outcomes(spark, tmp_path, [(b, f"t{i}", i < k) for b, (k, n) in hits.items() for i in range(n)])
    got = {r["baseline_name"]: (r["low"], r["high"]) for r in QUERIES["i2_bootstrap"](spark, d).collect()}
    assert all(x in [round(j / hits[b][1], 4) for j in range(hits[b][1] + 1)] for b, bounds in got.items() for x in bounds)
    # quantiles of the binomial: (0, 5 of 7), (0, 3 of 100), at 500 draws a neighbour of the upper one at most
    assert got["few"][0] == 0 and got["few"][1] in (0.5714, 0.7143) and got["rare"][0] == 0 and got["rare"][1] in (0.03, 0.04) and got["sure"] == (1, 1)


def test_m2_every_vector_has_its_nearest_label(spark, sf, duck):
    """Every vector has a row."""
    sql = plans.SQL["m2_cosine"]
    want = duck(sf, "embeddings").execute(sql).fetchall()
    got = [tuple(r) for r in QUERIES["m2_cosine"](spark, sf).select("vec_id", "near", "cosine").collect()]
    key = lambda r: (r[0], r[1], f"{r[2]:.5f}")
    assert want and sorted(map(key, got)) == sorted(map(key, want))
