import json

from pyspark.sql import functions as F

from callmetrics.llm import formatting, queries

SCHEMA = "tool_id string, tool_name string, server_name string, tool_purpose string, input_schema_raw string"


def rows(spark):
    return spark.createDataFrame([
        ("b", "get_x", "srv", "Does it.", '{"a": 1, "b": [1.0]}'), ("a", "GET x", "SRV", "does-it", '{"b":[1],"a":1}'), ("a", "GET x", "SRV", "does-it", '{"b":[1],"a":1}'),
        ("c", "get_x", "srv", "Does it.", '{"a": 1, "b": [1.0]}'), ("d", "get_x", "srv", "Does it.", '{"a": 1, "b": [1, 2]}'),
        ("e", None, None, None, None), ("f", "", "!", " ", None), ("g", "", "", "", "null"), ("h", "", "", "", "{bad"), ("i", "-", "", "", "{bad"), ("j", "", "", "", "{bad "),
        (None, "get_x", "srv", "Does it.", None), ("k", "x" * 200_000, "", "", ""), ("l", "X" * 200_000, "", "", ""),
    ], SCHEMA)


def test_sets_and_counts(spark):
    df = rows(spark).withColumns({c: F.lit("z") for c in ("raw", "canon", "copies", "first_id", "id")})
    assert {(r.keeper_id, r.copies) for r in formatting.collapsed(df).collect()} == {("a", 3), ("d", 1), ("e", 2), ("g", 1), ("h", 2), ("j", 1), ("k", 2)}
    assert {(r.keeper_id, r.copy_id) for r in formatting.copies(df).collect()} == {("a", "b"), ("a", "c"), ("e", "f"), ("h", "i"), ("k", "l")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert formatting.collapsed(none).count() == formatting.copies(none).count() == 0


def test_canonical_json():
    same = formatting.canonical_json
    assert same('{"a":1.0,"b":[true,null]}') == same(' { "b" : [true, null], "a" : 1 } ')
    assert same("1") != same("true") and same("null") != same(None) and same("[1,2]") != same("[2,1]")
    assert same('"{}"') != same("{}") and same("x") == "!x" and same("[" * 100_000).startswith("!")


def test_found_agrees_with_brute_force(spark, sf):
    recs = {r.tool_id: r for r in spark.read.parquet(f"{sf}/tools.parquet").collect()}

    def key(r):
        letters = tuple("".join(c for c in (x or "").lower() if c.isalnum()) for x in (r.tool_name, r.server_name, r.tool_purpose))
        try:
            return letters, 1, json.dumps(json.loads(r.input_schema_raw), sort_keys=True)
        except (TypeError, ValueError):
            return letters, 0, r.input_schema_raw

    sets = {}
    for i in sorted(recs):
        sets.setdefault(key(recs[i]), []).append(i)
    want = {(s[0], x) for s in sets.values() for x in s[1:]}
    assert {(r.keeper_id, r.copy_id) for r in queries.p1_found(spark, sf).collect()} == want
