import json

from pyspark.sql import functions as F

from callmetrics.operators import inlining as il

ARG = "struct<name:string,type:string,required:boolean,description:string,format:string,enum:array<string>,items_schema:string,properties:string>"
SCHEMA = f"tool_id string, input_schema_raw string, arguments array<{ARG}>, collected_at int"


def paths(df):
    return {(r.tool_id, r.node_path, r.parent_path) for r in il.nodes(df).collect()}


def test_plan_of_a_graph():
    """Shared, repeated and recursive elements get tables; singletons are inlined, through one another."""
    p = il.plan([("book", "title", "title", False), ("book", "author", "person", False), ("book", "chapter", "chapter", True), ("review", "by", "person", False), ("person", "name", "name", False), ("name", "first", "first", False), ("chapter", "part", "part", False), ("part", "of", "chapter", False)])
    assert p.tables == {"book": ["title"], "person": ["name", "name_first"], "chapter": [], "review": [], "part": []}
    assert ("person", "book", "author") in p.links and ("person", "review", "by") in p.links and ("chapter", "book", "chapter") in p.links


def test_children(spark):
    schema = {"properties": {"a.b": {"type": "array", "items": [{"anyOf": [{"type": "string"}, True]}, {}]}, "c": {"items": {"properties": [{"name": "d", "allOf": [{}]}, {"type": "x"}, 3]}}, "e": False, "f": {"items": True}}}
    got = paths(spark.createDataFrame([("t", json.dumps(schema), None, 1)], SCHEMA))
    a, c = "$.properties.a.b", "$.properties.c"
    assert got == {("t", *x) for x in [
        (a, "$"), (f"{a}.items[0]", a), (f"{a}.items[1]", a), (f"{a}.items[0].anyOf[0]", f"{a}.items[0]"), (f"{a}.items[0].anyOf[1]", f"{a}.items[0]"),
        (c, "$"), (f"{c}.items", c), (f"{c}.items.properties.d", f"{c}.items"), (f"{c}.items.properties.d.allOf[0]", f"{c}.items.properties.d"), ("$.properties.e", "$"), ("$.properties.f", "$"),
    ]}


def test_sources_of_a_schema(spark):
    args = [("x", "array", True, None, None, None, '{"properties": {"y": {}}}', None), ("z", "object", False, "d", None, ["1"], "{bad", '{"w": {}}'), (None, "s", None, None, None, None, None, None), None]
    rows = [(k, s, args, 1) for k, s in (("null", None), ("blank", " "), ("cut", '{"a":'), ("list", "[1]"), ("twice", json.dumps(json.dumps(json.dumps({})))), ("jsonnull", "null"))]
    rows += [("once", json.dumps(json.dumps({"properties": {"q": {}}})), args, 1), ("none", None, None, 1), (None, "{}", args, 1), ("deep", "[" * 200_000, args, 1)]
    got = paths(spark.createDataFrame(rows, SCHEMA))
    rebuilt = {("$.properties.x", "$"), ("$.properties.x.items", "$.properties.x"), ("$.properties.x.items.properties.y", "$.properties.x.items"), ("$.properties.z", "$"), ("$.properties.z.properties.w", "$.properties.z")}
    assert got == {(k, *x) for k in ("null", "blank", "cut", "list", "twice", "jsonnull", "deep") for x in rebuilt} | {("once", "$.properties.q", "$")}


def test_deliveries_and_depth_and_clashing_columns(spark):
    deep = {}
    for _ in range(400):
        deep = {"items": deep}
    rows = [("t", '{"properties": {"old": {}}}', None, 1), ("t", '{"properties": {"new": {}}}', None, 2), ("t", '{"properties": {"new": {}}}', None, 2), ("d", json.dumps(deep), None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("id", "schema", "node_path", "v", "at")})
    got = paths(df)
    assert {x for x in got if x[0] == "t"} == {("t", "$.properties.new", "$")} and sum(x[0] == "d" for x in got) == 400


def test_tables_link_up(spark, sf):
    tables = il.shred(spark.read.parquet(f"{sf}/tools.parquet"))
    assert set(tables) == {"tool", "node", "enum_value", "required_name", "type_name"}
    node = tables["node"]
    assert node.count() == node.select("tool_id", "node_path").distinct().count()
    parents = node.select("tool_id", F.col("node_path").alias("parent_path"))
    assert node.where("parent_path IS NOT NULL").join(parents, ["tool_id", "parent_path"], "left_anti").count() == 0
    for t in ("enum_value", "required_name", "type_name"):
        assert tables[t].count() and tables[t].join(node, ["tool_id", "node_path"], "left_anti").count() == 0


def test_empty(spark):
    assert il.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
