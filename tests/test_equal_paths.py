import json

from callmetrics.operators import inlining as il
from tests.test_inlining import SCHEMA, paths


def test_nodes_of_equal_path_keep_their_children(spark):
    """A dotted name that spells another node's path, and two list-form properties of one name."""
    dotted = {"properties": {"a": {"items": {"anyOf": [{}]}}, "a.items": {"properties": {"b": {}}}}}
    twice = {"properties": [{"name": "a", "items": {}}, {"name": "a", "properties": {"b": {}}}]}
    got = paths(spark.createDataFrame([("dotted", json.dumps(dotted), None, 1), ("twice", json.dumps(twice), None, 1)], SCHEMA))
    a = "$.properties.a"
    assert got == {
        ("dotted", a, "$"), ("dotted", f"{a}.items", a), ("dotted", f"{a}.items", "$"), ("dotted", f"{a}.items.anyOf[0]", f"{a}.items"), ("dotted", f"{a}.items.properties.b", f"{a}.items"),
        ("twice", a, "$"), ("twice", f"{a}.items", a), ("twice", f"{a}.properties.b", a),
    }


def test_rows_stay_distinct(spark):
    schema = {"properties": [{"name": "a"}, {"name": "a"}]}
    assert il.nodes(spark.createDataFrame([("t", json.dumps(schema), None, 1)], SCHEMA)).count() == 1


def test_nodes_of_one_path_keep_their_subtrees_and_leaves(spark):
    """Numbers tell them apart where paths don't: nothing below or of either is lost."""
    schema = '{"properties":{"a":{"properties":{"b":{"type":"object","enum":[1],"properties":{"c":{}}}}},"a.properties.b":{"type":"string","enum":[2,3],"properties":{"d":{}}}}}'
    df = spark.createDataFrame([("t", schema, None, 1)], "tool_id string, input_schema_raw string, arguments array<struct<name:string>>, collected_at int")
    paths = {r.node_path for r in il.nodes(df).collect()}
    assert {"$.properties.a.properties.b.properties.c", "$.properties.a.properties.b.properties.d"} <= paths
    t = il.shred(df)
    node = {r.node_id: r for r in t["node"].collect()}
    assert len(node) == 6 and all(r.parent_id in node for r in node.values() if r.node_id)
    twins = [i for i, r in node.items() if r.node_path == "$.properties.a.properties.b"]
    assert len(twins) == 2 and sorted(r.value for r in t["enum_value"].collect()) == ["1", "2", "3"]
    assert {r.node_id for r in t["enum_value"].collect()} == set(twins)
