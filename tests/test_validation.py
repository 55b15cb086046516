import json

import pytest

from callmetrics.operators import validation as v


@pytest.mark.parametrize(("schema", "value", "want"), [
    ({"properties": {"path": {"type": "string"}, "content": {"type": "string"}}, "required": ["path", "content"]}, {"path": "a"}, {("$.content", "missing_required")}),
    ({"properties": {"path": {"type": "string"}}}, {"path": 7}, {("$.path", "type_mismatch")}),
    ({"properties": {"path": {"type": "string"}}}, {"path": "a"}, set()),
    ({"properties": {"n": {"type": "integer"}, "b": {"type": "number"}}}, {"n": 2.0, "b": True}, {("$.b", "type_mismatch")}),
    ({"additionalProperties": False}, {"x": 1}, {("$.x", "unknown_field")}), ({}, {"x": 1}, set()),
    ({"properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}}, {"a": [1, 3]}, {("$.a[1]", "enum_mismatch")}),
    ({"properties": {"a": {"type": ["string", "null"]}, "b": {"type": "string", "nullable": True}, "c": {"type": "string"}}}, {"a": None, "b": None, "c": None}, {("$.c", "null_value")}),
    ({"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "integer"}]}}}, {"a": []}, {("$.a", "no_choice")}),
    ({"properties": [{"name": "a", "properties": {"b": {"type": "boolean"}}}]}, {"a": {"b": 1}}, {("$.a.b", "type_mismatch")}), (True, {"a": 1}, set()),
])
def test_issues(schema, value, want):
    assert set(v.issues(schema, value)) == want


def test_rows(spark):
    arg = "array<struct<name:string,type:string,required:boolean,description:string,format:string,enum:array<string>,items_schema:string,properties:string>>"
    args = [("x", "string", True, None, None, None, None, None)]
    s = json.dumps({"properties": {"a": {"type": "string"}}, "required": ["a"]})
    rows = [("1", '{"a": "b"}', s, None), ("2", "{}", s, None), ("3", "[1]", s, None), ("4", None, s, None), ("5", '{"y": 1}', None, args), ("6", "{bad", s, None)]
    got = {tuple(r) for r in v.validated(spark.createDataFrame(rows, f"task_id string, expected string, schema string, arguments {arg}")).collect()}
    assert got == {("2", "$.a", "missing_required"), ("3", "$", "not_object"), ("5", "$.x", "missing_required"), ("5", "$.y", "unknown_field"), ("6", "$", "not_object")}


def test_canonical():
    assert v.canonical('{"b": 1.0, "a": " x \\n y "}') == v.canonical('{"a": "x y", "b": 1}') == '{"a":"x y","b":1}'
    assert v.canonical(None) is None and v.canonical("{") is None
