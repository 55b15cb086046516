import json

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import calls
from callmetrics.sources import readers, schemas, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2, "z": 3}\n')
    bad = put(tmp_path / "b.jsonl", '{"a": 1}\n{"a": \n{"a": 4}\n')
    assert [r.a for r in readers.read_jsonl(spark, good, "a int").collect()] == [1, 2]
    assert sorted(r.a for r in readers.read_jsonl(spark, bad, "a int", strict=False).collect()) == [1, 4]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad, "a int").collect()


@pytest.mark.parametrize(("text", "n"), [
    ('[{"a": 1}, {"a": 2}, 3]', 2), ('{"data": [{"a": 1}]}', 1), ('{"tools": [{"a": 1}, {"a": 2}]}', 2), ('{"a": 1}', 1), ('{\n "a": 1,\n "b": {\n "c": 2}\n}', 1), ('{"a": 1}\n{"a": 2}\n\n{"a": 3}\n', 3), ("nothing", 0), ("", 0),
])
def test_documents(spark, tmp_path, text, n):
    assert readers.read_items(spark, put(tmp_path / "x.json", text)).count() == n


def test_tasks_with_aliases(spark, tmp_path):
    rows = [
        {"task_id": "t1", "tool_name": "a", "user_request": "do it", "expected_arguments": {"x": 1}}, {"id": "t2", "function": {"name": "b"}, "question": [{"role": "user", "content": "one"}, {"content": "two"}], "should_trigger": False, "partition": "dev"},
        {"uid": "t3", "function_name": "c", "prompt": "p", "ground_truth": {"arguments": {"y": "z"}}}, {"id": "t4", "tool_name": "d"}, {"id": "t5", "instruction": "x"}, {"tool_name": "e", "instruction": "named by hash"},
    ]
    got = {r.task_id: r for r in readers.read_tasks(spark, put(tmp_path / "t.json", json.dumps({"data": rows}))).collect()}
    assert set(got) - {"t1", "t2", "t3"} == {next(k for k in got if k.startswith("task_"))}
    assert got["t1"].gold == {"x": "1"} and got["t1"].split == "default" and got["t1"].should_trigger
    assert (got["t2"].tool_name, got["t2"].user_request, got["t2"].should_trigger, got["t2"].split) == ("b", "one\ntwo", False, "dev")
    assert got["t3"].gold == {"y": '"z"'}


def test_gold_candidates(spark):
    df = spark.createDataFrame([({"a": ["1", ""], "b": ["x", "y"]},), ({},), ({"a": []},)], "g map<string,array<string>>")
    keep, drop = (readers.gold_candidates(F.col("g"), d) for d in (False, True))
    rows = df.select(keep.alias("k"), drop.alias("d")).collect()
    assert rows[0].k == [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"a": "", "b": "x"}, {"a": "", "b": "y"}]
    assert rows[0].d == [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"b": "x"}, {"b": "y"}]
    assert rows[1].k == [{}] and rows[2].k == []


def test_csv_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'say "x", y')], "b int, a string, c string")
    sinks.write_csv(df, str(tmp_path / "out"), ["a", "b", "missing", "c"])
    back = readers.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["a", "b", "missing", "c"] and tuple(back.first()) == ("", "1", "", 'say "x", y')
    both = sinks.united([df, spark.createDataFrame([("q", 2)], "z string, b int")], ["z", "nope", "b"])
    assert both.columns == ["z", "b", "a", "c"] and both.count() == 2


def test_jsonl_sink_is_sorted_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, {"y": 2, "x": 1})], "b int, a map<string,int>")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"a":{"x":1,"y":2},"b":1}'] * 2


def test_preferred_paths(spark, tmp_path):
    put(tmp_path / "deep/er/r.jsonl", "")
    assert readers.preferred_paths(spark, str(tmp_path), "r.jsonl") == [f"file:{tmp_path}/deep/er/r.jsonl"]
    put(tmp_path / "predictors/m/merged/r.jsonl", "")
    assert readers.preferred_paths(spark, str(tmp_path), "r.jsonl") == [f"file:{tmp_path}/predictors/m/merged/r.jsonl"]
    put(tmp_path / "merged/r.jsonl", "")
    assert readers.preferred_paths(spark, str(tmp_path), "r.jsonl") == [f"file:{tmp_path}/merged/r.jsonl"]


def test_shard_recovery(spark, tmp_path):
    schema = "model_slug string, task_id string, tool_name string, baseline_name string, ok boolean"
    row = lambda t, ok: json.dumps({"model_slug": "m", "task_id": t, "tool_name": "x", "baseline_name": "b", "ok": ok})
    lines = put(tmp_path / "s.jsonl", row("1", True) + "\n" + row("2", True) + "\n{broken")
    put(tmp_path / "files/2.json", row("2", False))
    put(tmp_path / "files/3.json", row("3", False))
    got = {(r.task_id, r.ok) for r in readers.read_shard(spark, lines, str(tmp_path / "files"), schema).collect()}
    assert got == {("1", True), ("2", True), ("3", False)}


def test_skills(spark, tmp_path):
    path = put(tmp_path / "s.md", '# Title\n\n## Summary\nShort one.\n\n## When to use\n- first\n* second\n\n## When not to use\n- never\n\n```json\n{"b": 1, "a": 2}\n```\n')
    r = readers.read_skills(spark, path).first()
    assert (r.title, r.summary, r.when_to_use, r.when_not_to_use, r.argument_template) == ("Title", "Short one.", ["first", "second"], ["never"], '{"a":2,"b":1}')


def test_program_sources(spark, tmp_path):
    put(tmp_path / "py/a.py", 'class Args(BaseModel):\n    path: str\n    n: int = 3\n\nTool(name="read", description="Reads", inputSchema=Args.model_json_schema())\nTool(name="plain", inputSchema={"type": "object", "properties": {}})\nTool(description="no name")\n')
    put(tmp_path / "py/broken.py", "def (")
    rows = {r.name: r for r in readers.read_source(spark, "python_source", str(tmp_path / "py")).collect()}
    assert set(rows) == {"read", "plain"} and json.loads(rows["read"].input_schema) == {"type": "object", "properties": {"path": {"type": "string"}, "n": {"type": "integer"}}, "required": ["path"]}
    put(tmp_path / "ts/a.ts", 'server.registerTool("list", { description: "Lists (all) " + "files", inputSchema: { path: z.string(), deep: z.object({ a: z.number() }).optional(), n: z.number().default(1) } }, async () => {});')
    r = readers.read_source(spark, "typescript_source", str(tmp_path / "ts")).first()
    assert (r.name, r.description) == ("list", "Lists (all) files")
    assert json.loads(r.input_schema) == {"type": "object", "properties": {"path": {"type": "string"}, "deep": {"type": "object"}, "n": {"type": "number"}}, "required": ["path"]}


def test_dispatch(spark, tmp_path):
    assert readers.read_source(spark, "canonical_json", str(tmp_path / "none*.json")).count() == 0
    with pytest.raises(ValueError):
        readers.read_source(spark, "other", "x")
    path = put(tmp_path / "c.json", json.dumps({"tools": [{"name": "a", "inputSchema": {"type": "object"}}, {"name": "b", "inputSchema": "x"}, {"inputSchema": {}}]}))
    assert [r.name for r in readers.read_source(spark, "canonical_json", path).collect()] == ["a"]


def test_reports(spark):
    df = spark.createDataFrame([("a_b|c", None)], "x string, y int")
    assert sinks.markdown(df) == "| x | y |\n| --- | --- |\n| a_b\\|c |  |\n"
    assert "a\\_b|c &  \\\\\n" in sinks.latex(df)


def test_run_streams(spark, tmp_path):
    put(tmp_path / "merged/prediction_records.jsonl", '{"a": 1}\n\n[1]\n{"a": 2}\n')
    put(tmp_path / "predictors/m/prediction_records.jsonl", '{"a": 3}\n')
    put(tmp_path / "x/routing_records.jsonl", '{"b": 1}\n')
    put(tmp_path / "x/behavior_log.jsonl", '{"c": 1}\n{broken\n')
    got = readers.read_run(spark, str(tmp_path)).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"benchmark": 2, "routing": 1, "behavior": 1}


def test_config():
    base = {"a": {"x": 1, "y": 2}, "n": 3}
    assert readers.read_config('{"a": {"y": 5}, "m": true}', base, {"a.x": int, "m": bool}) == {"a": {"x": 1, "y": 5}, "n": 3, "m": True}
    with pytest.raises(ValueError, match="a.z"):
        readers.read_config("{}", base, {"a.z": int})


def test_reports_are_whole_or_an_error(spark):
    df = spark.range(5)
    assert sinks.markdown(df).count("\n") == 7
    with pytest.raises(ValueError):
        sinks.markdown(df, most=4)
    out = sinks.pdf(spark.range(130))
    assert out.startswith(b"%PDF-") and b"/Count 3" in out and out.count(b" Tj T*") == 131
    assert "5 records." in sinks.dataset_card(df, "x", ["id"])


def test_normalised_schemas(spark):
    text = json.dumps({"parameters": {"type": "dict", "properties": [{"name": "a", "type": "int"}, {"parameter_name": "b", "type": ["null", "str"], "enum": "x | y"}, "Some Text"], "required": ["a", "gone"], "odd": 1}})
    got = schemas.normalized(text)
    assert got["type"] == "object" and got["required"] == ["a"]
    assert got["properties"]["a"] == {"name": "a", "type": "integer"} or got["properties"]["a"]["type"] == "integer"
    assert got["properties"]["b"]["type"] == "string" and got["properties"]["b"]["enum"] == ["x", "y"] and got["properties"]["b"]["nullable"] and "some_text" in got["properties"]
    assert schemas.normalized(None) == schemas.normalized("{broken") == schemas.EMPTY
    sig = schemas.of_signature("f(self, a, b: int = g(1, 2), *args, c='x, y', d)")
    assert list(sig["properties"]) == ["a", "b", "c", "d"] and sig["required"] == ["a", "d"]
    assert schemas.of_signature("nothing")["properties"] == {}


def test_converters(spark, tmp_path):
    bfcl = put(tmp_path / "b.json", json.dumps([{"id": "1", "question": [[{"role": "user", "content": "area?"}]], "function": [{"name": "area", "description": "d", "parameters": {"type": "dict", "properties": {"r": {"type": "float"}}, "required": ["r"]}}], "ground_truth": {"r": [1]}}]))
    r = schemas.read_functions(spark, bfcl).first()
    assert (r.tool_name, r.user_request, r.gold_arguments) == ("area", "area?", '{"r":[1]}') and json.loads(r.input_schema)["properties"]["r"]["type"] == "number"
    bank = put(tmp_path / "a.json", json.dumps([{"name": "Add", "description": "adds", "input_parameters": {"x": {"type": "int"}}}, {"api_name": "Add", "input": "add one", "param_dict": {"x": 1}}, {"api_name": "Gone", "input": "nothing", "param_dict": {}}]))
    assert [(r.tool_name, r.user_request, r.gold_arguments) for r in schemas.read_api_bank(spark, bank).collect()] == [("Add", "add one", '{"x":1}')]
    bench = put(tmp_path / "t.json", json.dumps([{"query": "find it", "api_list": [{"api_name": "find", "api_description": "f", "required_parameters": [{"name": "q", "type": "STRING"}], "optional_parameters": [{"name": "n", "type": "NUMBER"}]}, {"api_name": "other"}], "relevant APIs": [["x", "find"]]}]))
    r = schemas.read_tool_bench(spark, bench).first()
    assert schemas.read_tool_bench(spark, bench).count() == 1 and json.loads(r.input_schema)["required"] == ["q"] and set(json.loads(r.input_schema)["properties"]) == {"q", "n"}


def test_nested_records(spark):
    rows = [json.dumps(x) for x in (
        {"condition": "c", "tool_name": "t", "reliability_score": {"features": {"token_overhead_estimate": 7}}, "behavior_report": {"results": [{"case_id": "1", "triggered": True}, 3, {"task_id": "2", "tool_name": "own"}]}}, {"condition": "none"},
        {"latency_ms": "bad", "prediction_metadata": {"latency_ms": 4}}, {"prediction_metadata": {"latency_ms": 4}}, {"predicted_arguments": {}, "argument_parse_ok": True}, {"predicted_arguments": [], "error": None}, {"should_trigger": False, "triggered": False})]
    df = spark.createDataFrame([(x,) for x in rows], "j string").select(F.parse_json("j").alias("item"))
    flat = {(r.baseline_name, r.tool_name, r.task_id, r.token_overhead_estimate) for r in calls.flattened(df).collect()}
    assert flat == {("c", "t", "1", 7.0), ("c", "own", "2", 7.0)}
    v = F.col("item")
    assert [r[0] for r in df.select(calls.first_present(v, calls.LATENCY)).collect()] == [None, None, None, 4.0, None, None, None]
    assert [r[0] for r in df.select(calls.parse_ok(v)).collect()] == [False, False, False, False, True, False, True]
