"""Scans: JSON lines and documents, aliased task files, CSV, shards with recovered files, markdown and program sources."""

from __future__ import annotations

import ast
import fnmatch
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members that may hold the list of a JSON document, in the order tried.
WRAPPERS = ("data", "items", "tools", "records", "examples", "tasks", "controls", "results", "functions", "apis")


def read_jsonl(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped. Strict scans raise on a line that can't be parsed, others drop it."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    kept = [f.name for f in rows.schema if f.name != bad]
    return rows.select("*", F.lit(1).alias("_")).where(F.col(bad).isNull()).select(kept)


def member(v: Column, *names: str, kind: str = "string") -> Column:
    """The first of the members that is there and not null."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def read_items(spark: SparkSession, path) -> DataFrame:
    """``item`` (variant) for each object of JSON files: a list, a list under a wrapper member, one object, or JSON lines.

    A file is JSON lines if it has several lines that aren't blank and its first one is a whole object by itself.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    files = files.select("value", lines.alias("lines")).withColumn("by_line", (F.size("lines") > 1) & F.try_element_at("lines", F.lit(1)).rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json(F.try_element_at("lines", F.lit(1))).isNotNull())
    v = F.try_parse_json("value")
    whole = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{w}", "array<variant>") for w in WRAPPERS], F.array(v))
    items = F.when(F.col("by_line"), F.transform("lines", F.try_parse_json)).otherwise(whole)
    return files.select(F.explode(items).alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))


def read_tasks(spark: SparkSession, path) -> DataFrame:
    """Tasks under any of their alias keys: task_id, tool_name, user_request, should_trigger, split, gold (map of JSON texts).

    A tool may be a name or an object with one, a request a text or a list of messages; tasks without either are dropped.
    """
    v = F.col("item")
    text = F.coalesce(*[
        F.coalesce(F.array_join(F.transform(F.try_variant_get(v, f"$.{n}", "array<variant>"), lambda m: F.try_variant_get(m, "$.content", "string")), "\n"), F.try_variant_get(v, f"$.{n}", "string"))
        for n in ("user_request", "question", "prompt", "instruction", "query")
    ])
    named = [F.try_variant_get(v, f"$.{n}.name", "string") for n in ("tool", "function", "tool_name")] + [F.try_variant_get(v, f"$.{n}", "string") for n in ("tool_name", "function_name", "tool", "function", "negative_target")]
    gold = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "map<string,variant>") for n in ("expected_arguments", "arguments", "ground_truth.arguments", "ground_truth", "expected", "answer")])
    rows = read_items(spark, path).select(
        member(v, "task_id", "id", "uid").alias("task_id"), F.coalesce(*named).alias("tool_name"), text.alias("user_request"),
        F.coalesce(member(v, "should_trigger", "trigger_expected", kind="boolean"), F.lit(True)).alias("should_trigger"),
        F.coalesce(member(v, "split", "partition"), F.lit("default")).alias("split"), F.transform_values(gold, lambda k, x: F.to_json(x)).alias("gold"),
    )
    rows = rows.withColumn("task_id", F.coalesce("task_id", F.concat(F.lit("task_"), F.substring(F.md5(F.concat_ws("|", "tool_name", "user_request")), 1, 12))))
    return rows.where("tool_name <> '' AND user_request <> ''")


def gold_candidates(gold: Column, drop_empty: bool = False) -> Column:
    """All maps that take one value of each list of a map<string, array<string>>: their cartesian product, in order of keys.

    With ``drop_empty`` null and empty values stand for an argument left out.
    """
    left_out = lambda m, e, x: F.when(x.isNull() | (x == ""), m).otherwise(F.map_concat(m, F.create_map(e["key"], x)))
    add = lambda m, e: F.transform(e["value"], lambda x: left_out(m, e, x) if drop_empty else F.map_concat(m, F.create_map(e["key"], x)))
    start = F.array(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.aggregate(F.array_sort(F.map_entries(gold)), start, lambda out, e: F.flatten(F.transform(out, lambda m: add(m, e))))


def read_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as strings, names from the header; an empty field is an empty string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on whatever file system they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(x.getPath().toString()) for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def below(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files below a folder whose names match a pattern, at any depth."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = fs.listFiles(path, True), []
    while fs.exists(path) and files.hasNext():
        p = files.next().getPath()
        if fnmatch.fnmatch(p.getName(), pattern):
            out.append(str(p.toString()))
    return sorted(out)


def preferred_paths(spark: SparkSession, root: str, filename: str) -> list[str]:
    """The file in the root, else in ``merged``, else each predictor's merged one, else wherever it is below the root."""
    for pattern in (filename, f"merged/{filename}", f"predictors/*/merged/{filename}"):
        if found := listed(spark, f"{root}/{pattern}"):
            return found
    return below(spark, root, filename)


STREAMS = {"benchmark": "prediction_records.jsonl", "routing": "routing_records.jsonl", "reliability": "reliability_records.jsonl"}


def read_run(spark: SparkSession, root: str) -> DataFrame:
    """The record streams of a run as one relation: record_type and ``item`` (variant).

    Three streams have a file name each, at their preferred paths; all other JSON lines named after behaviour or controls are
    the fourth. Blank lines and lines that are no objects are dropped; a run without files gives no row.
    """
    paths = {kind: preferred_paths(spark, root, name) for kind, name in STREAMS.items()}
    paths["behavior"] = [p for p in below(spark, root, "*.jsonl") if (name := p.rsplit("/", 1)[-1].lower()) not in STREAMS.values() and ("behavior" in name or "control" in name)]
    out = spark.createDataFrame([], "record_type string, value string")
    for kind, found in paths.items():
        if found:
            out = out.unionByName(spark.read.text(found).select(F.lit(kind).alias("record_type"), "value"))
    return out.select("record_type", F.try_parse_json("value").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))


def merged(base: dict, over: dict) -> dict:
    """A configuration with another laid over it: objects are merged member by member, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def read_config(text: str, base: dict | None = None, required: dict[str, type] | None = None) -> dict:
    """A JSON configuration over its defaults; a required member (its path with dots) that is missing or of another type is an error."""
    out = merged(base or {}, json.loads(text))
    for path, kind in (required or {}).items():
        at = out
        for k in path.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if not isinstance(at, kind) or (isinstance(at, bool) and kind is not bool):
            raise ValueError(f"configuration: {path} must be {kind.__name__}")
    return out


SHARD_KEY = ["model_slug", "task_id", "tool_name", "baseline_name"]


def read_shard(spark: SparkSession, lines_path: str, files_path: str, schema: str) -> DataFrame:
    """Records of a shard's JSON lines, and those of its single-task files whose key the lines don't have."""
    lines = read_jsonl(spark, lines_path, schema, strict=False)
    single = spark.read.schema(schema).option("multiLine", True).json(files_path)
    return lines.unionByName(single.join(lines.select(*SHARD_KEY).distinct(), SHARD_KEY, "left_anti").dropDuplicates(SHARD_KEY).select(lines.columns))


def read_skills(spark: SparkSession, path) -> DataFrame:
    """Markdown skills: title, summary, bullets of both boundary sections and the first JSON block."""
    t = F.regexp_replace("value", r"\r", "")
    section = lambda name: F.regexp_extract(t, rf"(?is)(?:^|\n)##+[ \t]*{name}[ \t]*\n(.*?)(?=\n##|$)", 1)
    bullets = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1)), F.trim)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(t, r"(?m)^#\s+(.+?)\s*$", 1).alias("title"), F.regexp_replace(section("summary"), r"^\s+|\s+$", "").alias("summary"), bullets(section("when to use")).alias("when_to_use"),
        bullets(section("when not to use")).alias("when_not_to_use"), F.to_json(F.try_parse_json(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))).alias("argument_template"),
    )


TOOL_ROWS = "name string, description string, input_schema string"


def scanned(spark: SparkSession, path, scan: Callable[[str], list[dict]]) -> DataFrame:
    """Tools a scanner finds in each source file."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t["name"], t.get("description"), json.dumps(t["schema"], sort_keys=True)) for text in b["value"] for t in scan(text or "")]
            yield pd.DataFrame(rows, columns=["name", "description", "input_schema"])

    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).mapInPandas(cut, TOOL_ROWS)


#: JSON types of annotations and validators.
TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "string": "string", "number": "number", "boolean": "boolean", "array": "array", "object": "object", "enum": "string"}


def scan_python(text: str) -> list[dict]:
    """``Tool(name=..., description=..., inputSchema=...)`` calls; a schema may be a literal or a model class of the file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    models, names = {}, {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            fields = [s for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
            kinds = {s.target.id: {"type": TYPES.get(re.split(r"[\[ |]", ast.unparse(s.annotation))[0], "string")} for s in fields}
            models[node.name] = {"type": "object", "properties": kinds, "required": [s.target.id for s in fields if s.value is None]}
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant):
            names |= {t.id: node.value.value for t in node.targets if isinstance(t, ast.Name)} | {t.attr: node.value.value for t in node.targets if isinstance(t, ast.Attribute)}

    def value(x):
        try:
            return ast.literal_eval(x)
        except (ValueError, TypeError):
            used = [n.id for n in ast.walk(x) if isinstance(n, ast.Name)] + [n.attr for n in ast.walk(x) if isinstance(n, ast.Attribute)]
            return next((models[u] for u in used if u in models), next((names[u] for u in used if u in names), None))

    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "Tool":
            given = {k.arg: value(k.value) for k in node.keywords}
            if isinstance(given.get("name"), str):
                schema = given.get("inputSchema") or given.get("input_schema")
                out.append({"name": given["name"], "description": given.get("description"), "schema": schema if isinstance(schema, dict) else {"type": "object", "properties": {}}})
    return out


def enclosed(text: str, at: int) -> str:
    """What the bracket at a place encloses; brackets within strings don't count."""
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[at + 1 : i]
        i += 1
    return text[at + 1 :]


def scan_typescript(text: str) -> list[dict]:
    """``registerTool("name", {description, inputSchema: {field: z.kind()...}})`` calls."""
    out = []
    for m in re.finditer(r"\bregisterTool\s*\(", text):
        body = enclosed(text, m.end() - 1)
        name = re.match(r"""\s*(["'`])(.+?)\1""", body, re.S)
        if not name:
            continue
        said = re.search(r"""\bdescription\s*:\s*((?:(["'`])(?:\\.|(?!\2).)*\2\s*\+?\s*)+)""", body, re.S)
        description = "".join(x[1] for x in re.findall(r"""(["'`])((?:\\.|(?!\1).)*)\1""", said[1], re.S)) if said else None
        start = re.search(r"\binputSchema\s*:\s*(?:z\.object\s*\(\s*)?\{", body)
        inside = enclosed(body, start.end() - 1) if start else ""
        fields = list(re.finditer(r"(\w+)\s*:\s*z\s*\.\s*(\w+)\s*\(", inside))
        top = [f for f in fields if inside[: f.start()].count("{") == inside[: f.start()].count("}") and inside[: f.start()].count("(") == inside[: f.start()].count(")")]
        properties, required = {}, []
        for f, after in zip(top, [*[t.start() for t in top[1:]], len(inside)]):
            properties[f[1]] = {"type": TYPES.get(f[2], "string")}
            if not re.search(r"\.\s*(optional|default|nullish)\s*\(", inside[f.start() : after]):
                required.append(f[1])
        out.append({"name": name[2], "description": description, "schema": {"type": "object", "properties": properties, "required": required}})
    return out


def read_canonical(spark: SparkSession, path) -> DataFrame:
    """Tool exports: a name and a schema that is an object are required."""
    v = F.col("item")
    rows = read_items(spark, path).select(
        member(v, "name", "tool_name").alias("name"), member(v, "description", "summary").alias("description"),
        F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in ("inputSchema", "input_schema", "parameters")]).alias("s"),
    )
    return rows.where(F.col("name").isNotNull() & F.schema_of_variant("s").startswith("OBJECT")).select("name", "description", F.to_json("s").alias("input_schema"))


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "canonical_json": read_canonical, "python_source": lambda s, p: scanned(s, p, scan_python), "typescript_source": lambda s, p: scanned(s, p, scan_typescript),
}


def read_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Tools of a source by its type; a path that isn't there gives no row, an unknown type an error."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source type: {kind}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path):
        return spark.createDataFrame([], TOOL_ROWS)
    return SOURCES[kind](spark, path)
