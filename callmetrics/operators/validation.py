"""Arguments held against a JSON Schema: issues with their paths, for schemas nested as deep as they come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from callmetrics.operators.inlining import CHOICES, loads, root_of

#: Python types of JSON Schema's types; a boolean is no number.
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
ISSUE = "task_id string, path string, code string"


def types_of(schema: dict) -> list[str]:
    t = schema.get("type")
    return [x for x in (t if isinstance(t, list) else [t]) if x in KINDS]


def fits(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, KINDS[kind])


def issues(schema, value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, code): missing_required, unknown_field, type_mismatch, enum_mismatch, null_value, no_choice.

    A property list counts like an object, each entry by its name. Where one of several schemas must hold, any without
    issues will do.
    """
    todo = [(path, schema, value)]
    while todo:
        at, s, v = todo.pop()
        if not isinstance(s, dict):
            continue
        kinds = types_of(s)
        if v is None:
            if kinds and "null" not in kinds and not s.get("nullable"):
                yield at, "null_value"
            continue
        if kinds and not any(fits(v, k) for k in kinds):
            yield at, "type_mismatch"
            continue
        if isinstance(s.get("enum"), list) and s["enum"] and v not in s["enum"]:
            yield at, "enum_mismatch"
        for member in CHOICES[:2]:
            if isinstance(options := s.get(member), list) and options and not any(next(issues(o, v, at), None) is None for o in options):
                yield at, "no_choice"
        if isinstance(v, dict):
            p = s.get("properties")
            p = {x["name"]: x for x in p if isinstance(x, dict) and isinstance(x.get("name"), str)} if isinstance(p, list) else p if isinstance(p, dict) else {}
            required = s.get("required")
            for name in required if isinstance(required, list) else []:
                if isinstance(name, str) and name not in v:
                    yield f"{at}.{name}", "missing_required"
            for name, x in v.items():
                if name in p:
                    todo.append((f"{at}.{name}", p[name], x))
                elif p or s.get("additionalProperties") is False:
                    yield f"{at}.{name}", "unknown_field"
        elif isinstance(v, list):
            items = s.get("items")
            for i, x in enumerate(v):
                todo.append((f"{at}[{i}]", items[i] if isinstance(items, list) and i < len(items) else items, x))


def validated(df: DataFrame) -> DataFrame:
    """A row for each issue of (task_id, expected, schema, arguments); what isn't an object is ``not_object`` at the root.

    Null arguments are left out, a schema that can't be read is rebuilt from ``arguments``.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (task, expected, text) in enumerate(zip(b["task_id"].to_pylist(), b["expected"].to_pylist(), b["schema"].to_pylist())):
                value = loads(expected)
                if not isinstance(value, dict):
                    rows.append((task, "$", "not_object"))
                    continue
                try:
                    rows += [(task, p, c) for p, c in issues(root_of(text, lambda k=k: b["arguments"][k].as_py()), value)]
                except RecursionError:
                    rows.append((task, "$", "too_deep"))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("task_id", "path", "code"))}, pa.schema([(n, pa.string()) for n in ("task_id", "path", "code")]))

    return df.where("expected IS NOT NULL").select("task_id", "expected", "schema", "arguments").mapInArrow(check, ISSUE)


def canonical(text: str | None) -> str | None:
    """Sorted members, white space collapsed in strings, whole floats as integers; None if it can't be parsed."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return " ".join(x.split()) if isinstance(x, str) else int(x) if isinstance(x, float) and x.is_integer() else x

    value = loads(text)
    return None if value is None else json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
