"""Nested semi-structured records to flat tables with parent-child links, by shared inlining.

The graph of elements decides the tables: an element gets a table of its own if it is a root, if it may occur several
times below its parent, if more than one element contains it (shared), or if it lies on a cycle (recursive). All other
elements are singleton descendants and become columns of the nearest ancestor that has a table. ``plan`` works that out for
any graph; ``shred`` applies it to JSON Schema documents.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a tool with a JSON Schema: (parent, member, child, occurs several times). Fixed by the JSON Schema vocabulary.
JSON_SCHEMA = (
    ("tool", "schema", "node", False),
    ("node", "properties", "node", True),
    ("node", "items", "node", True),
    ("node", "anyOf", "node", True),
    ("node", "oneOf", "node", True),
    ("node", "allOf", "node", True),
    ("node", "enum", "enum_value", True),
    ("node", "required", "required_name", True),
    ("node", "type", "type_name", True),
    ("node", "title", "title", False),
    ("node", "description", "description", False),
    ("node", "format", "format", False),
    ("node", "default", "default", False),
    ("node", "additionalProperties", "additionalProperties", False),
)
CHOICES = ("anyOf", "oneOf", "allOf")


@dataclass
class Plan:
    """tables: element -> columns inlined into it; links: (child table, parent table, member) for the foreign keys."""

    tables: dict[str, list[str]] = field(default_factory=dict)
    links: list[tuple[str, str, str]] = field(default_factory=list)


def plan(edges) -> Plan:
    """Tables, inlined columns and foreign keys for a graph of (parent, member, child, several) edges."""
    children, parents = defaultdict(list), defaultdict(set)
    elements = dict.fromkeys(x for p, _, c, _ in edges for x in (p, c))
    for p, m, c, several in edges:
        children[p].append((m, c, several))
        parents[c].add((p, m))

    def reachable(x: str) -> set[str]:
        seen, todo = set(), [x]
        while todo:
            for _, c, _ in children[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    several = {c for _, _, c, many in edges if many}
    own = {e for e in elements if not parents[e] or len({p for p, _ in parents[e]}) > 1 or e in several or e in reachable(e)}
    out = Plan({e: [] for e in elements if e in own})
    for e in out.tables:
        todo = [("", e)]
        while todo:
            at, x = todo.pop(0)
            for m, c, _ in children[x]:
                name = f"{at}{m}"
                if c in own:
                    out.links.append((c, e, name))
                else:
                    out.tables[e].append(name)
                    todo.append((f"{name}_", c))
    return out


def loads(text: str | None):
    """The JSON value of a text, None if there is none."""
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def root_of(text: str | None, arguments) -> dict:
    """The schema of a record: its text, unwrapped once if it is JSON in a JSON string, else rebuilt from its arguments."""
    value = loads(text)
    if isinstance(value, str):
        value = loads(value)
    if isinstance(value, dict):
        return value
    properties = {}
    for a in arguments() or []:
        if a is None or a.get("name") is None:
            continue
        node = {k: v for k, v in (("type", a.get("type")), ("description", a.get("description")), ("format", a.get("format")), ("enum", a.get("enum"))) if v is not None}
        for member, source in (("items", "items_schema"), ("properties", "properties")):
            if (part := loads(a.get(source))) is not None:
                node[member] = part
        properties[a["name"]] = node
    return {"type": "object", "properties": properties, "required": [a["name"] for a in arguments() or [] if a and a.get("required") and a.get("name") is not None]}


def children_of(path: str, node: dict) -> Iterator[tuple[str, str, str | None, int, object]]:
    """(path, member, name, ordinal, child) for each child of a schema node."""
    if isinstance(p := node.get("properties"), dict):
        for i, (name, x) in enumerate(p.items()):
            yield f"{path}.properties.{name}", "properties", name, i, x
    elif isinstance(p, list):
        for i, x in enumerate(p):
            if isinstance(x, dict) and isinstance(x.get("name"), str):
                yield f"{path}.properties.{x['name']}", "properties", x["name"], i, x
    if isinstance(p := node.get("items"), dict):
        yield f"{path}.items", "items", None, 0, p
    elif isinstance(p, list):
        for i, x in enumerate(p):
            yield f"{path}.items[{i}]", "items", None, i, x
    for member in CHOICES:
        if isinstance(p := node.get(member), list):
            for i, x in enumerate(p):
                yield f"{path}.{member}[{i}]", member, None, i, x


def text_of(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def strings(x) -> list[str]:
    return [text_of(v) or "null" for v in (x if isinstance(x, list) else [] if x is None else [x])]


INLINED = [c for c in plan(JSON_SCHEMA).tables["node"]]
#: Repeated leaves of a node, which the plan gives tables of their own.
REPEATED = tuple(m for c, p, m in plan(JSON_SCHEMA).links if p == "node" and c != "node")
NODE = pa.schema(
    [(c, pa.string()) for c in ("tool_id", "node_path", "parent_path", "member", "name")]
    + [("ordinal", pa.int32()), ("depth", pa.int32()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("first", pa.bool_())]
    + [(c, pa.string()) for c in INLINED]
    + [(c, pa.list_(pa.string())) for c in REPEATED]
)
KEYS = [c for c in NODE.names if c not in INLINED and c not in REPEATED]
NODE_SQL = ", ".join(f"`{f.name}` " + ("array<string>" if pa.types.is_list(f.type) else "int" if pa.types.is_int32(f.type) else "boolean" if pa.types.is_boolean(f.type) else "string") for f in NODE)


def parsed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each schema node, the root included, with inlined singletons as columns and repeated leaves as arrays.

    ``node_id`` numbers a record's nodes from 0, the root, and ``parent_id`` names the parent's; as names may hold dots, two nodes
    may have one spelled path, of which the one met first is ``first``.
    ``columns`` keeps only those, so that nothing else is built or moved.
    """
    kept = pa.schema([f for f in NODE if columns is None or f.name in columns])
    ddl = ", ".join(x for x, f in zip(NODE_SQL.split(", "), NODE) if f.name in kept.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inlined = [c for c in INLINED if c in kept.names]
        repeated = [c for c in REPEATED if c in kept.names]
        for b in batches:
            out: dict[str, list] = {c: [] for c in kept.names}
            add = {c: out[c].append if c in out else (lambda x: None) for c in NODE.names}
            arguments = b["arguments"]
            for k, (tool, text) in enumerate(zip(b["id"].to_pylist(), b["schema"].to_pylist())):
                root = root_of(text, lambda k=k: arguments[k].as_py())
                todo, seen, number = [("$", None, None, None, 0, 0, root, None)], set(), 0
                while todo:
                    path, parent, member, name, ordinal, depth, node, above = todo.pop()
                    known = node if isinstance(node, dict) else {}
                    values = (tool, path, parent, member, name, ordinal, depth, number, above, (path, parent) not in seen)
                    for c, v in zip(KEYS, values):
                        add[c](v)
                    for c in inlined:
                        add[c](text_of(known.get(c)))
                    for c in repeated:
                        add[c](strings(known.get(c)))
                    seen.add((path, parent))
                    todo.extend((p, path, m, n, o, depth + 1, x, number) for p, m, n, o, x in children_of(path, known))
                    number += 1
            yield pa.RecordBatch.from_pydict(out, schema=kept)

    return df.select("id", "schema", "arguments").mapInArrow(cut, ddl)


def latest(df: DataFrame, id_col: str, order_col: str | None, columns: dict[str, Column]) -> DataFrame:
    """One row an id: its last delivery, ties by the largest values; rows with a null id are left out."""
    value = F.struct(*([F.col(order_col).alias("at")] if order_col else []), *[c.alias(n) for n, c in columns.items()])
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(value).alias("v"))
    return rows.select("id", *[F.col(f"v.{n}").alias(n) for n in columns])


def sources(df: DataFrame, id_col: str = "tool_id", order_col: str | None = "collected_at") -> DataFrame:
    return latest(df, id_col, order_col, {"schema": F.col("input_schema_raw").cast("string"), "arguments": F.col("arguments")})


def nodes(df: DataFrame, id_col: str = "tool_id", order_col: str | None = "collected_at") -> DataFrame:
    """tool_id, node_path, parent_path of every node below the root: the recursive table's keys alone."""
    return parsed(sources(df, id_col, order_col), ["tool_id", "node_path", "parent_path", "first"]).where("parent_path IS NOT NULL AND first").drop("first")


def shred(df: DataFrame, id_col: str = "tool_id", order_col: str | None = "collected_at") -> dict[str, DataFrame]:
    """The tables of the plan, each with its keys.

    ``tool`` (tool_id), ``node`` (key tool_id + node_id, foreign key parent_id to itself, the spelled paths as columns), and of each
    node its ``enum_value``, ``required_name`` and ``type_name`` rows (foreign key tool_id + node_id, ordinal). Records
    delivered again count once; null ids are left out; schemas that are null, blank, cut off or not objects are rebuilt
    from ``arguments``, null arguments give a root without children; further columns are ignored. The tables are views of one
    relation: a caller that reads several of them keeps it first (``parsed(sources(df))`` in a checkpoint) and calls ``tables_of``.
    """
    return tables_of(parsed(sources(df, id_col, order_col)))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed nodes, as the plan's links say."""
    tables = {"tool": rows.where("parent_id IS NULL").select("tool_id", F.col("node_path").alias("root_path")), "node": rows.drop(*REPEATED, "first")}
    for child, parent, member in plan(JSON_SCHEMA).links:
        if child not in ("tool", "node"):
            tables[child] = rows.select("tool_id", "node_id", "node_path", F.posexplode(member).alias("ordinal", "value"))
    return tables
