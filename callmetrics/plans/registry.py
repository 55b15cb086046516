"""All queries of the core and the SQL they are checked against."""

from __future__ import annotations

from callmetrics.plans import generation, nested, records, retrieval, routing, summaries, tasks, tools

MODULES = (records, tools, tasks, routing, retrieval, summaries, generation, nested)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
