"""All named queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from memlake.plans import extras, graph, messages, more, problems, records, retrieval

MODULES = [problems, records, messages, graph, extras, more, retrieval]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
