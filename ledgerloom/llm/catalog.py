"""All queries of this subpackage, by name."""

from __future__ import annotations

from ledgerloom.llm import queries as problems

MODULES = (problems,)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
