"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .common import Query

MODULES = ("labeling", "features", "sampling", "backtests", "allocations", "models")


def collected() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        found = import_module(f".{name}", __name__).R
        if queries.keys() & found.queries.keys():
            raise ValueError(f"names registered twice: {queries.keys() & found.queries.keys()}")
        queries |= found.queries
        sql |= found.sql
    return queries, sql
