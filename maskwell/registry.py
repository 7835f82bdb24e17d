"""Queries by name, each with the DuckDB SQL that gives the same rows, where SQL can."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def put(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return put
