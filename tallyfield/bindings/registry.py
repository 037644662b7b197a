"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
