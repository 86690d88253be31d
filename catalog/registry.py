"""The list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL."""

    def register(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} exists already")
        CATALOG[name] = (fn, sql)
        return fn

    return register
