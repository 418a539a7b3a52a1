"""Registered queries: a Spark query over the given tables and its check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filespoor.world.views import SQL, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(world)``. ``sql`` starts with SELECT, or with a comma and more views."""

    def register(fn: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(World(spark, folder))
        if sql is not None:
            CHECKS[name] = SQL + sql
        return fn

    return register
