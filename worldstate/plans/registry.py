"""Registry of runnable queries and their counterparts in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worldstate.plans.views import Views, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(views)``; ``sql`` refers to the derived views by name."""

    def register(fn: Callable[[Views], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Views(spark, folder))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = cte(sql, "duckdb")
        return fn

    return register
