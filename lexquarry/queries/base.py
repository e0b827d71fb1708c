"""Registration of queries by name, with their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexquarry.plans.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of views under ``name``; each view is passed by position."""

    def add(of: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: of(*[view(spark, sf_dir, t) for t in tables])
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return of

    return add
