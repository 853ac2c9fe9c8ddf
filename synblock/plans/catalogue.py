"""Queries by name, with the same question in SQL where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from synblock.plans.workload import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of ``Tables`` under its name; ``views`` are those that the SQL reads."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def over(*by: str, order: list | None = None) -> Window:
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def _load() -> None:
    from synblock.plans import catalogue_chain, catalogue_genome, catalogue_relational, catalogue_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE_SQL)
