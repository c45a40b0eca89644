"""Registered queries: each runs an operator over whole tables, most with a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemlake.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn
    return register


from itemlake.plans.queries import bank, blocks, papers, requests, text  # noqa: E402,F401
