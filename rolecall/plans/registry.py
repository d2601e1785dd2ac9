"""Registered queries: each a plan over ``Tables`` with, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The statements of ``ORACLES`` without their WITH clause, for queries built on others.
SELECTS: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable:
    """Registers a plan; ``sql`` is the rest of a statement after the derived tables and ``ctes``."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name], SELECTS[name] = duckdb_with(*ctes) + sql, sql
        return plan

    return register
