"""The registry of named queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sqlfront import run_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return keep


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query of the SQL dialect; the oracle runs the same text unless given."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLES[name] = oracle or text
