"""Queries of the SQL dialect over the tables of a folder; sessions with tables of their own are ``tessera.sql.engine.Engine``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sql.engine import Engine


def run_sql(spark: SparkSession, sf_dir: str | None, sql: str, args: list | None = None) -> DataFrame:
    """Run one statement; ``?`` takes ``args`` in turn."""
    return Engine(spark, sf_dir).run(sql, args)
