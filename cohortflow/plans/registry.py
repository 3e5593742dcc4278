"""Registry of named jobs: ``name -> (spark, sf_dir) -> DataFrame`` and, when
the job is SQL-expressible, its DuckDB oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortflow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TABLES: dict[tuple[int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
