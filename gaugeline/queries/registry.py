"""Query registry: each query has a Spark form and, where SQL can say it, an equal SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one data directory, opened on first use."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name, with its SQL twin."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, directory: f(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def select_sql(table: str, exprs: list[str]) -> str:
    return f"SELECT {', '.join(exprs)} FROM {table}"


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
