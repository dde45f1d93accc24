"""Registries and table access for the query catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import BY_PAGE, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _settle(spark: SparkSession) -> None:
    """Settings the queries rely on; local sessions get as many shuffle partitions as cores."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(BY_PAGE, "false")
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a text-heavy table (key first), over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns), columns[0])
