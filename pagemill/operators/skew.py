"""Orderings that stay parallel when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: list[str], coarse: Column, fine: list[Column], name: str = "pos") -> DataFrame:
    """Zero-based position of each row within ``keys``, ordered by ``coarse`` then ``fine``.

    A plain row number sorts a whole key in one task. Here rows are numbered within (keys, coarse)
    and shifted by how many rows the key has in earlier coarse steps; only the step counts of a key
    meet in one task. ``coarse`` must be a prefix of the wanted order, such as a day or a chapter.
    """
    stepped = df.withColumn("_step", coarse)
    counts = stepped.groupBy(*keys, "_step").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_step", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_step").orderBy(*fine)
    return (
        stepped.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, [*keys, "_step"])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("bigint"))
        .drop("_step", "_row", "_offset")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; losers go before the shuffle, so a hot key costs one row per task."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*")
