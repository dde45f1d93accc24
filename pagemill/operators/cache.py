"""A keyed cache as a log of writes: what a reader at a given time sees, and the log cut to what still matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import keep_last

# Width of the time steps within which a key's events are put in order, in milliseconds.
STEP_MS = 3_600_000


def _alive(value: Column, written: Column, ttl: Column, now: Column) -> Column:
    """A deleted value is NULL; a time to live of NULL, 0 or less never ends."""
    return value.isNotNull() & ((F.coalesce(ttl, F.lit(0)) <= 0) | (now < written + ttl))


def cache_lookup(writes: DataFrame, reads: DataFrame, step_ms: int = STEP_MS) -> DataFrame:
    """``reads`` (key, at, seq and any other columns) with ``cached``: the value of the last write before, NULL if none or expired.

    ``writes``: key, value (NULL deletes), at, seq, ttl_ms. Times are milliseconds; events of one time go by
    ``seq``, a write before a read. A key's events are put in order within steps of time, and steps hand on
    their last write, so a key that holds a large part of all events is many tasks' work; only its steps
    meet in one.
    """
    others = [c for c in reads.columns if c not in ("key", "at", "seq")]
    row = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    write = F.struct("value", "at", "ttl_ms")
    left = writes.select("key", "at", "seq", F.lit(0).alias("kind"), write.alias("write"), F.lit(None).cast(reads.select(row).schema[0].dataType).alias("row"))
    right = reads.select("key", "at", "seq", F.lit(1).alias("kind"), F.lit(None).cast(writes.select(write).schema[0].dataType).alias("write"), row.alias("row"))
    events = left.unionByName(right).withColumn("step", F.floor(F.col("at") / step_ms))
    order = F.struct("at", "seq")
    steps = events.groupBy("key", "step").agg(F.max_by("write", F.when(F.col("kind") == 0, order)).alias("last"))
    before = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("key", "step", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("key", "step").orderBy("at", "seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("own", F.last("write", ignorenulls=True).over(within)).where("kind = 1")
    joined = seen.join(carried, ["key", "step"]).withColumn("hit", F.coalesce("own", "carried"))
    alive = _alive(F.col("hit.value"), F.col("hit.at"), F.col("hit.ttl_ms"), F.col("at"))
    return joined.select("key", "at", "seq", *[F.col(f"row.{c}").alias(c) for c in others], F.when(alive, F.col("hit.value")).alias("cached"))


def cache_compact(writes: DataFrame, now: Column) -> DataFrame:
    """The log's last write of each key that is still alive at ``now``; all that later lookups need."""
    last = keep_last(writes.select("key", "value", "at", "seq", "ttl_ms"), ["key"], [F.col("at"), F.col("seq")])
    return last.where(_alive(F.col("value"), F.col("at"), F.col("ttl_ms"), now))
