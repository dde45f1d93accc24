"""Login throttling: a fold over each user's attempts, kept parallel.

Ten failures within fifteen minutes of the first one block every further attempt until the fifteen
minutes are over; a success before that clears the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
WINDOW_MS = 15 * 60 * 1000
MAX_FAILURES = 10
# ----------------------------------------------------------------------------------------------


def decide(count: int, first: int, ts: int, ok: bool) -> tuple[int, int, str]:
    """One attempt: the new (count, first failure) and the decision."""
    if count and ts - first > WINDOW_MS:
        count = 0
    if count >= MAX_FAILURES:
        return count, first, "blocked"
    if ok:
        return 0, 0, "ok"
    return (count + 1, first, "failed") if count else (1, ts, "failed")


def bursts(attempts: DataFrame) -> DataFrame:
    """Attempts with a burst number: bursts of a user are more than a window apart.

    No state outlives such a gap, so bursts are independent and one user's attempts spread over
    tasks. A gap longer than a window always crosses the edge of a window-wide time step, so gaps
    are found on one row per (user, step).
    """
    stepped = attempts.withColumn("step", F.floor(F.col("ts") / WINDOW_MS))
    spans = stepped.groupBy("username", "step").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    by_time = Window.partitionBy("username").orderBy("step")
    starts = (F.col("lo") - F.lag("hi").over(by_time) > WINDOW_MS).cast("int")
    numbered = spans.select(
        "username", "step", F.sum(F.coalesce(starts, F.lit(0))).over(by_time).alias("burst")
    )
    return stepped.join(numbered, ["username", "step"]).drop("step")


def login_throttle(attempts: DataFrame) -> DataFrame:
    """``attempts``: username, ts, seq, ok → + decision (ok, failed, blocked).

    Bursts are hashed to tasks, sorted there and streamed through with one running state, so a long
    burst costs time but no memory.
    """
    ordered = (
        bursts(attempts)
        .repartition("username", "burst")
        .sortWithinPartitions("username", "burst", "ts", "seq")
        .select("username", "burst", "ts", "seq", "ok")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, first = None, 0, 0
        for batch in batches:
            decisions = []
            for username, burst, ts, ok in zip(batch["username"], batch["burst"], batch["ts"], batch["ok"]):
                if (username, burst) != current:
                    current, count, first = (username, burst), 0, 0
                count, first, decision = decide(count, first, int(ts), bool(ok))
                decisions.append(decision)
            yield batch[["username", "ts", "seq"]].assign(decision=decisions)

    return ordered.mapInPandas(fold, "username string, ts bigint, seq bigint, decision string")
