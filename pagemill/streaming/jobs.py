"""Streaming jobs: source health, newest progress, login throttling, session expiry, page extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import library, registry
from ..operators.throttle import decide
from ..plans.books import extract_book_list
from .state import VersionedTable

HEALTH = "source_id string, last_ok_at bigint, fail_streak bigint"
PROGRESS = (
    "owner string, book_key string, chapter_url string, chapter_name string, chapter_index int, page_index int, updated_at bigint"
)


def _start(stream: DataFrame, each_batch, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_source_health(outcomes: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Outcome stream (source_id, ts, seq, outcome) folded into a health table."""
    table = VersionedTable(outcomes.sparkSession, table_path, HEALTH)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        news = registry.source_health(batch).withColumnsRenamed({"last_ok_at": "new_ok", "fail_streak": "new_fails"})
        joined = table.read(batch_id).join(news, "source_id", "full_outer")
        new_ok, old_fails = F.coalesce("new_ok", F.lit(0)), F.coalesce("fail_streak", F.lit(0))
        merged = joined.select(
            "source_id", F.greatest(new_ok, F.coalesce("last_ok_at", F.lit(0))).alias("last_ok_at"),
            # A success in the batch ends what was counted before it.
            F.when(new_ok > 0, F.col("new_fails")).otherwise(old_fails + F.coalesce("new_fails", F.lit(0))).alias("fail_streak"),
        )
        table.write(merged, batch_id)

    return _start(outcomes, each_batch, checkpoint)


def stream_progress_newest(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Progress events folded into the newest position per book; older ones that come late are ignored."""
    table = VersionedTable(events.sparkSession, table_path, PROGRESS)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        merged, _ = library.merge_newest(table.read(batch_id), batch, ["owner", "book_key"])
        table.write(merged, batch_id)

    return _start(events, each_batch, checkpoint)


def stream_login_throttle(attempts: DataFrame) -> DataFrame:
    """Attempt stream (username, ts, seq, ok) → username, ts, seq, decision.

    The state of a user is two numbers; the attempts of one user in one micro-batch are put in order
    first, so size micro-batches by the source's rate options.
    """
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, first = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        decisions = []
        for ts, ok in zip(rows["ts"], rows["ok"]):
            count, first, decision = decide(count, first, int(ts), bool(ok))
            decisions.append(decision)
        state.update((count, first))
        yield pd.DataFrame({"username": key[0], "ts": rows["ts"].to_numpy(), "seq": rows["seq"].to_numpy(), "decision": decisions})

    return attempts.groupBy("username").applyInPandasWithState(
        fold, "username string, ts bigint, seq bigint, decision string", "count int, first bigint", "append", GroupStateTimeout.NoTimeout
    )


def stream_session_expiry(sessions: DataFrame) -> DataFrame:
    """Session stream (token, user_id, at TIMESTAMP, expires_at ms) → rows of sessions past their end.

    Event time decides: a session ends when the watermark reaches its expiry. A start that comes while
    its token's session runs prolongs it; one that comes later is a session of its own. A session that
    is over at its start ends one millisecond later, one without an end never does.
    """
    lasts = F.greatest(F.col("expires_at") - F.unix_millis("at"), F.lit(1))
    running = F.session_window("at", F.concat(lasts, F.lit(" milliseconds")))
    ended = sessions.where("expires_at is not null").withWatermark("at", "0 seconds").groupBy("token", running.alias("running"))
    return ended.agg(
        F.max_by("user_id", F.struct("at", "user_id")).cast("bigint").alias("user_id"), F.max("expires_at").cast("bigint").alias("expires_at")
    ).select("token", "user_id", "expires_at")


def stream_page_extract(pages: DataFrame, rule_fields: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """New page files (page_id, source_id, url, html) → books appended under ``path``, a folder per batch."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        books, _ = extract_book_list(batch, rule_fields)
        books.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(pages, each_batch, checkpoint)
