"""Streaming jobs run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import session
from ..streaming import jobs
from ..streaming.state import VersionedTable
from . import books as rule_books
from .base import query, table
from .derive import with_tables
from .library import THROTTLE


def _folder(spark, name):
    session._ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """A given table as a stream of its files; the table is one file or a folder of them."""
    schema = table(spark, sf, name).schema
    # As a pattern the path may be that of a file.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _millis(c):
    return F.unix_millis(F.col(c).cast("timestamp"))


def _drain(spark, stream):
    """Everything a streaming DataFrame emits, through a file sink."""
    out, checkpoint = _folder(spark, "stream-out"), _folder(spark, "stream-ckpt")
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_source_health",
    with_tables(
        """WITH w AS (
             SELECT source_id, ts, outcome, count_if(outcome = 'ok') OVER (PARTITION BY source_id ORDER BY ts, seq
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok_to_come
             FROM outcomes WHERE outcome <> 'idle')
           SELECT source_id, coalesce(max(ts) FILTER (outcome = 'ok'), 0) AS last_ok_at,
                  count_if(outcome = 'fail' AND ok_to_come = 0) AS fail_streak
           FROM w GROUP BY source_id""",
        "outcomes",
    ),
)
def stream_source_health(spark, sf):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "fail").otherwise("idle")
    outcomes = _stream(spark, sf, "events").select(
        F.concat(F.lit("user:https://c"), "user_id", F.lit(".example.com")).alias("source_id"), _millis("ts").alias("ts"),
        F.col("event_id").alias("seq"), outcome.alias("outcome"),
    )
    path = _folder(spark, "health")
    jobs.stream_source_health(outcomes, path, _folder(spark, "health-ckpt")).awaitTermination()
    return VersionedTable(spark, path, jobs.HEALTH).read()


@query(
    "stream_progress_newest",
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS owner, 'b' || CAST(user_id % 7 AS VARCHAR) || event_type AS book_key,
              arg_max(event_id % 100, epoch_us(ts) // 1000 * 1000000 + event_id) AS chapter_index, CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS updated_at
       FROM events GROUP BY ALL""",
)
def stream_progress_newest(spark, sf):
    events = _stream(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("owner"), F.concat(F.lit("b"), F.col("user_id") % 7, "event_type").alias("book_key"),
        F.lit("/c").alias("chapter_url"), F.lit("").alias("chapter_name"), (F.col("event_id") % 100).cast("int").alias("chapter_index"),
        F.lit(0).alias("page_index"), _millis("ts").alias("updated_at"),
    )
    path = _folder(spark, "progress")
    jobs.stream_progress_newest(events, path, _folder(spark, "progress-ckpt")).awaitTermination()
    out = VersionedTable(spark, path, jobs.PROGRESS).read().select("owner", "book_key", "chapter_index", "updated_at")
    return out.withColumn("chapter_index", F.col("chapter_index").cast("bigint"))


@query("stream_login_throttle", THROTTLE)
def stream_login_throttle(spark, sf):
    attempts = _stream(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id") % 5).alias("username"), _millis("ts").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "purchase").alias("ok"),
    )
    return _drain(spark, jobs.stream_login_throttle(attempts))


@query(
    "stream_session_expiry",
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) // 1000 + 600000 AS expires_at FROM events WHERE event_type = 'view'),
         m AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events WHERE event_type = 'view')
       SELECT 't' || CAST(event_id AS VARCHAR) AS token, user_id, expires_at FROM s, m WHERE expires_at <= now""",
)
def stream_session_expiry(spark, sf):
    """Sessions of ten minutes: those over by the time of the last start."""
    starts = _stream(spark, sf, "events").where("event_type = 'view'").select(
        F.concat(F.lit("t"), "event_id").alias("token"), "user_id", F.col("ts").cast("timestamp").alias("at"), (_millis("ts") + 600_000).alias("expires_at")
    )
    return _drain(spark, jobs.stream_session_expiry(starts))


@query(
    "stream_page_extract",
    f"SELECT page_id, source_id, item, word AS name FROM ({rule_books.ITEMS}) WHERE word <> ''",
)
def stream_page_extract(spark, sf):
    source = rule_books.source_of().alias("source_id")
    pages = _stream(spark, sf, "pages").select("page_id", source, "url", "html")
    rules = rule_books._rules(spark, table(spark, sf, "pages").select(source))
    path = _folder(spark, "books")
    jobs.stream_page_extract(pages, rules, path, _folder(spark, "books-ckpt")).awaitTermination()
    return spark.read.parquet(path).select("page_id", "source_id", "item", "name")
