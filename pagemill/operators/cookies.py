"""Cookie state folded from a log of Set-Cookie values, and lookup by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import web_trim
from ..functions.urls import host_of

# --- fixed values: date forms an Expires attribute comes in ------------------------------------
EXPIRES_FORMS = ("d MMM yyyy HH:mm:ss", "d-MMM-yyyy HH:mm:ss", "d-MMM-yy HH:mm:ss", "d MMM yy HH:mm:ss")
# -----------------------------------------------------------------------------------------------


def _expired(value: Column, now: int) -> Column:
    raw = web_trim(F.regexp_extract(value, r"(?i)expires\s*=\s*([^;]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s*[A-Za-z]+,\s*", ""), r"\s*(?:GMT|UTC)\s*$", "")
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(form)) for form in EXPIRES_FORMS])
    return F.coalesce(F.unix_millis(at) <= now, F.lit(False))


def cookie_state(set_cookie: DataFrame, now: int) -> DataFrame:
    """``set_cookie``: source_id, seq, url, value → live cookies, one row per host and name."""
    head = F.regexp_extract("value", "^[^;]*", 0)
    name = web_trim(F.regexp_extract(head, "^([^=]+)=", 1))
    deletes = F.col("value").rlike(r"(?i)max-age\s*=\s*0\b") | _expired(F.col("value"), now)
    writes = set_cookie.select(
        "source_id", host_of(F.col("url")).alias("host"), name.alias("name"), "seq",
        web_trim(F.regexp_extract(head, "^[^=]+=(.*)$", 1)).alias("value"), deletes.alias("deleted"),
    ).where("host <> '' AND name <> ''")
    last = writes.groupBy("source_id", "host", "name").agg(
        F.max_by(F.struct("value", "deleted"), "seq").alias("last"), F.min("seq").alias("first_seq")
    )
    return last.where(~F.col("last.deleted")).select("source_id", "host", "name", "last.value", "first_seq")


def cookie_lookup(state: DataFrame, urls: DataFrame) -> DataFrame:
    """``urls``: source_id, url → + cookie header; the nearest host wins per name."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(
        F.array("host")
    )
    asked = urls.select("source_id", "url").dropDuplicates().withColumn("host", host_of(F.col("url")))
    chain = asked.where("host <> ''").select("source_id", "url", F.posexplode(suffix).alias("level", "host"))
    near = Window.partitionBy("source_id", "url", "name").orderBy("level")
    hits = (
        chain.join(state, ["source_id", "host"])
        .withColumn("_n", F.row_number().over(near)).where("_n = 1")
    )
    # A request carries a handful of cookies, so the list per address is short.
    pairs = F.sort_array(F.collect_list(F.struct("level", "first_seq", F.concat_ws("=", "name", "value").alias("pair"))))
    headers = hits.groupBy("source_id", "url").agg(pairs.alias("pairs")).select(
        "source_id", "url", F.array_join(F.transform("pairs", lambda p: p["pair"]), "; ").alias("cookie")
    )
    return urls.select("source_id", "url").dropDuplicates().join(headers, ["source_id", "url"], "left").withColumn(
        "cookie", F.coalesce("cookie", F.lit(""))
    )
