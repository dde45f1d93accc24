"""Captured pages: reading, bounding bodies, decoding bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------------------------
MAX_BODY_BYTES = 16 * 1024 * 1024
SNIFF_BYTES = 4096
SNIFF_CHARS = 2048
# Charsets Spark decodes itself; everything else goes through the Arrow-batched decoder.
NATIVE_CHARSETS = {
    "utf-8": "UTF-8", "us-ascii": "UTF-8", "ascii": "UTF-8",
    "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16": "UTF-16LE",
}
# Labels whose decoder has another name on the web.
WEB_LABELS = {
    "gbk": "gb18030", "gb2312": "gb18030", "x-gbk": "gb18030", "big5": "big5hkscs",
    "iso-8859-1": "cp1252", "latin1": "cp1252", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932",
    "euc-kr": "cp949",
}
# ----------------------------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A captured corpus; where a status was kept only answered pages (2xx) stay."""
    pages = spark.read.format(fmt).load(path)
    return pages.where(F.col("status").between(200, 299)) if "status" in pages.columns else pages


def bounded_body(raw: DataFrame, limit: int = MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a declared length over the limit is an error, a longer body is cut."""
    declared = F.col("content_length") if "content_length" in raw.columns else F.lit(None).cast("bigint")
    over = F.coalesce(declared > limit, F.lit(False))
    cut = F.when(F.octet_length("body") > limit, F.substring("body", 1, limit)).otherwise(F.col("body"))
    return raw.where(~over).withColumn("body", cut), raw.where(over)


def normal_charset(c: Column) -> Column:
    """Charset label in lower case without quotes; '' stays '' and utf8 is utf-8."""
    label = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[\"']", "")
    return F.when(label == "utf8", "utf-8").otherwise(label)


def page_charset(declared: Column, content_type: Column, body: Column) -> Column:
    """Declared label, else the header's, else the page's own, else utf-8."""
    named = normal_charset(declared)
    header = normal_charset(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([\w-]+)", 1))
    head = F.substring(F.decode(F.substring(body, 1, SNIFF_BYTES), "ISO-8859-1"), 1, SNIFF_CHARS)
    plain = F.regexp_extract(head, r"""(?i)<meta[^>]+charset=["']?\s*([\w-]+)""", 1)
    equiv = F.regexp_extract(head, r"""(?i)<meta[^>]+content=["'][^"']*charset=\s*([\w-]+)""", 1)
    sniffed = normal_charset(F.when(plain != "", plain).otherwise(equiv))
    return (
        F.when(~named.isin("", "auto"), named).when(header != "", header).when(sniffed != "", sniffed).otherwise("utf-8")
    )


@F.pandas_udf(StringType())
def _decode_other(bodies: pd.Series, labels: pd.Series) -> pd.Series:
    def one(body: bytes | None, label: str) -> str | None:
        if body is None:
            return None
        try:
            return bytes(body).decode(WEB_LABELS.get(label, label), errors="replace")
        except LookupError:
            return bytes(body).decode("utf-8", errors="replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, labels)], dtype="object")


def decode_charset(raw: DataFrame) -> DataFrame:
    """``raw``: url, body, content_type, declared → + charset, html.

    UTF bodies are decoded in the JVM; only bodies in other charsets are shipped to Python.
    """
    table = F.create_map(*[F.lit(x) for pair in NATIVE_CHARSETS.items() for x in pair])
    rows = raw.withColumn("charset", page_charset(F.col("declared"), F.col("content_type"), F.col("body")))
    rows = rows.withColumn("_native", F.try_element_at(table, F.col("charset")))
    other = F.when(F.col("_native").isNull(), F.col("body"))
    # Malformed sequences become U+FFFD, also where a body was cut inside one.
    utf8 = F.try_validate_utf8(F.col("body").cast("string"))
    native = (
        F.when(F.col("_native") == "UTF-8", F.coalesce(utf8, F.make_valid_utf8(F.col("body").cast("string"))))
        .when(F.col("_native") == "UTF-16LE", F.decode("body", "UTF-16LE"))
        .when(F.col("_native") == "UTF-16BE", F.decode("body", "UTF-16BE"))
    )
    decoded = rows.withColumn("_other", _decode_other(other, F.col("charset")))
    return decoded.withColumn("html", F.coalesce(native, "_other")).drop("_native", "_other", "body")
