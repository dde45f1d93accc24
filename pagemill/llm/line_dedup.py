"""Line deduplication: Bloom filters pick suspected repeats, and only those are compared.

One pass sets bits for the lines of all documents in two filters of one size: seen once, and seen again.
Partial filters are joined bit by bit (a bit that two parts have seen once has been seen twice), which can
add suspects but never lose one. Lines found in the second filter are then counted exactly, by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import apart, map_texts, mix, slices, texts

LEAST_CHARS = 20
LEAST_DOCS = 3
HASHES = 3
# Size of each filter in bits. A fuller filter lets more lines through to the exact count, no fewer.
FILTER_BITS = 1 << 25
PAGE_BITS = 1 << 16

_BLANK = " \t\n\x0b\f\r"


def line_keys(value: str) -> list[str]:
    """The key of each line, empty where it is too short to count. Only A-Z are lower-cased."""
    low = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return [k if len(k) >= LEAST_CHARS else "" for k in (line.strip(_BLANK) for line in low.split("\n"))]


def _bits(keys: list[str]) -> np.ndarray:
    """Filter bits of each key, one row a hash."""
    code = np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], dtype=np.uint64)
    return np.stack([mix(code + np.uint64(k)) % np.uint64(FILTER_BITS) for k in range(HASHES)]).astype(np.int64)


def seen_again(docs: DataFrame) -> np.ndarray:
    """The filter of lines seen twice, as packed bits: every key of two or more documents is in it.

    Tasks send pages of set bits; pages are joined by OR where they meet. The driver holds one filter.
    """

    def run(batches):
        once = np.zeros(FILTER_BITS, dtype=bool)
        again = np.zeros(FILTER_BITS, dtype=bool)
        for part in slices(batches):
            keys = [k for t in texts(part) for k in set(line_keys(t)) if k]
            if keys:
                bits, n = np.unique(_bits(keys), return_counts=True)
                again[bits[(n > 1) | once[bits]]] = True
                once[bits] = True
        pages = once.reshape(-1, PAGE_BITS)
        for page in np.flatnonzero(pages.any(axis=1)).tolist():
            rows = slice(page * PAGE_BITS, (page + 1) * PAGE_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([page], pa.int32()), pa.array([np.packbits(once[rows]).tobytes()], pa.binary()), pa.array([np.packbits(again[rows]).tobytes()], pa.binary())],
                names=["page", "once", "again"],
            )

    def join(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = again = None
        number = 0
        for batch in batches:
            number = batch.column(0)[0].as_py()
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, again = (a, b) if once is None else (once | a, again | b | (once & a))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["page", "again"])

    pages = docs.select("text").mapInArrow(run, "page int, once binary, again binary")
    joined = pages.groupBy("page").applyInArrow(join, "page int, again binary")
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in joined.collect():  # FILTER_BITS / PAGE_BITS rows at most
        out[row.page * PAGE_BITS // 8 : (row.page + 1) * PAGE_BITS // 8] = np.frombuffer(row.again, np.uint8)
    return out


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, drop): the keys each document loses, as digests; null ids come first and count as one.

    Suspects are counted by key with the largest id; both combine before the shuffle, so a line that a
    third of all documents hold is one row a task. They go back to the documents that hold them by key.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(seen_again(docs))

    def suspects(part: pa.RecordBatch, values: list[str]) -> dict:
        again = shared.value
        rows = [sorted({k for k in line_keys(v) if k}) for v in values]
        flat = [k for row in rows for k in row]
        hit = iter(())
        if flat:
            bits = _bits(flat)
            hit = iter((((again[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=0)).tolist())
        out = [[k for k in row if next(hit)] for row in rows]
        return {"keys": pa.array(out, pa.list_(pa.string()))}

    from ..session import stored

    found = map_texts(docs, suspects, "keys array<string>", ["doc_id"])
    pairs = stored(found.select("doc_id", F.explode("keys").alias("key")), "line-suspects")
    # Null ids are one document below all others.
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))
    each = pairs.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    counted = each.groupBy("key").agg(F.count("*").alias("n"), F.max(order).alias("last")).where(F.col("n") >= LEAST_DOCS)
    counted = stored(counted, "line-counts")  # with plain tables on both sides, a key of many documents is split
    lost = pairs.join(counted, "key").where(~F.col("doc_id").eqNullSafe(F.col("last.doc_id")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.unhex(F.md5("key"))).alias("drop"))


def drop_repeated(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` shortened, and ``n_lines`` and ``n_dropped`` at the end.

    A key of at least LEAST_CHARS code points found in LEAST_DOCS documents or more loses its lines
    everywhere but in the largest id that holds it. Null and empty texts are one empty line and come out
    empty. Rows with one id are one document; rows with a null id are one document, the smallest. New
    columns take the names ``n_lines`` and ``n_dropped`` in place of columns so named.
    """
    inner, _ = apart(docs)
    names = inner.columns
    key = names[docs.columns.index(id_column)]
    lost = repeated_keys(docs.select(F.col(id_column).alias("doc_id"), "text"))
    joined = inner.join(lost, inner[key].eqNullSafe(lost["doc_id"]), "left").select(*names, "drop")

    def work(part: pa.RecordBatch, values: list[str]) -> dict:
        from hashlib import md5

        kept, lines, dropped = [], [], []
        for value, drop in zip(values, part.column(part.schema.get_field_index("drop")).to_pylist(), strict=True):
            rows = value.split("\n")
            lines.append(len(rows))
            if drop:
                gone = set(drop)
                keys = line_keys(value)
                rows = [r for r, k in zip(rows, keys, strict=True) if not k or md5(k.encode("utf-8", "surrogatepass")).digest() not in gone]
            dropped.append(lines[-1] - len(rows))
            kept.append("\n".join(rows))
        return {"kept": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}

    out = map_texts(joined, work, "kept string, n_lines bigint, n_dropped bigint", [n for n in [*names, "drop"] if n != "text"])
    back: list[Column] = [
        (F.col("kept") if a == "text" else F.col(a)).alias(b) for a, b in zip(names, docs.columns, strict=True) if b not in ("n_lines", "n_dropped")
    ]
    return out.select(*back, "n_lines", "n_dropped")
