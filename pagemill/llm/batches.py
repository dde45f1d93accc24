"""Arrow batches in tasks: bounded slices, text values and output batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text a task turns into numpy arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 512 << 10
# Rows and bytes of one Arrow batch between Spark and a worker; texts and sets can be long.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python batches of so many rows and bytes at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        index = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_texts(
    docs: DataFrame, work: Callable[[pa.RecordBatch, list[str]], dict], schema: str, keep: list[str], limit: int = SLICE_BYTES
) -> DataFrame:
    """``work`` gives new columns for each slice; the kept columns stay beside them.

    ``docs`` must have a ``text`` column. Only the kept columns and the text reach Python.
    """
    short_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in keep]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=limit):
            columns = {f: part.column(part.schema.get_field_index(f)) for f in keep}
            columns |= work(part, texts(part))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out)


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents under names no operator uses (but for ``text``), and how to get the old names back."""
    names = [n if n == "text" else f"kept_{i}" for i, n in enumerate(docs.columns)]

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])

    return docs.toDF(*names), restore


def code_points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of some texts in a row, and where each text starts (one entry more at the end)."""
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null ids have no remainder."""
    return F.crc32(F.col(key).cast("string")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
