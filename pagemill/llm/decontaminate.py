"""Benchmark decontamination: suffix arrays over shards of documents, searched for every test suffix.

A shard is a slice of documents in one task. Its suffixes, cut to the window length, are sorted; every
window of the test items is binary-searched in them, which gives all places where it occurs. Windows whose
places in the document and in the item advance together join to the longest verbatim match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import apart, map_texts, slices, texts

WINDOW = 10
# Test items come to the executors in chunks of so many windows; a larger benchmark makes several passes.
CHUNK_WINDOWS = 500_000

# Bytes that words consist of once A-Z are lower-cased; all bytes of characters above 127 belong.
_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestIndex:
    """Windows of some test items as numbers, in order, with the items that hold each."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.window = window
        numbers: dict[bytes, int] = {}
        held: dict[tuple[int, ...], dict] = {}
        for item, text in items:
            own = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
            for start in range(max(1, len(own) - window + 1) if own else 0):
                held.setdefault(tuple(own[start : start + window]), {}).setdefault(item, []).append(start)
        self.numbers = numbers
        self.windows = sorted(held)
        self.items = [held[w] for w in self.windows]  # each item that holds a window, with its places there
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.shortest = min(map(len, self.windows), default=window)
        self.keys = np.array([_key(w, window) for w in self.windows], dtype=f"S{4 * window}")
        self.beyond = np.array([_key(w, window, 0xFFFFFFFF) for w in self.windows], dtype=f"S{4 * window}")

    def search(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in the joined rows; and where each row starts."""
        starts = np.fromiter(accumulate(map(len, rows), initial=0), dtype=np.int64, count=len(rows) + 1)
        get = self.numbers.get
        ids = np.array([get(w, 0) for row in rows for w in row], dtype=np.uint32)
        nothing = np.zeros(0, dtype=np.int64)
        if not len(self.windows) or not len(ids):
            return nothing, nothing, starts
        # A suffix counts up to the first word that no item has, or the end of its document.
        stops = np.union1d(np.flatnonzero(ids == 0), starts[1:])
        at = np.arange(len(ids))
        known = np.where(ids == 0, 0, stops[np.searchsorted(stops, at, side="right").clip(max=len(stops) - 1)] - at)
        places = at[known >= self.shortest]
        if not len(places):
            return nothing, nothing, starts
        columns = places[:, None] + np.arange(self.window)
        cut = np.where(np.arange(self.window) < known[places][:, None], ids[np.minimum(columns, len(ids) - 1)], 0)
        suffixes = np.ascontiguousarray(cut.astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        low = np.searchsorted(ordered, self.keys, side="left")
        high = np.searchsorted(ordered, self.beyond, side="right")
        counts = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return places[order[low[window] + within]], window, starts


def _key(window: tuple[int, ...], length: int, fill: int = 0) -> bytes:
    return b"".join(n.to_bytes(4, "big") for n in (*window, *[fill] * (length - len(window))))


def _chunks(benchmark: DataFrame, window: int, limit: int) -> Iterator[TestIndex]:
    """The test items in chunks, one at a time; rows of one id must follow each other."""
    held, size, some = [], 0, False
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if size >= limit and row.item_id != held[-1][0]:
            yield TestIndex(held, window)
            held, size, some = [], 0, True
        held.append((row.item_id, row.text))
        size += max(1, len(words(row.text)) - window + 1)
    if held or not some:
        yield TestIndex(held, window)


def longest_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """Add to the kept columns of ``docs`` (default: ``doc_id``) what they share with ``benchmark``.

    ``n_words`` is the number of words; ``matches`` lists (item_id, start, size) in words: each longest
    stretch that is also a stretch of the item, of a window at least and not inside a longer one. An item
    shorter than a window, but not empty, is one window. More items than a chunk holds make several passes,
    each written to the shared folder before the next one's index is built.
    Null and empty texts have no words and no matches, and so have all texts when the benchmark is empty.
    A repeated item_id counts once; a null item_id is left out. Repeated documents are handled each.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    key = benchmark.schema["item_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))
    tests = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    out = None
    for index in _chunks(tests, window, chunk):
        shared = spark.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, values: list[str], shared=shared, first=out is None) -> dict:
            index = shared.value
            rows = [words(v) for v in values]
            found = [_joined(f, index) for f in _by_row(*index.search(rows))]
            if not first:
                before = batch.column(batch.schema.get_field_index("matches")).to_pylist()
                found = [[*b, *f] for b, f in zip(before, found, strict=True)]
            return {"n_words": pa.array([len(r) for r in rows], pa.int64()), "matches": pa.array(found, kind)}

        if out is None:
            out = map_texts(docs, work, "n_words bigint, matches array<struct<item_id: string, start: bigint, size: bigint>>", [*dict.fromkeys([*keep, "text"])])
        else:
            out = _again(stored(out, "matches"), work)
    return out.withColumn("matches", F.col("matches").cast(f"array<struct<item_id: {key}, start: bigint, size: bigint>>"))


def _again(docs: DataFrame, work) -> DataFrame:
    """A further pass: the same columns, with more matches."""

    def run(batches):
        for part in slices(batches):
            new = work(part, texts(part))
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _by_row(places: np.ndarray, window: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start in the row, window) of each row, in order."""
    rows: list[list[tuple[int, int]]] = [[] for _ in range(len(starts) - 1)]
    order = np.argsort(places, kind="stable")
    owner = np.searchsorted(starts, places, side="right") - 1
    for i in order.tolist():
        rows[owner[i]].append((int(places[i] - starts[owner[i]]), int(window[i])))
    return rows


def _joined(found: list[tuple[int, int]], index: TestIndex) -> list[dict]:
    """Windows that follow each other in the document and in an item make one match.

    For each item, the places where its last window ends there are kept with the document's place where
    the match began. A match that ends inside one that goes on, or began later than it, is not given.
    """
    size_of, out = index.sizes, []
    going: dict[object, tuple[int, int, dict[int, int]]] = {}  # item: last place, window size, {place in item: begin}

    def end(item: object, at: int, size: int, begins: dict[int, int], kept: int | None) -> None:
        begin = min(begins.values())
        if kept is None or begin < kept:
            out.append({"item_id": item, "start": begin, "size": at + size - begin})

    for start, window in found:
        size = int(size_of[window])
        for item, places in index.items[window].items():
            before = going.get(item)
            follows = before is not None and before[0] == start - 1
            begins = {p: before[2].get(p - 1, start) if follows else start for p in places}
            if before is not None:
                gone = before[2] if not follows else {p: b for p, b in before[2].items() if p + 1 not in begins}
                if gone:
                    on = [b for p, b in before[2].items() if follows and p + 1 in begins]
                    end(item, before[0], before[1], gone, min(on, default=None))
            going[item] = (start, size, begins)
    for item, (at, size, begins) in going.items():
        end(item, at, size, begins, None)
    return sorted(out, key=lambda m: (m["start"], m["item_id"]))


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def hit_words(matches: str = "matches"):
    """Words inside any match: lengths of the union of spans, by one walk over spans in order."""
    spans = F.array_sort(F.transform(F.col(matches), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("stop"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        spans,
        begin,
        lambda s, m: F.struct(
            (s["hit"] + F.greatest(F.lit(0), m["stop"] - F.greatest(m["start"], s["end"]))).alias("hit"),
            F.greatest(s["end"], m["stop"]).alias("end"),
        ),
        lambda s: s["hit"],
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of any test item."""
    inner, restore = apart(docs)
    marked = longest_matches(inner, benchmark, keep=inner.columns, window=window)
    return restore(marked.where(F.size("matches") == 0))
