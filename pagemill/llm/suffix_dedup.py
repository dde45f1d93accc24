"""Suffix-array deduplication: long byte strings that occur twice lose all their bytes.

Sorting every suffix of a corpus would shuffle many times its size, so only some suffixes are sorted: those
that start at anchors. The anchor of a string of LENGTH bytes is the place in it where the hash of the next
ANCHOR bytes is smallest. Equal strings have equal anchors, so a string and its copy meet at one. An anchor
whose hash is alone is done with; so is one whose whole context, the union of its strings, occurs again.
The other suffixes of one anchor hash are sorted in a task by content: prefix polynomial hashes of the
buffer and a binary search over lengths find the common extension of two suffixes in a logarithm of
steps, which is the comparison of a merge sort. Extensions that count are then compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored
from .batches import apart, map_texts, mix

LENGTH = 400
ANCHOR = 100
# Different contexts of one anchor that are sorted together; larger groups are settled by counting strings.
GROUP = 64
# Bytes of contexts in one sorting buffer.
BUFFER = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
_ROW = "doc_id bigint, mark bigint"
_KEYS = ["doc_id", "mark"]


def _bytes(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place, put together from those of half the size."""
    parts = {1: mix(data.astype(np.uint64) + np.uint64(1))}
    whole, have = None, 0
    step = 1
    while step <= size:
        if step > 1:
            half = parts[step // 2]
            n = max(0, len(data) - step + 1)
            parts[step] = half[:n] * np.uint64(pow(_BASE, step // 2, 1 << 64)) + half[step // 2 : step // 2 + n]
        if size & step:
            if whole is None:
                whole, have = parts[step], step
            else:
                n = max(0, len(data) - have - step + 1)
                whole = whole[:n] * np.uint64(pow(_BASE, step, 1 << 64)) + parts[step][have : have + n]
                have += step
        step *= 2
    return mix(whole)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


class PrefixHashes:
    """Polynomial hashes of any stretch of a buffer."""

    def __init__(self, data: np.ndarray, base: int = _BASE) -> None:
        values = mix(data.astype(np.uint64) + np.uint64(1))
        self.powers = _powers(len(data) + 1, base)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[:-1], dtype=np.uint64)))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` bytes at ``i`` and at ``j`` have one hash: both are brought to the later place's power."""
        a, b = self.sums[i + n] - self.sums[i], self.sums[j + n] - self.sums[j]
        first = np.where(i <= j, a, b) * self.powers[np.abs(i - j)]
        return first == np.where(i <= j, b, a)

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common extension from ``i`` and ``j`` on (or back), at most ``most``."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            n = (low + high + 1) >> 1
            good = self.same(i - n, j - n, n) if back else self.same(i, j, n)
            low, high = np.where(good, n, low), np.where(good, high, n - 1)
        return low


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> list[tuple[int, int, int, int]]:
    """(anchor, first, last, hash): the strings from ``first`` to ``last`` of a text have this anchor."""
    if len(data) < length:
        return []
    hashes = gram_hashes(data, anchor)
    width = length - anchor + 1
    least = _least(hashes, width)
    changes = (np.flatnonzero(least[1:] != least[:-1]) + 1).tolist() + [len(least)]
    out, start = [], 0
    for stop in changes:
        value = least[start]
        places = (start + np.flatnonzero(hashes[start : stop - 1 + width] == value)).tolist()
        for place in places:  # more than one only where the text repeats itself
            last = min(place, stop - 1)
            if last >= start:
                out.append((place, start, last, int(value.astype(np.int64))))
                start = last + 1
            if start >= stop:
                break
    return out


def _context_hashes(data: np.ndarray, found: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
    import xxhash

    raw = data.tobytes()
    digests = [xxhash.xxh3_128_intdigest(raw[first : last + LENGTH]) for _, first, last, _ in found]
    return [_signed(d >> 64) for d in digests], [_signed(d & (1 << 64) - 1) for d in digests]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _exploded(docs: DataFrame, work, schema: str) -> DataFrame:
    """Rows that ``work(text, row's other values)`` lists, beside the row's keys."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[part.strip().split()[1]] for part in schema.split(",")]
    others = [c for c in docs.columns if c not in (*_KEYS, "text")]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                rows = batch.select([*_KEYS, "text", *others]).to_pydict()
                ids, marks, columns = [], [], [[] for _ in names]
                for i, value in enumerate(rows["text"]):
                    found = work(value or "", *[rows[o][i] for o in others])
                    ids += [rows["doc_id"][i]] * len(found)
                    marks += [rows["mark"][i]] * len(found)
                    for column, values in zip(columns, zip(*found, strict=True), strict=False):
                        column += values
                arrays = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*_KEYS, *names])

    return docs.mapInArrow(run, f"{_ROW}, {schema}")


def _anchor_rows(value: str) -> list[tuple]:
    data = _bytes(value)
    found = anchors(data)
    high, low = _context_hashes(data, found)
    return [(a, f, t, key, h, x) for (a, f, t, key), h, x in zip(found, high, low, strict=True)]


def _sorted_places(hashes: PrefixHashes, group: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Order of the suffixes by group and content: merge sort, each merge by binary searches of all at once."""
    n = len(group)
    order = np.arange(n)

    def before(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        out = group[i] < group[j]
        at = np.flatnonzero(group[i] == group[j])
        i, j = i[at], j[at]
        most = np.minimum(size[i], size[j])
        common = hashes.common(start[i], start[j], most)
        ended = common == most
        place = np.where(ended, 0, common)
        shorter = (size[i] < size[j]) | ((size[i] == size[j]) & or_equal[at])
        out[at] = np.where(ended, shorter, data[start[i] + place] < data[start[j] + place])
        return out

    width = 1
    while width < n:
        place = np.arange(n)
        block, left = place // (2 * width), (place // width) % 2 == 0
        low = np.where(left, np.minimum(n, (2 * block + 1) * width), 2 * block * width)
        high = np.where(left, np.minimum(n, (2 * block + 2) * width), (2 * block + 1) * width)
        other = low.copy()
        active = low < high
        while active.any():
            at = np.flatnonzero(active)
            middle = (low[at] + high[at]) >> 1
            smaller = before(order[middle], order[at], ~left[at])
            low[at] = np.where(smaller, middle + 1, low[at])
            high[at] = np.where(smaller, high[at], middle)
            active = low < high
        begin = 2 * block * width
        own = np.where(left, place - begin, place - (2 * block + 1) * width)
        merged = np.empty(n, dtype=np.int64)
        merged[begin + own + (low - other)] = order
        order = merged
        width *= 2
    return order


def matched_starts(data: np.ndarray, group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """(suffix, first, last): strings, by their start counted back from the anchor, that another suffix of the group has too.

    Suffix i's context starts at ``context[i]`` of the buffer; its anchor is ``left[i]`` bytes on, followed
    by ``right[i]`` bytes. Neighbours at growing distance in sorted order share less and less to the right.
    """
    hashes = PrefixHashes(data)
    start = context + left
    order = _sorted_places(hashes, group, start, right, data)
    out = []
    for distance in range(1, len(order)):
        i, j = order[:-distance], order[distance:]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        forward = hashes.common(start[i], start[j], np.minimum(right[i], right[j]))
        back = hashes.common(start[i], start[j], np.minimum(left[i], left[j]), back=True)
        least = np.maximum(0, LENGTH - forward)
        for k in np.flatnonzero(least <= back).tolist():
            a, b, low, high = int(start[i[k]]), int(start[j[k]]), int(least[k]), int(back[k])
            stop = LENGTH - low
            if np.array_equal(data[a - high : a + stop], data[b - high : b + stop]):
                out += [(int(i[k]), low, high), (int(j[k]), low, high)]
    return out


def _sorted_matches(contexts: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last) of strings found twice, by suffix sorts of whole groups."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        group = np.unique([r[0] for r in held], return_inverse=True)[1]
        sizes = np.array([len(r[5]) for r in held])
        context = np.cumsum(sizes) - sizes
        left = np.array([r[3] for r in held])
        data = np.frombuffer(b"".join(r[5] for r in held), dtype=np.uint8)
        rows = []
        for i, low, high in matched_starts(data, group, context, left, sizes - left):
            _, doc, mark, off, first, _ = held[i]
            rows.append((doc, mark, first + off - high, first + off - low))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_KEYS, "first", "last"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size > BUFFER and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    ordered = contexts.select("key", *_KEYS, "left", "first", "context").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, f"{_ROW}, first bigint, last bigint")


def _counted_matches(strings: DataFrame) -> DataFrame:
    """The same for groups of any size: every string of every context is counted by two hashes."""
    twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    # Strings of whole contexts only count; their own ranges are settled.
    return strings.where("open").join(twice, ["h1", "h2"], "left_semi").select(*_KEYS, F.col("first"), F.col("first").alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): for each text with repeated strings, the byte ranges [start, end) that they cover.

    ``docs`` has ``doc_id``, ``mark`` (a hash of the text) and ``text``.
    """
    found = stored(_exploded(docs, _anchor_rows, "anchor bigint, first bigint, last bigint, key bigint, u1 bigint, u2 bigint"), "anchors")
    keys = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchor-keys")
    suspects = stored(found.join(broadcast_if_small(keys, 16 << 20), "key", "left_semi"), "suspects")
    unions = suspects.groupBy("key", "u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS, "first")).alias("sample"))
    unions = stored(unions, "contexts")
    groups = unions.groupBy("key").agg(F.count("*").alias("different"), F.min("n").alias("fewest")).where("different > 1 and fewest = 1")
    # Whole contexts that occur again need no comparison; they only take part as one suffix for others.
    open_ = stored(unions.join(groups.select("key", "different"), "key"), "open-contexts")
    whole = suspects.join(unions.where("n > 1").select("key", "u1", "u2"), ["key", "u1", "u2"], "left_semi").select(*_KEYS, "first", "last")
    part = open_.select("key", "u1", "u2", "different", "n", F.col("sample.doc_id").alias("doc_id"), F.col("sample.mark").alias("mark"), F.col("sample.first").alias("first"))
    wanted = suspects.join(part, ["key", "u1", "u2", *_KEYS, "first"]).groupBy(*_KEYS).agg(
        F.collect_list(F.struct("key", "anchor", "first", "last", (F.col("different") > GROUP).alias("many"), (F.col("n") == 1).alias("open"))).alias("wanted")
    )
    wanted = stored(wanted, "wanted")
    used = docs.join(broadcast_if_small(wanted, 16 << 20), _KEYS).select(*_KEYS, "text", "wanted")

    def contexts(value: str, wanted: list[dict]) -> list[tuple]:
        raw = value.encode("utf-8", "surrogatepass")
        return [(w["key"], w["anchor"] - w["first"], w["first"], raw[w["first"] : w["last"] + LENGTH]) for w in wanted if not w["many"]]

    def strings(value: str, wanted: list[dict]) -> list[tuple]:
        many = [w for w in wanted if w["many"]]
        if not many:
            return []
        data = _bytes(value)
        first = np.concatenate([np.arange(w["first"], w["last"] + 1) for w in many])
        columns = [_absolute(data, first, base) for base in (_BASE, _OTHER)]
        opened = [w["open"] for w in many for _ in range(w["first"], w["last"] + 1)]
        return list(zip(first.tolist(), *columns, opened, strict=True))

    ranges = whole.union(_sorted_matches(_exploded(used, contexts, "key bigint, left bigint, first bigint, context binary")))
    ranges = ranges.union(_counted_matches(_exploded(used, strings, "first bigint, h1 bigint, h2 bigint, open boolean")))
    each = ranges.groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def joined(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                spans: list[dict] = []
                for r in sorted(ranges, key=lambda r: (r["first"], r["last"])):
                    if spans and r["first"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["last"] + LENGTH)
                    else:
                        spans.append({"start": r["first"], "end": r["last"] + LENGTH})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=[*_KEYS, "spans"])

    return stored(each.mapInArrow(joined, f"{_ROW}, spans array<struct<start: bigint, end: bigint>>"), "repeats")


def _absolute(data: np.ndarray, first: np.ndarray, base: int) -> list[int]:
    """Hash of the LENGTH bytes at each place, the same in every text."""
    values = mix(data.astype(np.uint64) + np.uint64(1))
    powers = _powers(len(data) + 1, base)
    inverse = _powers(len(data) + 1, pow(base, -1, 1 << 64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64)))
    return mix((sums[first + LENGTH] - sums[first]) * inverse[first]).view(np.int64).tolist()


def drop_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans`` to the kept columns (default: ``doc_id``).

    Every byte covered by a string of LENGTH bytes that also starts elsewhere, in this document or another,
    goes; strings are judged on the input. Null texts are empty. Rows that repeat a document are copies of
    it, and lose what they share. ``doc_id`` must be an integer; nulls are allowed. Kept columns may have any names.
    """
    inner, _ = apart(docs)
    key = inner.columns[docs.columns.index("doc_id")]
    inner = inner.withColumn("mark", F.xxhash64("text"))
    known = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))  # joins pass over nulls
    spans = repeated_spans(inner.select(known.alias("doc_id"), "mark", "text"))
    spans = broadcast_if_small(spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans"), 16 << 20)
    joined = inner.join(spans, (known == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")

    def work(part: pa.RecordBatch, values: list[str]) -> dict:
        kept, sizes = [], []
        for value, found in zip(values, part.column(part.schema.get_field_index("spans")).to_pylist(), strict=True):
            raw, at, pieces = value.encode("utf-8", "surrogatepass"), 0, []
            for span in found or ():
                pieces.append(raw[at : span["start"]])
                at = span["end"]
            pieces.append(raw[at:])
            kept.append(b"".join(pieces))
            sizes.append(len(raw))
        return {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64())}

    names = dict(zip(docs.columns, inner.columns, strict=False))
    own = [names[k] for k in keep or ["doc_id"]]
    out = map_texts(joined, work, "kept binary, n_bytes bigint", [*own, "spans"])
    return out.select(*[F.col(a).alias(b) for a, b in zip(own, keep or ["doc_id"], strict=True)], "kept", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"), "spans")
