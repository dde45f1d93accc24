"""Ranked lexical search: the best documents of each query, by term weights and length-normalised counts.

Documents are kept as rows of (term, count) over the queries' terms, a table that tasks read in shards. In a
shard, the posting list of a term is clustered by the likeness of its documents, and each cluster is a block
with a summary: for every term the largest contribution that a document of the block has. A query reads the
lists of its heaviest terms first, each list's blocks by falling bound (the summary scored like a document),
and leaves a block out only when its bound cannot reach the query's worst kept score. It stops at the list
from which on all terms together cannot reach it. Bounds are exact, so no document is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .batches import mix, short_batches, slices
from .words import BASE, Words, byte_table, same_bytes

BEST = 50
# Pairs of (query, term) that one pass over the documents answers.
PASS_TERMS = 200_000
# Postings and documents of a shard, and documents of a block.
SHARD_POSTINGS, SHARD_DOCS, BLOCK_DOCS = 1 << 20, 1 << 14, 48
# Dimensions that documents are projected to where their likeness counts.
SKETCH = 32
SLICE = 4 << 20
# Blocks that are scored before the bounds are looked at again.
STEP = 8
# Parts a query's results are ranked in before they meet.
PARTS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = np.iinfo(np.int64).min


@dataclass
class Vocabulary:
    """Terms that can be looked up by code and bytes; every term has a code of its own."""

    codes: np.ndarray
    numbers: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    base: int

    @classmethod
    def of(cls, terms: list[bytes]) -> Vocabulary:
        base = BASE
        while True:
            words = Words(terms, np.ones(256, dtype=bool) & (np.arange(256) != 10), base)
            codes, numbers = np.unique(words.code, return_index=True)
            if len(codes) == len(terms):
                return cls(codes, numbers, words.data, words.starts, words.ends, base)
            base += 2  # two terms share a code: another odd base

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 where it is none."""
        found = np.full(len(words), -1, dtype=np.int64)
        if len(words) and len(self.codes):
            near = np.minimum(np.searchsorted(self.codes, words.code), len(self.codes) - 1)
            at = np.flatnonzero(self.codes[near] == words.code)
            term = self.numbers[near[at]]
            alike = same_bytes(words.data, words.starts[at], words.ends[at], self.data, self.starts[term], self.ends[term])
            found[at[alike]] = term[alike]
        return found


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each query; rows of one id are one query, null texts have none."""
    low = F.translate("text", _UPPER, _LOWER)
    return queries.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id long, n, terms, counts) of every row with a term: n counts all terms, the lists those of the vocabulary.

    ``terms`` are rising term numbers and ``counts`` their occurrences, packed as 32-bit integers.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            values = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            words = Words([v or b"" for v in values], _IN_TERM, shared.value.base)
            sizes = np.bincount(words.text, minlength=len(values))
            term = shared.value.find(words)
            known = term >= 0
            most = max(len(shared.value.codes), 1)
            pair, count = np.unique(words.text[known] * most + term[known], return_counts=True)
            cuts = np.searchsorted(pair, np.arange(len(values) + 1) * most)
            terms, counts = (pair % most).astype("<i4"), count.astype("<i4")
            kept = np.flatnonzero(sizes)
            rows = [(terms[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[kept].tolist(), cuts[kept + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")).take(pa.array(kept)), pa.array(sizes[kept].astype(np.int64)),
                    pa.array([t for t, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary()),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


@dataclass
class Statistics:
    """Documents with a term, all their terms, and in how many documents each term of the vocabulary occurs."""

    documents: int
    terms: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        """floor(1000 ln((2N + 2) / (2 df + 1))) of each term, in doubles."""
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(df) + 1))) for df in self.holders], dtype=np.int64)


def statistics(table: DataFrame, n_terms: int) -> Statistics:
    """Counted over all rows of a table of postings; the driver holds one number a term of the vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            holders += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4"), minlength=n_terms)
        term = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(holders[term])], names=["term", "df"])

    holders = np.zeros(n_terms, dtype=np.int64)
    for row in table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        holders[row.term] = row.df
    total = table.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Statistics(total.documents, total.terms, holders)


def gathered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges in a row, and where each range starts among them."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], sizes), offsets


@dataclass
class Rows:
    """Sparse rows of contributions: documents, or summaries of blocks."""

    cuts: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weighted sum of each row, in 64-bit integers."""
        at, offsets = gathered(self.cuts[rows], self.cuts[rows + 1])
        sums = np.concatenate(([0], np.cumsum(weight[self.term[at]] * self.value[at])))
        return sums[offsets[1:]] - sums[offsets[:-1]]


class Shard:
    """Documents of one shard with the blocked posting lists of its terms; a list is clustered when first read."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, term: np.ndarray, count: np.ndarray, stats: Statistics) -> None:
        self.ids = ids
        norm = 50 + (50 * sizes * stats.documents) // max(stats.terms, 1)
        holder = np.repeat(np.arange(len(ids)), np.diff(cuts))
        count = count.astype(np.int64)
        self.documents = Rows(cuts, term, (1_000_000_000 * count) // (1000 * count + 20 * norm[holder]))
        order = np.argsort(term, kind="stable")
        self.holder = holder[order]
        self.list_cuts = np.searchsorted(term[order], np.arange(len(stats.holders) + 1))
        self.most = np.zeros(len(stats.holders), dtype=np.int64)
        full = np.flatnonzero(np.diff(self.list_cuts))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.documents.value[order], self.list_cuts[full])
        self.likeness = self._sketch(holder, term)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, Rows]] = {}

    def _sketch(self, holder: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Documents projected to few dimensions by signed hashing of their terms, at length one."""
        code = mix(term.astype(np.uint64))
        signed = np.where(code & np.uint64(1 << 40), 1.0, -1.0) * self.documents.value
        flat = np.bincount(holder * SKETCH + (code % np.uint64(SKETCH)).astype(np.int64), weights=signed, minlength=len(self.ids) * SKETCH)
        rows = flat.reshape(-1, SKETCH).astype(np.float32)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rows]:
        """(documents of the list by block, cuts of the blocks, smallest id of each, summaries)."""
        if term not in self.lists:
            docs = self.holder[self.list_cuts[term] : self.list_cuts[term + 1]]
            cluster = np.zeros(len(docs), dtype=np.int64)
            if len(docs) > BLOCK_DOCS:
                centres = self.likeness[docs[:: BLOCK_DOCS // 2]]
                for at in range(0, len(docs), 4096):
                    cluster[at : at + 4096] = np.argmax(self.likeness[docs[at : at + 4096]] @ centres.T, axis=1)
                order = np.argsort(cluster, kind="stable")
                docs, cluster = docs[order], cluster[order]
            starts = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
            rank = np.arange(len(docs)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(docs)]))))
            cuts = np.concatenate((np.flatnonzero(rank % BLOCK_DOCS == 0), [len(docs)]))  # a large cluster is several blocks
            self.lists[term] = docs, cuts, np.minimum.reduceat(self.ids[docs], cuts[:-1]), self._summaries(docs, cuts)
        return self.lists[term]

    def _summaries(self, docs: np.ndarray, cuts: np.ndarray) -> Rows:
        """For each block and term the largest contribution of a document: the coordinatewise maximum."""
        at, offsets = gathered(self.documents.cuts[docs], self.documents.cuts[docs + 1])
        block = np.repeat(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.diff(offsets))
        width = len(self.most)
        key = block * width + self.documents.term[at]
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        value = np.maximum.reduceat(self.documents.value[at][order], starts)
        return Rows(np.searchsorted(key[starts], np.arange(len(cuts)) * width), key[starts] % width, value)


class Best:
    """The best documents of one query so far: by score, equal scores by id."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        positive = scores > 0
        scores, ids = np.concatenate((self.scores, scores[positive])), np.concatenate((self.ids, ids[positive]))
        order = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[order], ids[order]

    def may_enter(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether documents with scores up to these bounds and ids from these on could still be among the best."""
        if len(self.scores) < self.size:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (ids < self.ids[-1]))


def search_shard(shard: Shard, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Enter a shard's documents that belong among the best of one query. ``weight`` has an entry a term number."""
    terms = terms[(shard.most[terms] > 0) & (weight[terms] > 0)]
    most = weight[terms] * shard.most[terms]
    order = np.argsort(-most, kind="stable")
    terms, most = terms[order], most[order]
    rest = np.cumsum(most[::-1])[::-1]  # what this and all later lists can give
    full, later = np.zeros_like(weight), np.zeros_like(weight)
    full[terms] = later[terms] = weight[terms]
    seen = np.zeros(len(shard.ids), dtype=bool)
    lowest = np.array([shard.ids.min()]) if len(shard.ids) else np.zeros(1, dtype=np.int64)
    for term, left in zip(terms.tolist(), rest.tolist(), strict=True):
        if not best.may_enter(np.array([left]), lowest)[0]:
            return
        docs, cuts, ids, summaries = shard.blocks(term)
        # A document with a heavier term was in that term's list, so only the terms from here on count in the bound.
        bounds = summaries.score(np.arange(len(ids)), later)
        later[term] = 0
        order = np.argsort(-bounds, kind="stable")
        for at in range(0, len(order), STEP):
            blocks = order[at : at + STEP]
            blocks = blocks[best.may_enter(bounds[blocks], ids[blocks])]
            if not len(blocks):
                if not best.may_enter(bounds[order[at : at + 1]], lowest)[0]:
                    break
                continue
            chosen = docs[gathered(cuts[blocks], cuts[blocks + 1])[0]]
            chosen = chosen[~seen[chosen]]
            seen[chosen] = True
            best.add(shard.documents.score(chosen, full), shard.ids[chosen])


def _passes(terms: DataFrame, most: int) -> Iterator[dict]:
    """Queries in runs of about ``most`` (query, term) pairs; the driver holds one run at a time."""
    run: dict = {}
    held, last = 0, object()
    for row in terms.orderBy("item_id").toLocalIterator():
        if held >= most and row.item_id != last:
            yield run
            run, held = {}, 0
        run.setdefault(row.item_id, []).append(row.term)
        last, held = row.item_id, held + 1
    if run:
        yield run


def _one_pass(docs: DataFrame, run: dict, kind: str, best: int) -> DataFrame:
    """The best documents of one run of queries, from each task that reads postings."""
    spark = docs.sparkSession
    number: dict[str, int] = {}
    items = [(item, np.array(sorted(number.setdefault(t, len(number)) for t in terms), dtype=np.int64)) for item, terms in run.items()]
    vocabulary = Vocabulary.of([t.encode("utf-8", "surrogatepass") for t in number])
    table = stored(postings(docs, vocabulary), "postings")
    stats = statistics(table, len(number))
    shared = spark.sparkContext.broadcast((items, stats, stats.weights()))

    def shards(batches: Iterable[pa.RecordBatch], stats: Statistics) -> Iterator[Shard]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids = np.array([_NULL_ID if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
            for row in zip(ids.tolist(), *[c.to_pylist() for c in batch.columns[1:]], strict=True):
                held.append(row)
                size += len(row[2]) // 4
                if size >= SHARD_POSTINGS or len(held) >= SHARD_DOCS:
                    yield shard(held, stats)
                    held, size = [], 0
        if held:
            yield shard(held, stats)

    def shard(held: list[tuple], stats: Statistics) -> Shard:
        ids, sizes, terms, counts = zip(*held, strict=True)
        cuts = np.concatenate(([0], np.cumsum([len(t) // 4 for t in terms]))).astype(np.int64)
        term, count = (np.frombuffer(b"".join(c), dtype="<i4").astype(np.int64) for c in (terms, counts))
        return Shard(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), cuts, term, count, stats)

    def run_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, stats, weight = shared.value
        found = [Best(best) for _ in items]
        for one in shards(batches, stats):
            for (_, terms), kept in zip(items, found, strict=True):
                search_shard(one, terms, weight, kept)
        for at, kept in enumerate(found):
            if len(kept.ids):
                n = len(kept.ids)
                ids = [None if i == _NULL_ID else i for i in kept.ids.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(kept.scores)], names=["place", "doc_id", "score"]
                )

    hits = table.mapInArrow(run_shards, "place long, doc_id long, score long")
    names = spark.createDataFrame([(at, item) for at, (item, _) in enumerate(items)], f"place long, item_id {kind}")
    # Ranked part by part first, so that one query's hits of all tasks never meet in one.
    order = [F.col("score").desc(), F.col("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy(*order)))
    first = first.where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(names, "place").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``best`` documents with a score above 0, highest first, ties by doc_id.

    Terms are runs of ASCII letters and digits and of all characters above ASCII; only A-Z are lower-cased.
    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums, over the query's distinct terms,
    weight * (10^9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L), in 64-bit integers. ``docs`` has a whole-number
    doc_id and a text, ``queries`` item_id and text; other columns do not matter. Null and empty texts have
    no terms; a null doc_id comes first among ties; rows with one doc_id are documents of their own, rows with
    one item_id (null included) one query. No rows on either side give no rows. Queries go in runs of
    ``pass_terms`` terms, each a pass over the documents with a vocabulary of that size in every task.
    """
    kind = queries.schema["item_id"].dataType.simpleString()
    results = None
    waiting = None
    for run in _passes(query_terms(queries), pass_terms):
        if waiting is not None:  # more than one run: results are kept as tables, one pass at a time
            done = stored(waiting, "ranked")
            results = done if results is None else results.union(done)
        waiting = _one_pass(docs, run, kind, best)
    if waiting is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return waiting if results is None else results.union(waiting)
