"""n-gram Jaccard join: documents whose shingle sets are alike, and the groups that such links make.

Overlaps are the entries of the product of the document by shingle incidence matrix with its transpose.
Columns are ordered from rare to frequent, and only those that can start a link are read first: a set's
rarest shingles, as many as the bound on its size leaves (two sets that are alike enough share one of these).
Column by column, a leader's row is multiplied with the rows of the others; entries whose sizes and places
rule out enough overlap, and those of one group, are never written. The remaining entries are computed in
blocks, a leader's row against many members: counts are accumulated over blocks of columns, rare ones first,
and a member leaves as soon as its count and what is left of the smaller set stay below the bound.
Documents that one leader leaves apart meet in further rounds with more leaders, until no column holds
documents of two groups that were not compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored
from .batches import map_texts, mix, short_batches, slices
from .components import components
from .words import Words, byte_table, stretch_codes

SHINGLE = 5
PERCENT = 80
# Counters of the frequency sketch that orders shingles from rare to frequent. Any order is right; the
# better it is, the fewer pairs are compared. A task counts up to 255, in one byte each.
COUNTERS = 1 << 22
PAGE = 1 << 14
# Members that one block compares with a leader, and blocks of columns their overlaps are counted in.
BLOCK = 400
COLUMN_BLOCKS = 4
# How many times more leaders each further round has.
STEP = 16
# Largest table, as estimated, that is sent to every executor; larger ones are joined by a shuffle.
SMALL = 6 << 20
# Bytes of text turned into arrays at once.
SLICE = 2 << 20

_IN_WORD = byte_table(lambda b: b not in b" \t\n\x0b\x0c\r")
_SHIFT = np.uint64(64 - COUNTERS.bit_length() + 1)


def shingle_codes(values: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the shingles of some texts in order, and where each text's begin.

    A-Z are lower-cased, words are cut at ASCII white space; a text of fewer words is one shingle.
    """
    words = Words(values, _IN_WORD)
    n = np.bincount(words.text, minlength=len(values))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    start = np.flatnonzero(words.text[: max(len(words) - size + 1, 0)] == words.text[size - 1 :])
    short = np.flatnonzero((n > 0) & (n < size))
    start = np.concatenate((start, first[short]))
    end = np.concatenate((start[: len(start) - len(short)] + size, first[short] + n[short]))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    codes = mix(stretch_codes(words.code, start, end) + (end - start).astype(np.uint64))
    return codes, np.searchsorted(start, np.concatenate((first, [len(words)])))


def shingle_sets(values: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted 64-bit codes of the distinct shingles of each text."""
    codes, cuts = shingle_codes(values, size)
    return [np.unique(codes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return [v or b"" for v in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _steps(docs: DataFrame, size: int) -> Broadcast:
    """The frequency step of each counter, 0 to 63, from all texts; the driver holds COUNTERS bytes.

    Shingles are counted with repeats, a task's counters up to 255: the counts only order the columns.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint8)
        for part in slices(batches, limit=SLICE):
            at, n = np.unique((shingle_codes(_bytes(part), size)[0] >> _SHIFT).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)
        pages = counts.reshape(-1, PAGE)
        for page in np.flatnonzero(pages.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([pages[page].tobytes()], pa.binary())], names=["page", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAGE, dtype=np.int64)
        for batch in batches:
            for page in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(page, dtype=np.uint8)
        steps = np.minimum(63, 2 * np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["page", "steps"])

    out = np.zeros(COUNTERS, dtype=np.uint8)
    pages = docs.select("text").mapInArrow(run, "page int, counts binary").groupBy("page").applyInArrow(add, "page int, steps binary")
    for row in pages.collect():  # COUNTERS / PAGE rows at most
        out[row.page * PAGE : (row.page + 1) * PAGE] = np.frombuffer(row.steps, dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(out)


def _ranked(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The codes with their frequency step in the six highest bits, in order: rare columns come first."""
    step = steps[(codes >> _SHIFT).astype(np.int64)].astype(np.uint64)
    return np.sort((step << np.uint64(58)) | (codes & np.uint64((1 << 58) - 1)))


def _sets(docs: DataFrame, size: int, percent: int, steps: Broadcast) -> DataFrame:
    """(doc_id, n_shingles, signature, prefix): equal sets have equal signatures; the prefix is packed codes."""

    def work(part: pa.RecordBatch, _: list[str]) -> dict:
        n, signature, prefix = [], [], []
        for codes in shingle_sets(_bytes(part), size):
            n.append(len(codes))
            signature.append(xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None)
            # Alike sets share at least ceil(percent n / 100) shingles, so one of the n - that + 1 first ones.
            first = len(codes) - -(-percent * len(codes) // 100) + 1 if len(codes) else 0
            prefix.append(_ranked(codes, steps.value)[:first].tobytes())
        return {"n_shingles": pa.array(n, pa.int64()), "signature": pa.array(signature, pa.binary()), "prefix": pa.array(prefix, pa.binary())}

    return stored(map_texts(docs, work, "n_shingles bigint, signature binary, prefix binary", ["doc_id"], SLICE), "shingle-sets")


def _columns(reps: DataFrame) -> DataFrame:
    """(code, place, rep): a row for each shingle of a prefix; place is size * 2^31 + position."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                rows = [np.frombuffer(p, dtype=np.int64) for p in batch.column(2).to_pylist()]
                sizes = np.array([len(r) for r in rows])
                position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                place = np.repeat(batch.column(1).to_numpy() << 31, sizes) + position
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(place), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["code", "place", "rep"])

    return reps.select("rep", "n_shingles", "prefix").mapInArrow(run, "code bigint, place bigint, rep bigint")


def _shared_columns(columns: DataFrame) -> DataFrame:
    """(code, place, rep): the rows of columns that two documents or more have."""

    def run(batches):
        last = None  # the row before this batch: its columns, and whether it has been given out
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if not len(rows[0]):
                continue
            given = 0
            if last is not None:
                rows = [np.concatenate((v[None], r)) for v, r in zip(last[0], rows, strict=True)]
                given = last[1]
            same = rows[0][1:] == rows[0][:-1]
            shown = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            last = [r[-1] for r in rows], bool(shown[-1])
            shown[0] &= not given
            yield pa.RecordBatch.from_arrays([pa.array(r[shown]) for r in rows], names=["code", "place", "rep"])

    ordered = columns.repartition("code").sortWithinPartitions("code")
    return stored(ordered.mapInArrow(run, "code bigint, place bigint, rep bigint"), "shingle-columns")


def _possible(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes and places still allow enough overlap: what remains of both sets from here on is all they can share."""
    low = (1 << 31) - 1
    rest = np.minimum((a >> 31) - (a & low), (b >> 31) - (b & low))
    return (100 + percent) * rest >= percent * ((a >> 31) + (b >> 31))


def _candidates(ordered: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """(leader, rep): leaders number ``first`` to ``last`` of each column with later members of other groups.

    ``ordered``: code, place, rep, label, column by column within partitions. A task holds one batch and the
    leaders of one column; a pair whose bound fails is not written.
    """

    def run(batches):
        code, rank, held = None, 0, []
        for batch in batches:
            codes, places, reps, labels = (batch.column(i).to_numpy() for i in range(4))
            if not len(codes):
                continue
            begins = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
            length = np.diff(np.concatenate((begins, [len(codes)])))
            before = np.zeros(len(begins), dtype=np.int64)  # members of the column in earlier batches
            if codes[0] == code:
                before[0] = rank
            else:
                held = []
            column = np.repeat(np.arange(len(begins)), length)
            at = np.arange(len(codes)) - begins[column] + before[column]
            found = []

            def pair(leaders, members):
                kept = (labels[members] != leaders[2]) & _possible(percent, leaders[1], places[members])
                found.append(np.stack([np.broadcast_to(leaders[0], kept.shape)[kept], reps[members][kept]], axis=1))

            for leader in held:  # of the column that goes on
                pair(leader, np.arange(length[0]))
            for k in range(first, min(last, int((before + length).max()))):
                inside = (before <= k) & (before + length > k)
                position = np.where(inside, begins + k - before, 0)
                members = np.flatnonzero(inside[column] & (at > k))
                own = position[column[members]]
                pair((reps[own], places[own], labels[own]), members)
            final = column == len(begins) - 1
            lead = np.flatnonzero(final & (at >= first) & (at < last))
            held = (held if len(begins) == 1 else []) + [(reps[i], places[i], labels[i]) for i in lead]
            code, rank = codes[-1], int(before[-1] + length[-1])
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "rep"])

    return ordered.mapInArrow(run, "leader bigint, rep bigint").distinct()


def _round(shared: DataFrame, labels: DataFrame | None, first: int, last: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs of one round, and the size of the largest open column; a column of one group is closed.

    Members with the fewest rarer shingles of their own before the shared one lead: they are closest to what
    the column's members have in common, so most of a group of edited copies links to one of them.
    """
    label = F.col("rep") if labels is None else F.coalesce("label", "rep")
    named = shared if labels is None else shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("label", label)
    sizes = named.groupBy("code").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    sizes = stored(sizes.select("code", "n"), "open-columns")
    largest = sizes.agg(F.max("n").alias("n")).first().n or 0
    still = named.join(broadcast_if_small(sizes.select("code"), SMALL), "code")
    position = F.col("place").bitwiseAND(F.lit((1 << 31) - 1))
    ordered = still.select("code", "place", "rep", "label").repartition("code").sortWithinPartitions("code", position, "rep")
    return _candidates(ordered, first, last, percent), largest


def overlapping(leader: np.ndarray, members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members' sets are alike the leader's; all are codes in column order.

    One row of the product: counts grow block of columns by block of columns, and a member leaves once its
    count with all that is left of the smaller set cannot reach the bound that the two sizes set.
    """
    sizes = np.array([len(m) for m in members])
    need = -(-percent * (sizes + len(leader)) // (100 + percent))
    count = np.zeros(len(members), dtype=np.int64)
    alive = np.flatnonzero(np.minimum(sizes, len(leader)) >= need)
    edges = [int(k * len(leader) / COLUMN_BLOCKS) for k in range(1, COLUMN_BLOCKS)]
    done, seen = 0, np.zeros(len(members), dtype=np.int64)
    for stop in [*edges, len(leader)]:
        block = leader[done:stop]
        ends = sizes.copy()
        if stop < len(leader):
            ends[alive] = [np.searchsorted(members[m], leader[stop]) for m in alive.tolist()]
        rows = [members[m][seen[m] : ends[m]] for m in alive.tolist()]
        flat = np.concatenate([np.zeros(0, dtype=leader.dtype), *rows])
        if len(block) and len(flat):
            hit = block[np.minimum(np.searchsorted(block, flat), len(block) - 1)] == flat
            sums = np.concatenate(([0], np.cumsum(hit)))
            cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            count[alive] += sums[cuts[1:]] - sums[cuts[:-1]]
        done, seen = stop, ends
        alive = alive[count[alive] + np.minimum(len(leader) - done, sizes[alive] - seen[alive]) >= need[alive]]
    out = np.zeros(len(members), dtype=bool)
    out[alive] = True
    return out


def _links(docs: DataFrame, pairs: DataFrame, size: int, percent: int, steps: Broadcast) -> DataFrame:
    """The pairs (a, b) that are alike, by exact overlap. A leader's block has BLOCK members or so."""
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = pairs.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    heads = blocks.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = stored(placed.select("rep", "leader", "block").union(heads), "pair-blocks")
    uses = broadcast_if_small(wanted.groupBy("rep").agg(F.collect_list(F.struct("leader", "block")).alias("uses")), SMALL)
    used = docs.select(F.col("doc_id").alias("rep"), "text").join(uses, "rep")

    def encode(part: pa.RecordBatch, _: list[str]) -> dict:
        return {"codes": pa.array([_ranked(s, steps.value).tobytes() for s in shingle_sets(_bytes(part), size)], pa.binary())}

    coded = map_texts(used, encode, "codes binary", ["rep", "uses"], SLICE).select("rep", F.explode("uses").alias("use"), "codes")
    ordered = coded.select("use.leader", "use.block", "rep", "codes").repartition("leader", "block")
    ordered = ordered.sortWithinPartitions("leader", "block", F.col("leader") != F.col("rep"))

    def compare(batches):
        head, codes = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                leaders = batch.column(0).to_pylist()
                reps = batch.column(2).to_pylist()
                sets = [np.frombuffer(p, dtype=np.uint64) for p in batch.column(3).to_pylist()]
                out, at = [], 0
                while at < len(leaders):
                    if leaders[at] == reps[at]:
                        head, codes, at = leaders[at], sets[at], at + 1
                        continue
                    stop = at
                    while stop < len(leaders) and leaders[stop] == head and reps[stop] != head:
                        stop += 1
                    assert stop > at  # a block starts with its leader
                    alike = overlapping(codes, sets[at:stop], percent)
                    out += [(head, r) for r, yes in zip(reps[at:stop], alike.tolist(), strict=True) if yes]
                    at = stop
                columns = list(zip(*out, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["a", "b"])

    return stored(ordered.mapInArrow(compare, "a bigint, b bigint"), "alike")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) once more links join the groups that ``labels`` names; only groups with new links are worked on."""
    if labels is None:
        return components(links)
    one, two = (labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("a", "b"))
    between = links.join(one, "a", "left").join(two, "b", "left")
    between = stored(between.select("a", "b", F.coalesce("a_label", "a").alias("a_label"), F.coalesce("b_label", "b").alias("b_label")), "links")
    named = components(between.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    ends = between.select(F.col("a").alias("node")).union(between.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    named = named.select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = labels.unionByName(fresh).join(named, "label", "left")
    return stored(every.select("node", F.coalesce("to", "label").alias("label")), "labels")


def alike_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``, which needs ``doc_id`` (bigint) and ``text``.

    Sets link if they share ``percent`` per cent of their union. The component is the smallest id that
    links reach. Texts of fewer words than a shingle are one shingle; null texts and texts without
    words have none and are alone. Equal sets are compared once, by their smallest id. Rows with one id
    should have one text; rows with a null id link with nothing and have a null component unless an
    equal set has an id. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    steps = _steps(docs, size)
    sets = _sets(docs, size, percent, steps)
    reps = sets.where("n_shingles > 0").groupBy("signature").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"))
    shared = _shared_columns(_columns(reps.where("rep is not null")))
    labels, tested, first, last = None, None, 0, 1
    while True:
        pairs, largest = _round(shared, labels, first, last, percent)
        if not largest:
            break
        if tested is not None:
            known = tested.union(tested.select(F.col("rep").alias("leader"), F.col("leader").alias("rep")))
            pairs = pairs.join(known, ["leader", "rep"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            links, tested = _links(docs, pairs, size, percent, steps), pairs if tested is None else tested.union(pairs)
            if not links.isEmpty():
                labels = _joined(labels, links)
        if last >= largest:
            break
        first, last = last, STEP * last
    smallest = sets.where("n_shingles > 0").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    named = smallest.withColumn("component_id", F.col("rep"))
    if labels is not None:
        named = smallest.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    joined = sets.select("doc_id", "n_shingles", "signature").join(named.select("signature", "component_id"), "signature", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of ``docs`` whose id is their group's; one document of each group stays.

    Rows with a null id stay. Of rows with one id, all stay or none.
    """
    groups = alike_groups(docs, size, percent)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
