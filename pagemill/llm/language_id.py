"""Language identification by Bloom filters whose slots hold one bit for each language.

An n-gram belongs to the languages in which it is about as frequent as in the one that uses it most.
Languages with about as many n-grams share one set of slots, large enough for the largest of them: a slot is
a mask of languages, and the masks of an n-gram's slots, taken together by AND, are the languages that contain it. A document's n-grams vote with these masks; the
votes of a language are corrected for the false positives that its fill of the filter predicts.
"""

from __future__ import annotations

import functools
import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import code_points, map_texts, mix, slices, texts

GRAM = 4
# The fewest slots of a set, as a power of two; a set has more where a language would fill more than half.
SLOT_BITS = 20
HASHES = 3
# An n-gram counts for a language from this share of its highest relative frequency on.
SHARE = 0.25
LEAST = 3
# Languages in one mask; more languages take further masks.
PER_MASK = 62
# Slots the driver fetches at a time.
FETCH = 1 << 24


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower-case form as one code point; 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of letters and single gaps, the text each is from, and which texts have a letter."""
    points, starts = code_points(values)
    letters = _letters()[points]
    owner = np.repeat(np.arange(len(values)), np.diff(starts))
    has = np.bincount(owner[letters > 0], minlength=len(values)) > 0
    # Runs of other characters become one gap; every text starts and ends with a gap.
    real = letters > 0
    first_gap = ~real & np.concatenate(([True], real[:-1])) if len(real) else real
    used = real | first_gap
    ends = starts[1:] - 1
    line, who = letters[used], owner[used]
    cuts = np.flatnonzero(np.diff(who)) + 1
    line, who = np.insert(line, np.concatenate(([0], cuts, cuts, [len(line)])), 0), np.insert(who, np.concatenate(([0], cuts, cuts, [len(who)])), np.concatenate((who[:1], who[cuts - 1], who[cuts], who[-1:]))) if len(who) else who
    n = len(line) - GRAM + 1
    if not len(ends) or n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    code = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(16)) ^ line[k : k + n].astype(np.uint64)
    inside = (who[:n] == who[GRAM - 1 :]) & ((line[1 : n + 1] > 0) | (line[2 : n + 2] > 0))
    return code[inside], who[:n][inside], has


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, lang, n): how often each n-gram occurs in the texts of each language; sums of all documents."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def summed():
            table = pa.concat_tables(held).group_by(["gram", "lang"]).aggregate([("n", "sum")])
            return table.select(["gram", "lang", "n_sum"]).rename_columns(["gram", "lang", "n"])

        for part in slices(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            found, who, _ = grams(texts(part))
            for i, name in enumerate(names):
                own, n = np.unique(found[number[who] == i], return_counts=True)
                held.append(pa.table({"gram": own.view(np.int64), "lang": pa.array([name] * len(own), pa.string()), "n": n.astype(np.int64)}))
                size += len(own)
            if size > 1_000_000:
                held[:] = [summed()]
                size = held[0].num_rows if held[0].num_rows < 500_000 else 0
                if not size:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    parts = docs.where("lang is not null").select("lang", "text").mapInArrow(run, "gram bigint, lang string, n bigint")
    return parts.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilters:
    """Sets of slots of language masks. Bit ``b`` of ``slots[w][s]`` is language ``numbers[w][b]`` in slot ``s``."""

    languages: list[str]
    numbers: list[list[int]]
    slots: list[np.ndarray]

    def false_rates(self) -> np.ndarray:
        """For each language, how often an n-gram in no filter finds all its slots set."""
        fill = np.zeros(len(self.languages))
        for numbers, slots in zip(self.numbers, self.slots, strict=True):
            for bit, number in enumerate(numbers):
                fill[number] = np.count_nonzero(slots & slots.dtype.type(1 << bit)) / len(slots)
        return fill**HASHES

    def votes(self, codes: np.ndarray, who: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, n-grams of each text in each language)."""
        out = np.zeros((n, len(self.languages)))
        where: dict[int, list[np.ndarray]] = {}
        for numbers, slots in zip(self.numbers, self.slots, strict=True):
            bits = len(slots).bit_length() - 1
            if bits not in where:
                where = {bits: _slots_of(codes, bits)}
            mask = slots[where[bits][0]]
            for slot in where[bits][1:]:
                mask &= slots[slot]
            for bit, number in enumerate(numbers):
                out[:, number] = np.bincount(who, weights=(mask >> mask.dtype.type(bit)) & mask.dtype.type(1), minlength=n)
        return np.bincount(who, minlength=n), out


def _slots_of(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of n-grams among 2^bits, from one hash as far as its bits go."""
    hashed, last = mix(codes), np.uint64((1 << bits) - 1)
    if bits * HASHES <= 64:
        return [(hashed >> np.uint64(bits * k)) & last for k in range(HASHES)]
    return [mix(hashed + np.uint64(k)) & last for k in range(HASHES)]


def _slot_bits(members: int) -> int:
    """Slots for so many n-grams, as a power of two: at most about half of them get filled."""
    return max(SLOT_BITS, math.ceil(math.log2(max(1, members) * HASHES / math.log(2))))


def _sets(sizes: dict[int, int], languages: int) -> list[tuple[int, list[int]]]:
    """(bits, languages) of each set: those that need the same number of slots, ``PER_MASK`` at a time."""
    alike: dict[int, list[int]] = {}
    for number in range(languages):
        alike.setdefault(_slot_bits(sizes.get(number, 0)), []).append(number)
    return [(bits, held[i : i + PER_MASK]) for bits, held in sorted(alike.items()) for i in range(0, len(held), PER_MASK)]


def train(docs: DataFrame) -> LanguageFilters:
    """Filters of all languages in ``lang``, from all its texts. Null languages and texts teach nothing.

    The driver gets the sums of each language and the filled slots, ``FETCH`` at a time. They take one to eight
    bytes each and grow with the largest language of a set: 9 to 17 slots for two of its n-grams, or 2^SLOT_BITS.
    """
    from ..session import stored

    counts = stored(gram_counts(docs), "gram-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilters([], [], [])
    known = docs.sparkSession.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(languages)], "lang string, number int, total double")
    rated = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total"))
    highest = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("number", "rate", "n")).alias("each"))
    chosen = highest.select("gram", "top", F.explode("each").alias("one")).where((F.col("one.rate") >= SHARE * F.col("top")) & (F.col("one.n") >= LEAST))

    # Counted first, then filled.
    members = stored(chosen.select("gram", "one.number"), "gram-members")
    sizes = {r.number: r["count"] for r in members.groupBy("number").count().collect()}
    sets = _sets(sizes, len(languages))
    word_of, place_of = np.zeros(len(languages), np.int32), np.zeros(len(languages), np.int64)
    for word, (_, numbers) in enumerate(sets):
        word_of[numbers], place_of[numbers] = word, np.arange(len(numbers))

    def to_slots(batches):
        for batch in batches:
            codes, number = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for word in np.unique(word_of[number]):
                own = word_of[number] == word
                found = np.concatenate(_slots_of(codes[own], sets[word][0])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), word)), pa.array(np.tile(np.int64(1) << place_of[number[own]], HASHES))],
                    names=["slot", "word", "mask"],
                )

    filled = members.mapInArrow(to_slots, "slot bigint, word int, mask bigint")
    table = stored(filled.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")), "slots")
    slots = []
    for word, (bits, numbers) in enumerate(sets):
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(numbers) <= 8 * t().itemsize)
        slots.append(np.zeros(1 << bits, dtype=kind))
        for begin in range(0, 1 << bits, FETCH):
            some = table.where((F.col("word") == word) & (F.col("slot") >= begin) & (F.col("slot") < begin + FETCH)).select("slot", "mask").toArrow()
            slots[-1][some["slot"].to_numpy()] = some["mask"].to_numpy().astype(kind)
    return LanguageFilters(languages, [numbers for _, numbers in sets], slots)


def predict(docs: DataFrame, filters: LanguageFilters, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the kept columns of ``docs`` (default: ``doc_id``).

    The score is the language's part of all corrected votes. Ties go to the first language by name. A
    null, empty or letterless text, and any text when no language was learned, is ``und`` with score 0;
    a text whose n-grams no language knows gets the first language with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(_: pa.RecordBatch, values: list[str]) -> dict:
        filters = shared.value
        codes, who, has = grams(values)
        if not filters.languages:
            return {"lang_pred": pa.array(["und"] * len(values)), "score": pa.array(np.zeros(len(values)))}
        n, votes = filters.votes(codes, who, len(values))
        false = filters.false_rates()
        share = np.maximum(0, votes / np.maximum(1, n)[:, None] - false) / np.maximum(1e-9, 1 - false)
        best = share.argmax(axis=1)
        score = share[np.arange(len(values)), best] / np.maximum(1e-12, share.sum(axis=1))
        return {
            "lang_pred": pa.array([filters.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], pa.string()),
            "score": pa.array(np.where(has, np.minimum(1.0, score), 0.0)),
        }

    return map_texts(docs, work, "lang_pred string, score double", keep or ["doc_id"])


def learnable(fold_of: Column, held: int) -> Column:
    """Rows to learn from: those with an id whose remainder is another one."""
    return F.coalesce(fold_of != held, F.lit(False))
