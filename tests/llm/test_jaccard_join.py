import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import components as components_module
from pagemill.llm import jaccard_join
from pagemill.llm.components import components


@pytest.fixture(params=[1, 2, 3, 1000])
def batch_rows(request, spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield request.param
    spark.conf.set(key, before)


def test_columns_over_many_batches(spark, batch_rows):
    """A frequent shingle's documents fill batch after batch; leaders and their pairs stay the same."""
    data = [(c, (5 << 31) + r % 3, 100 * c + r) for c, n in ((1, 1), (2, 7), (3, 1), (4, 2), (5, 9), (6, 1)) for r in range(n)]
    columns = spark.createDataFrame(data, "code long, place long, rep long").repartition(1)
    shared = sorted(tuple(r) for r in jaccard_join._shared_columns(columns).collect())
    assert shared == sorted(d for d in data if d[0] in (2, 4, 5))
    rows = [(c, p, r, r % 4) for c, p, r in shared]
    for first, last in ((0, 1), (1, 4), (2, 100)):
        ordered = spark.createDataFrame(rows, "code long, place long, rep long, label long").repartition(1).sortWithinPartitions("code", "rep")
        got = {tuple(r) for r in jaccard_join._candidates(ordered, first, last, 85).collect()}
        want = set()
        for code in (2, 4, 5):
            members = sorted(((p, r, g) for c, p, r, g in rows if c == code), key=lambda m: m[1])
            for k, (p, r, g) in enumerate(members[first:last], first):
                for q, other, h in members[k + 1 :]:
                    rest = min(5 - p % 2**31, 5 - q % 2**31)
                    want |= {(r, other)} if g != h and 185 * rest >= 85 * 10 else set()
        assert got == want, (first, last)


def test_one_large_group(spark):
    """Thousands of near copies of one text are one group, whatever batches they come in."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(text + " "), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("")).alias("text")
    )
    out = jaccard_join.alike_groups(docs, size=4, percent=85)
    assert out.count() == 3000 and out.where("component_id <> 0").isEmpty()


def test_sets_of_shingles():
    values = [b"", b"  \t ", b"One", b"one TWO three", "a b c d É".encode(), b"a b c d a b c d", b"\x00 \x00"]
    sets = jaccard_join.shingle_sets(values, 4)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 4, 1]
    assert sets[2].tolist() != sets[3].tolist() and jaccard_join.shingle_sets([b"x", b"ONE two  three"], 4)[1].tolist() == sets[3].tolist()
    assert len({jaccard_join.shingle_sets([v], 2)[0][0] for v in (b"a b", b"b a", b"ab", b"a", b"a\x00 b")}) == 5


def test_overlaps_in_blocks_of_columns():
    draw = np.random.default_rng(3)
    for _ in range(60):
        leader = np.unique(draw.integers(0, 400, size=draw.integers(1, 120))).astype(np.uint64)
        members = [np.unique(draw.integers(0, 400, size=draw.integers(1, 120))).astype(np.uint64) for _ in range(6)]
        members += [leader, leader[: max(1, len(leader) * 9 // 10)], np.unique(np.concatenate((leader, [np.uint64(999)])))]
        for percent in (50, 85):
            shared = [len(np.intersect1d(leader, m)) for m in members]
            want = [100 * k >= percent * (len(leader) + len(m) - k) for k, m in zip(shared, members, strict=True)]
            assert jaccard_join.overlapping(leader, members, percent).tolist() == want


def groups_of(texts, size, percent):
    sets = [{tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set() for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return [root(a) for a in range(len(texts))]


def test_boilerplate_that_a_third_of_the_rows_share(spark):
    """Texts that mostly are one shared passage with a few words of their own: many possible pairs, few links."""
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for i in range(360):
        own = [f"o{i}x{k}" for k in range(draw.choice([0, 5, 7, 9, 11, 13]))]
        if i % 3 == 0:
            words = list(passage)
            at = draw.randrange(80)
            texts.append(" ".join(words[:at] + own + words[at:]))
        else:
            texts.append(" ".join(f"u{draw.randrange(40)}" for _ in range(draw.randrange(1, 40))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    got = {r.doc_id: r.component_id for r in jaccard_join.alike_groups(docs, 4, 85).collect()}
    assert got == dict(enumerate(groups_of(texts, 4, 85)))
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs, 4, 85).collect()}
    assert kept == set(got.values())


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (7, text), (7, text), (None, "alone here"), (9, None), (9, None), (3, ""), (5, text.upper())]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rep int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.alike_groups(docs, 4, 85).collect()), key=str)
    want = [(None, 3, 5), (7, 3, 5), (7, 3, 5), (None, 1, None), (9, 0, 9), (9, 0, 9), (3, 0, 3), (5, 3, 5)]
    assert got == sorted(want, key=str)


def rounds_of(spark, monkeypatch, edges):
    written = []
    real = components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df, name: written.append(name) or real(df, name))
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return out, written.count("nearest")


def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch):
    out, rounds = rounds_of(spark, monkeypatch, [(i, i + 1) for i in range(500)] + [(900, 901), (901, 900), (905, 905)])
    assert out == {**dict.fromkeys(range(501), 0), 900: 900, 901: 900}
    assert rounds < 15


def test_a_star_and_no_links(spark, monkeypatch):
    out, rounds = rounds_of(spark, monkeypatch, [(1000, i) for i in range(300)])
    assert set(out.values()) == {0} and len(out) == 301 and rounds <= 4
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
