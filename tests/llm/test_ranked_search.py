import math
import random
import re
from collections import Counter

import numpy as np

from pagemill.llm import ranked_search
from pagemill.llm.ranked_search import Best, Shard, Statistics, search_shard


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked_search.TERM, low)


def brute(docs, queries, best):
    """Every document scored against every query in plain integers."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scores += [(-score, i is not None, i, score)] * (score > 0)
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:best], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünï", "42"]
    docs = [(i, " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(63)], k=draw.randrange(30)))) for i in range(n)]
    copy = docs[3][1] + " w7 w9"
    docs += [(n + i, copy) for i in range(n // 3)] + [(None, copy), (None, ""), (5, docs[5][1]), (9 * n, None), (9 * n + 1, "only unasked"), (9 * n + 2, "w1 " * 70_000)]
    return docs, [(k, " ".join(draw.choices(words, k=12))) for k in range(6)] + [(None, "w3 W4"), (7, None), (8, ""), (9, "nowhere"), (0, "w50"), (10, "w7, w9; w7")]


def test_equal_to_scoring_all(spark):
    docs, queries = corpus(1, 400)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
    asked = spark.createDataFrame([(k, t, 0) for k, t in queries], "item_id int, text string, doc_id int")
    for passes in (ranked_search.PASS_TERMS, 5):
        got = [tuple(r) for r in ranked_search.search(table, asked, best=20, pass_terms=passes).collect()]
        assert sorted(got, key=str) == brute(docs, queries, 20)


def test_shards_with_many_blocks_lose_no_document():
    """Shards one after the other, lists of many blocks, ties by the thousand, against all scores."""
    draw = np.random.default_rng(5)
    n, width = 3_000, 80
    rows = [np.sort(draw.choice(width, size=draw.integers(0, 25), replace=False, p=(p := 1 / np.arange(1, width + 1)) / p.sum())) for _ in range(n)]
    rows[500:1500] = [rows[499]] * 1000
    counts = [draw.integers(1, 4, size=len(r)) for r in rows]
    counts[500:1500] = [counts[499]] * 1000
    sizes = np.array([c.sum() + 3 for c in counts])
    sizes[499:1500] = sizes[499]
    holders = np.bincount(np.concatenate(rows), minlength=width)
    stats = Statistics(n, int(sizes.sum()), holders)
    weight = stats.weights()
    ids = draw.permutation(n)
    dense = np.zeros((n, width), dtype=np.int64)
    for i, (r, c) in enumerate(zip(rows, counts, strict=True)):
        dense[i, r] = 10**9 * c // (1000 * c + 20 * (50 + 50 * sizes[i] * n // sizes.sum()))
    shards = []
    for at in range(0, n, 1000):
        part = range(at, at + 1000)
        cuts = np.concatenate(([0], np.cumsum([len(rows[i]) for i in part])))
        shards.append(Shard(ids[at : at + 1000], sizes[at : at + 1000], cuts, np.concatenate([rows[i] for i in part]), np.concatenate([counts[i] for i in part]), stats))
    skipped = 0
    for k in range(40):
        terms = np.sort(draw.choice(width, size=8, replace=False))
        best = Best(25)
        for shard in shards:
            search_shard(shard, terms, weight, best)
            skipped += sum(t not in shard.lists for t in terms.tolist())
        scores = dense[:, terms] @ weight[terms]
        order = np.lexsort((ids, -scores))[:25]
        order = order[scores[order] > 0]
        assert best.ids.tolist() == ids[order].tolist() and best.scores.tolist() == scores[order].tolist(), k
    assert skipped  # some lists are never needed
    docs, cuts, _, summaries = shards[0].blocks(0)
    assert np.diff(cuts).max() <= ranked_search.BLOCK_DOCS and sorted(docs.tolist()) == [i for i in range(1000) if 0 in rows[i]]
    for b in range(len(cuts) - 1):
        most = dense[docs[cuts[b] : cuts[b + 1]]].max(axis=0)
        row = slice(summaries.cuts[b], summaries.cuts[b + 1])
        assert dict(zip(summaries.term[row].tolist(), summaries.value[row].tolist(), strict=True)) == {t: v for t, v in enumerate(most.tolist()) if v}


def test_terms_that_share_a_code_are_told_apart():
    from pagemill.llm.words import Words

    vocabulary = ranked_search.Vocabulary.of([b"ab", b"cd"])
    forged = Words([b"ab cd zz"], ranked_search._IN_TERM)
    forged.code[2] = forged.code[0]
    assert vocabulary.find(forged).tolist() == [0, 1, -1]
