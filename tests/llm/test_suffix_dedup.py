import hashlib
from collections import Counter

import numpy as np

from pagemill.llm import suffix_dedup
from pagemill.llm.queries import QUERIES

LENGTH = 400


def plain(texts):
    """Remove the bytes of every string that starts twice anywhere, by counting all strings."""
    raws = [(t or "").encode() for t in texts]
    n = Counter(hash(r[i : i + LENGTH]) for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=np.int64)
        for i in range(len(r) - LENGTH + 1):
            if n[hash(r[i : i + LENGTH])] > 1:
                gone[i] += 1
                gone[min(len(r), i + LENGTH)] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        edges = np.diff(np.concatenate(([0], covered.astype(int), [0])))
        kept = bytes(np.frombuffer(r, np.uint8)[~covered])
        out.append((len(r), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, texts):
    want = dict(enumerate(plain(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(got) == len(texts)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:5]


def test_query_against_counting(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert [d.doc_id for d in docs] == list(range(len(docs)))
    check(QUERIES["op3_suffix_dedup"](spark, sf).collect(), [d.text for d in docs])


def test_hard_texts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = word(900)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 1500, passage, word(50) + passage[100:520] + word(70), "ab" * 700, "é" + passage[300:705]]
    texts += [word(300) + passage[k : k + 400 + k % 7] + word(300) for k in range(0, 500, 37)]
    texts += [word(200) + passage[200:480] + word(200) for _ in range(90)]  # a hot anchor without long repeats
    texts += [passage[150:480] + word(40 + k) for k in range(5)] + [passage[150:480] + "tail " * 30] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect(), texts)


def test_repeated_null_and_clashing_rows(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(450)) + "z" * 3
    rows = [(1, text, 1), (1, text, 2), (None, text, 3), (None, None, 4), (2, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.spans_, r.n_removed) for r in suffix_dedup.drop_repeats(docs.withColumnRenamed("spans", "spans_"), keep=["doc_id", "spans_"]).collect())
    assert got == [(1, 453), (2, 453), (3, 453), (4, 0), (5, 0)]
    assert suffix_dedup.drop_repeats(docs.limit(0)).collect() == []
