import base64
import hashlib
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline


def test_each_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        assert 0 < out.count() <= n, name
        assert out.groupBy("doc_id").count().where("count > 1").isEmpty()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            docs, n = out, out.count()
    assert out.count() == n


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.where("n_tokens > 0").count() == rows.count() > 0


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, sf, number):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "plain text", None, "s", 10), (2, "plain text", None, "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, docs, sf).count() <= 4
    assert stage(spark, docs.limit(0), sf).count() == 0


# --- the stages against plain Python -----------------------------------------------------------------
LINE = "A license line that many of the documents repeat word for word."
ITEM = "an item of the benchmark with more than ten words that some documents hold as they are"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(docs):
    """Keys of three documents or more stay in the largest id."""
    def key(line):
        k = low(line).strip(" \t\n\x0b\f\r")
        return k if len(k) >= 20 else None

    holders = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        if len(kept) == len(lines) or "\n".join(kept).strip(" ") != "":
            out[i] = "\n".join(kept)
    return out


def plain_alike(docs, size=5, percent=80):
    """The smallest id of each group of linked documents."""
    sets = {i: {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set() for i, w in ((i, low(t).split()) for i, t in docs.items())}
    group = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {i: t for i, t in docs.items() if group[i] == i}


def plain_clean(docs, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))

    tests = {tuple(w[k : k + window]) for w in map(words, items) for k in range(max(len(w) - window + 1, 1)) if w}
    return {i: t for i, t in docs.items() if not any(tuple(w[k : k + len(s)]) == s for w in [words(t)] for s in tests for k in range(len(w)))}


def test_run_equals_plain_python(spark, sf, tmp_path):
    """Every decision of stages two to five on what the first one keeps; of the first, which rows it may keep."""
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) between 200 and 900").orderBy("doc_id").limit(14).collect()]
    texts = [t.replace("\r", " ") for t in given]
    texts += [f"{t}\n{LINE}" for t in texts[:5]] + [f"  {LINE.upper()} \n{texts[6]}", LINE, texts[7] + " and one word more", texts[8].replace(" ", "  ", 3)]
    texts += [f"{texts[9]}\n{ITEM}", f"{ITEM.upper()}!", "", "1234 5678 90", " \t\n ", "benchmark short", texts[3]]
    langs = ["en", "fr", "de", "es"]
    rows = [(i, t, langs[i % 4] if i % 5 else None, "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, "Benchmark: short"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = {r.doc_id: r.text for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()}
    assert first.items() <= {i: t for i, t, *_ in rows}.items()
    assert not {i for i in first if not re.search(r"[^\W\d_]", first[i] or "")}  # nothing without a letter
    want = plain_clean(plain_alike(plain_lines(first)), [ITEM, "Benchmark: short"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.VOCABULARY[0], "rb"))}
    tool = tiktoken.Encoding("ranks", pat_str=corpus_pipeline.VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) > 8
    for i, text in want.items():
        ids = tool.encode_ordinary(text)
        assert (got[i].n_tokens, bytes(got[i].ids)) == (len(ids), np.array(ids, dtype="<u4").tobytes())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
