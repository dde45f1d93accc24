"""Queries with SQL against it, classifiers on held-out rows, and odd tables through every query."""

import zlib

import duckdb
import pytest
from compare import differences, run_query, run_sql

from pagemill.llm import jaccard_join, language_id, line_dedup, quality_classifier, toxicity
from pagemill.llm.queries import ORACLES, QUERIES

SQL = sorted(ORACLES)
# These return conversations, ranks and phrases instead of one row a document.
OTHERS = ["op11_chat_format", "op12_ranked_search", "op13_collocations"]

LINE = "One line of text that several documents share, with enough words to count."
ODD = [
    None, "", " \t\n ", "one", "one two three", "One TWO three four", LINE, f"  {LINE.upper()}\r", f"{LINE}\n\nmore\n{LINE}\n", f"x\n{LINE}",
    "a b c d e f g h i j k l m n o p q r s t", "A b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u",
    "ha " * 3000, "word with spaces \x1c and\x0bmore İẞ É é \U0001f600", "# * $ % & | < > " * 20, "long " + "y" * 60_000,
    "the quick brown fox jumps over the lazy dog and runs away from here today",
    "THE quick, brown fox-jumps over the lazy dog and", "quick brown fox jumps over the lazy dog and runs away", "short item",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of small odd tables, and one of empty tables."""
    top = tmp_path_factory.mktemp("odd")
    docs = [(i, t, None if i % 3 else "en", "s", len(t or ""), "clash") for i, t in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    bench = [(0, "quick brown fox jumps over the lazy dog and runs"), (1, None), (2, ""), (3, "Short ITEM!"), (4, "short item"), (5, "the quick brown fox jumps over the lazy dog and runs")]
    talk = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, None, None), (None, 0, "assistant", "### x: </turn>"), (None, 0, "assistant", ""), (3, 5000, "assistant", "late \\"), (3, -1, "a:b\n", "\n early")]
    labels = [(0, 1, 0), (7, 1, 1), (8, 0, None), (9, None, 1), (9, 1, 1), (11, 0, 0), (None, 1, 1)]
    for name, keep in (("some", 1), ("none", 0)):
        spark.createDataFrame(docs * keep, schema).write.parquet(f"{top}/{name}/documents.parquet")
        spark.createDataFrame(bench * keep, "item_id long, text string").write.parquet(f"{top}/{name}/benchmark.parquet")
        spark.createDataFrame(talk * keep, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/{name}/conversations.parquet")
        spark.createDataFrame(labels * keep, "doc_id long, quality int, toxic int").write.parquet(f"{top}/{name}/labels.parquet")
    return top


def sql_on(folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return run_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", SQL)
def test_sql(name, spark, sf, con):
    assert differences(run_query(QUERIES[name](spark, sf)), run_sql(con, ORACLES[name])) == ""


@pytest.mark.parametrize("name", SQL)
def test_sql_on_odd_texts(name, spark, odd):
    assert differences(run_query(QUERIES[name](spark, f"{odd}/some")), sql_on(f"{odd}/some", name)) == ""


@pytest.mark.parametrize("name", OTHERS)
def test_empty_tables(name, spark, odd):
    assert [r.conv_id for r in QUERIES[name](spark, f"{odd}/none").collect()] == ([-7] if name == "op11_chat_format" else [])
    assert differences(run_query(QUERIES[name](spark, f"{odd}/none")), sql_on(f"{odd}/none", name)) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - set(OTHERS)))
def test_odd_and_empty_tables(name, spark, odd):
    assert QUERIES[name](spark, f"{odd}/none").collect() == []
    rows = QUERIES[name](spark, f"{odd}/some").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(ODD)))
    for r in rows:
        if "score" in r:
            assert 0 <= r.score <= 1
        if "held_out" in r:
            modulus, rest = (5, 0) if name.startswith("op7") else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)


def held_out(spark, name, sf_dir, column):
    docs = spark.read.parquet(f"{sf_dir}/{column[0]}.parquet").select("doc_id", column[1]).where(f"{column[1]} is not null")
    return QUERIES[name](spark, sf_dir).where("held_out").join(docs, "doc_id").toPandas()


def test_language_of_held_out_texts(spark):
    found = held_out(spark, "op4_language_id", "/root/testdata/sf0.01", ("documents", "lang"))
    assert (found.lang == found.lang_pred).mean() > 0.97


def test_quality_of_held_out_texts(spark):
    found = held_out(spark, "op7_quality_classifier", "/root/testdata/sf0.1", ("labels", "quality"))
    assert (found.quality == found.predicted).mean() > 0.95


def test_toxicity_of_held_out_texts(spark):
    found = held_out(spark, "op1_toxicity", "/root/testdata/sf0.1", ("labels", "toxic"))
    toxic = found.toxic == 1
    assert (found.predicted[toxic] == 1).mean() > 0.7
    assert (found.predicted[~toxic] == 0).mean() > 0.98


def test_unlearned_models(spark):
    docs = spark.createDataFrame([(None, "text"), (1, None), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string, label int")
    for operator in (toxicity, quality_classifier):
        assert [round(r.score, 3) for r in operator.score(docs, operator.train(none)).collect()] == [0.5] * 3
    filters = language_id.train(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(docs, filters).collect()} == {"und"}


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, LINE), (1, LINE), (None, LINE), (None, f"a\n{LINE}"), (2, LINE), (3, f"{LINE}\nb")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, keys int")
    got = {r["keys"]: (r.text, r.n_dropped) for r in line_dedup.drop_repeated(docs).collect()}
    assert got == {0: ("", 1), 1: ("", 1), 2: ("", 1), 3: ("a", 1), 4: ("", 1), 5: (f"{LINE}\nb", 0)}


def test_groups_need_many_rounds(spark):
    """Texts that share rare words but link only in chains: groups equal those of all pairs."""
    import random

    draw = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(120)] = f"v{draw.randrange(5)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    group = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: r.component_id for r in jaccard_join.alike_groups(docs, 4, 85).collect()}
    assert got == dict(enumerate(group))
    assert {r.doc_id for r in jaccard_join.one_of_each(docs, 4, 85).collect()} == set(group)
