import random

from pagemill.llm import decontaminate
from pagemill.llm.decontaminate import words


def longest_runs(doc, items, window):
    """Every maximal stretch of an item in a document, by comparing all pairs of places."""
    out = set()
    for item, text in items:
        own = words(text)
        need = min(window, len(own))
        found = set()
        for p in range(len(doc)):
            for q in range(len(own)):
                k = 0
                while p + k < len(doc) and q + k < len(own) and doc[p + k] == own[q + k]:
                    k += 1
                if need and k >= need:
                    found.add((p, k))
        out |= {(item, p, k) for p, k in found if not any(a <= p and p + k <= a + b and (a, b) != (p, k) for a, b in found)}
    return sorted(out)


def random_case(draw):
    vocabulary = ["a", "B", "c", "d1", "é"]
    items = [(str(k), " ".join(draw.choices(vocabulary, k=draw.randrange(14)))) for k in range(4)]
    docs = []
    for i in range(12):
        text = draw.choices([*vocabulary, "other"], k=draw.randrange(30))
        for _ in range(2):
            _, item = draw.choice(items)
            part = item.split()[draw.randrange(3) : draw.randrange(4, 15)]
            at = draw.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((i, " ".join(text)))
    return docs, items


def test_matches_are_the_longest_common_stretches(spark):
    draw = random.Random(7)
    for chunk in (decontaminate.CHUNK_WINDOWS, 3):
        docs, items = random_case(draw)
        docs += [(50, "a " * 40), (51, None), (52, ""), (53, docs[0][1]), (None, docs[1][1])]
        items += [("rep", "a a a a a a"), ("none", None), ("short", "c d1"), ("short2", "C  D1!")]
        table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(2)
        tests = spark.createDataFrame(items, "item_id string, text string")
        rows = decontaminate.longest_matches(table, tests, keep=["doc_id"], window=5, chunk=chunk).collect()
        got = sorted(((r.doc_id, r.n_words, sorted((m.item_id, m.start, m.size) for m in r.matches)) for r in rows), key=str)
        want = sorted(((i, len(words(t)), longest_runs(words(t), items, 5)) for i, t in docs), key=str)
        assert got == want


def test_many_random_joins():
    """The joining alone, on many small cases of few words, where places in an item are ambiguous."""
    draw = random.Random(11)
    for _ in range(300):
        docs, items = random_case(draw)
        index = decontaminate.TestIndex(items, 3)
        rows = [words(t) for _, t in docs]
        for row, found in zip(rows, decontaminate._by_row(*index.search(rows)), strict=True):
            got = sorted((m["item_id"], m["start"], m["size"]) for m in decontaminate._joined(found, index))
            assert got == longest_runs(row, items, 3)


def test_null_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (None, "x")], "doc_id long, text string")
    tests = spark.createDataFrame([(4, "two three"), (4, "two three"), (None, "one two"), (5, "four five six")], "item_id long, text string")
    rows = decontaminate.longest_matches(docs, tests).collect()
    assert [[(m.item_id, m.start, m.size) for m in r.matches] for r in rows if r.doc_id == 1] == [[(4, 1, 2)]] * 2
    assert [r.doc_id for r in decontaminate.clean_documents(docs, tests).collect()] == [None]
    assert decontaminate.clean_documents(docs, tests.limit(0)).count() == 3
