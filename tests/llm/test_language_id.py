"""Language filters when one language has far more n-grams than the others."""

import random

from pyspark.sql import functions as F

from pagemill.llm import language_id


def test_a_crowded_language_leaves_the_others_alone(spark):
    """Some two million n-grams of one language, which filled 2^20 slots to 0.997."""
    rng = random.Random(1)
    crowded = ["".join(map(chr, rng.choices(range(0x4E00, 0x9FA0), k=2000))) for _ in range(1000)]
    words = [["river", "stone", "garden", "winter"], ["fluss", "steinig", "garten", "wetter"]]
    plain = [(lang, " ".join(rng.choices(own, k=30))) for lang, own in zip(("en", "xx"), words, strict=True) for _ in range(40)]
    texts = spark.createDataFrame([("aa", t) for t in crowded] + plain, "lang string, text string").repartition(8)
    filters = language_id.train(texts.crossJoin(spark.range(3)))
    assert max(filters.false_rates()) < 0.15
    asked = [("aa", t[:12]) for t in crowded[:50]] + [(lang, w) for lang, own in zip(("en", "xx"), words, strict=True) for w in own]
    got = language_id.predict(spark.createDataFrame(asked, "doc_id string, text string"), filters).collect()
    assert [(r.doc_id, r.lang_pred) for r in got if r.doc_id != r.lang_pred] == []


def test_more_languages_than_a_mask_holds_and_slots_of_several_sizes(monkeypatch, spark):
    monkeypatch.setattr(language_id, "SLOT_BITS", 8)
    rng = random.Random(2)
    own = {f"l{i:03d}": [chr(0x4E00 + 150 * i + k) for k in range(150)] for i in range(70)}
    rows = [(lang, "".join(rng.choices(chars, k=20 if i % 3 else 600))) for i, (lang, chars) in enumerate(own.items())]
    filters = language_id.train(spark.createDataFrame(rows, "lang string, text string").crossJoin(spark.range(3)))
    assert sorted(n for held in filters.numbers for n in held) == list(range(70)) and len({len(s) for s in filters.slots}) > 1
    got = language_id.predict(spark.createDataFrame(rows, "doc_id string, text string"), filters).select("doc_id", F.col("lang_pred")).collect()
    assert [r for r in got if r.doc_id != r.lang_pred] == []
