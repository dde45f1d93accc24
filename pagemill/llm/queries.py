"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, chat_format, collocations, decontaminate, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, ranked_search, secrets,
    suffix_dedup, toxicity,
)
from .batches import fold
from .samples import labelled_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back: counts and digests of both."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(_table(spark, sf_dir, "documents"), *vocabulary)
    return byte_bpe.decode(ids, vocabulary[0]).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against every window of every benchmark item."""
    found = decontaminate.longest_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


ORACLES["op8_decontaminate"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
test AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM test) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM place JOIN test USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from those whose fold is not held out. Null ids are held out."""
    docs = _table(spark, sf_dir, "documents")
    seen = language_id.learnable(fold(4), 2)
    filters = language_id.train(docs.where(seen))
    return language_id.predict(docs, filters).select("doc_id", (~seen).alias("held_out"), "lang_pred", "score")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, learned from labels whose fold is not held out. Null ids are held out."""
    docs = _table(spark, sf_dir, "documents")
    seen = language_id.learnable(fold(4), 2)
    sample = labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", seen, toxicity.SAMPLE)
    return toxicity.score(docs, toxicity.train(sample)).select("doc_id", (~seen).alias("held_out"), "score", "predicted")


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts, learned from labels whose fold is not held out. Null ids are held out."""
    docs = _table(spark, sf_dir, "documents")
    seen = language_id.learnable(fold(5), 0)
    sample = labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", seen, quality_classifier.SAMPLE)
    return quality_classifier.score(docs, quality_classifier.train(sample)).select("doc_id", (~seen).alias("held_out"), "score", "predicted")


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all texts, native expressions only."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


ORACLES["op2_quality_rules"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM doc),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, s)) GROUP BY r),
stop AS (SELECT r, count(*) AS n_stop FROM (SELECT r, unnest(w) AS x FROM doc) WHERE x IN (@STOP@) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop_words
  FROM doc LEFT JOIN lines USING (r) LEFT JOIN rep USING (r) LEFT JOIN stop USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20 AND n_symbols / greatest(n_words, 1) <= 0.2
    AND (n_stop_words + 1) / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM m
""".replace("@STOP@", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS))


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines removed from all texts but the last that holds them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, i, lines[i] AS l, translate(trim(lines[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
dup AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
mark AS (SELECT doc_id, i, l, dup.k IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN dup USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM mark GROUP BY doc_id
"""


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@_query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all texts: fixed patterns, and tokens that look random. Native expressions only."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["place"] < len(secrets.BASE))
    counts = [F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles share 85 per cent of their union."""
    return jaccard_join.alike_groups(_table(spark, sf_dir, "documents"), size=4, percent=85)


ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM doc UNION SELECT d, b FROM reach JOIN link ON r = a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM doc LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS c FROM reach GROUP BY d) USING (doc_id)
"""


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under 400-byte strings that occur twice removed from all texts."""
    found = suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents"))
    n_spans = F.coalesce(F.size("spans"), F.lit(0))
    return found.select("doc_id", "n_bytes", "n_removed", F.greatest(n_spans, F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


CONTROL = r"\### Assistant: </turn> ok"


@_query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted, encoded with a loss mask and read back."""
    import public_tokenizers

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_format.read_back(rows.union(more), *vocabulary)


ORACLES["op11_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
shown AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') AS r,
    replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace(r, ':', '\:')) + 2 + length(t) + 9) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@_query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op12_ranked_search"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
doc AS MATERIALIZED (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM doc),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
posting AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM posting, total GROUP BY term),
scored AS (
  SELECT item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nt)))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to four words."""
    return collocations.collocations(_table(spark, sf_dir, "documents")).drop("first_doc", "first_at")


ORACLES["op13_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece) WHERE len(w) > 0),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
gram AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)) c
  JOIN gram l ON l.lang = c.lang AND l.phrase = c.lp JOIN gram r ON r.lang = c.lang AND r.phrase = c.rp),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) AS s(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
