"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from pagemill.llm.batches import apart, fold
from pagemill.session import checkpoint_folder

# A text in a known language has most of its votes there; below this share no language is settled.
LEAST_SHARE = 0.25
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` and those without a settled language go."""
    filters = language_id.train(docs.where(language_id.learnable(fold(4), 2)))
    inner, restore = apart(docs)
    judged = language_id.predict(inner, filters, keep=inner.columns)
    return restore(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in one of them; ``n_chars`` follows the text, emptied documents go."""
    shorter = line_dedup.drop_repeated(docs)
    kept = shorter.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with their number, whether they decode to the text again, and digests of both."""
    back = byte_bpe.encode(docs, *VOCABULARY, keep=["doc_id", "lang", "source"], with_decoded=True)
    return back.select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_alike),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

# The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
