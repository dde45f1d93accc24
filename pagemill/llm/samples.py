"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """(text, label) of about ``most`` documents of each class at most, over whole texts.

    A class with more labelled rows is thinned by a hash of its ids, at a rate taken from its count. Ids
    labelled twice count once (label 1 wins); null labels, null ids and rows not ``allowed`` are left
    out. Only the sample's ids, bounded by ``most``, are sent to the documents; no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 20
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    rate = F.lit(0)
    for value, n in counts.items():
        rate = F.when(F.col("label") == value, min(spread, -(-most * spread // n))).otherwise(rate)
    chosen = known.where(place < rate)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
