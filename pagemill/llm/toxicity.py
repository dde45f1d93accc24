"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams it contains. The ratio of a feature's rates in the two classes,
as a logarithm, is its scale; a logistic regression with an L2 penalty is fitted on the scaled features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import code_points, map_texts, slices, texts

ORDERS = (4, 6, 8, 10)
BITS = 20
# Features the regression weighs: those whose class rates differ most surely.
FEATURES = 20_000
# Labelled documents of each class, about, that the fit uses.
SAMPLE = 4_000
THRESHOLD = 0.3


def hashed(values: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the hash of the n-gram at each place of the joined texts; and where each text starts.

    Case does not count, white space does. An n-gram's code is built from those of its two parts.
    """
    points, starts = code_points([v.lower() for v in values])
    base = 0x9E3779B97F4A7C15
    codes = {1: points.astype(np.uint64)}

    def join(a: int, b: int) -> None:
        n = max(0, len(points) - a - b + 1)
        codes[a + b] = codes[a][:n] * np.uint64(pow(base, b, 1 << 64)) + codes[b][a : a + n]

    join(1, 1), join(2, 2), join(4, 2), join(4, 4), join(8, 2)
    out = []
    for order in ORDERS:
        spread = np.uint64((0xD6E8FEB86659FD93 + 2 * order) % (1 << 64))
        code = codes[order]
        out.append((((code ^ (code >> np.uint64(29))) * spread) >> np.uint64(64 - BITS)).astype(np.int32))
    return out, starts


def features(values: list[str]) -> list[np.ndarray]:
    """The features of each text, each once."""
    found, starts = hashed(values)
    seen = np.zeros(1 << BITS, dtype=np.int32)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = np.concatenate([h[a : max(a, b - order + 1)] for h, order in zip(found, ORDERS, strict=True)])
        at = np.arange(len(own), dtype=np.int32)
        seen[own] = at  # the last place of each feature stays
        out.append(own[seen[own] == at])
    return out


@dataclass
class Model:
    weights: np.ndarray  # one for each feature, log-count ratio included; most are 0
    bias: float

    def scores(self, values: list[str]) -> np.ndarray:
        used = self.weights != 0
        found, starts = hashed(values)
        held = []
        for own, order in zip(found, ORDERS, strict=True):
            at = np.flatnonzero(used[own])
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + order <= starts[text + 1]
            held.append((text[inside] << BITS) | own[at[inside]])
        pairs = np.unique(np.concatenate(held))
        z = np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=len(values)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each class have each feature, and how many texts there are."""

    def run(batches):
        counts, n = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
        for part in slices(batches):
            for label, own in zip(part.column(1).to_pylist(), features(texts(part)), strict=True):
                counts[label][own] += 1
                n[label] += 1
        if sum(n):
            at = np.flatnonzero(counts.sum(axis=0))
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["feature", "n0", "n1"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n[0]]), pa.array([n[1]])], names=["feature", "n0", "n1"])

    rows = sample.mapInArrow(run, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = rows.toArrow()  # at most 2^BITS rows
    feature, found = table["feature"].to_numpy(), np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()]).astype(float)
    counts, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    counts[:, feature[feature >= 0]] = found[:, feature >= 0]
    if (feature < 0).any():
        n = found[:, feature < 0][:, 0]
    return counts, n


def train(sample: DataFrame) -> Model:
    """Fit on (text, label) rows; their number must be bounded by the caller.

    Without rows of both classes the model gives every text the share of label 1, or a half.
    """
    from ..session import stored

    sample = stored(sample, "toxicity-sample")
    counts, n = _class_counts(sample)
    if not n.all():
        share = n[1] / n.sum() if n.sum() else 0.5
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rates = (counts + 0.5) / (n[:, None] + 1)
    ratio = np.log(rates[1] / rates[0])
    pooled = counts.sum(axis=0) / n.sum()
    surety = np.abs(rates[1] - rates[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-9)
    surety[counts.sum(axis=0) < 3] = 0
    chosen = np.argsort(-surety, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[surety[chosen] > 2])
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))

    def reduce(batches):
        for part in slices(batches):
            rows = [place[f] for f in features(texts(part))]
            yield pa.RecordBatch.from_arrays([pa.array([r[r >= 0].tobytes() for r in rows], pa.binary()), part.column(1)], names=["features", "label"])

    # A few thousand rows of feature numbers.
    rows = sample.mapInArrow(reduce, "features binary, label int").collect()
    fitted, bias = _regression([np.frombuffer(r.features, dtype=np.int32) for r in rows], np.array([r.label for r in rows]), ratio[chosen])
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[chosen] = fitted * ratio[chosen]
    return Model(weights, bias)


def _regression(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled 0/1 features, classes weighted to the shares they have; Adam steps on all rows."""
    columns = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias = np.zeros(len(scale)), 0.0
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=(weights * scale)[columns], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        gradient = np.append(np.bincount(columns, weights=error[owner], minlength=len(scale)) * scale + penalty * weights, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on) to the kept columns (default: ``doc_id``).

    Texts are scored whole. Null and empty texts have no features and get the bias; rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(_: pa.RecordBatch, values: list[str]) -> dict:
        found = shared.value.scores(values)
        return {"score": pa.array(found), "predicted": pa.array((found >= THRESHOLD).astype(np.int32))}

    return map_texts(docs, work, "score double, predicted int", keep or ["doc_id"])
