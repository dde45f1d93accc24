"""Quality: attention-based multiple-instance learning over the passages of a document.

Every passage of the whole text is encoded; a gated attention, learned from document labels alone, weighs
the passages; the weighted sum of the encodings is scored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import code_points, map_texts, slices, texts

PASSAGE = 512  # code points
BINS = 512  # hashed character pairs
HIDDEN = 32
ATTENTION = 16
# Labelled documents of each class, about, that the fit uses; it runs in one task.
SAMPLE = 2_000
STEPS = 120
THRESHOLD = 0.3

_SHAPES = 6


def passages(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, in order, and where each text's passages start (one entry more at the end).

    An empty text is one empty passage. The features are shares of hashed character pairs, of kinds of
    characters, of different pairs, and how full the passage is.
    """
    points, starts = code_points(values)
    sizes = np.diff(starts)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(values)), sizes)
    own = first[owner] + (np.arange(len(points)) - starts[owner]) // PASSAGE
    n = int(first[-1])
    length = np.maximum(1, np.bincount(own, minlength=n)).astype(np.float32)
    same = own[1:] == own[:-1] if len(own) else np.zeros(0, bool)
    pair = ((points[:-1] * np.uint32(0x9E3779B1) + points[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 9) if len(points) else points
    bins = np.bincount(own[1:][same] * BINS + pair[same], minlength=n * BINS).reshape(n, BINS).astype(np.float32)
    kinds = [
        (points >= 97) & (points <= 122), (points >= 65) & (points <= 90), (points >= 48) & (points <= 57),
        (points == 32) | ((points >= 9) & (points <= 13)), points >= 128,
    ]
    shares = [np.bincount(own[k], minlength=n) / length for k in kinds]
    shape = np.stack([*shares, (bins > 0).sum(axis=1) / length], axis=1).astype(np.float32)
    full = (length / PASSAGE)[:, None]
    return np.concatenate([np.sqrt(bins / length[:, None]), shape, full], axis=1).astype(np.float32), first


@dataclass
class Model:
    """Weights by name; see ``forward``."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        out: dict[str, np.ndarray] = {"hidden": np.tanh(x @ w["encode"] + w["shift"])}
        out["tanh"] = np.tanh(out["hidden"] @ w["value"])
        out["gate"] = 1 / (1 + np.exp(-out["hidden"] @ w["gate"]))
        raw = (out["tanh"] * out["gate"]) @ w["weigh"]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        raw = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[owner])
        out["attention"] = raw / np.add.reduceat(raw, first[:-1])[owner]
        out["pooled"] = np.add.reduceat(out["attention"][:, None] * out["hidden"], first[:-1], axis=0)
        out["score"] = 1 / (1 + np.exp(-np.clip(out["pooled"] @ w["out"] + w["bias"][0], -30, 30)))
        return out

    def scores(self, values: list[str]) -> np.ndarray:
        return self.forward(*passages(values))["score"].astype(np.float64)


def _start() -> dict[str, np.ndarray]:
    random = np.random.default_rng(7)
    shapes = {"encode": (BINS + _SHAPES + 1, HIDDEN), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "weigh": (ATTENTION,), "out": (HIDDEN,)}
    made = {n: (random.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for n, s in shapes.items()}
    return made | {"shift": np.zeros(HIDDEN, np.float32), "bias": np.zeros(1, np.float32)}


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss, by the chain rule through score, pooling, attention and encoding."""
    f = Model(w).forward(x, first)
    owner = np.repeat(np.arange(len(labels)), np.diff(first))
    error = ((f["score"] - labels) * weight).astype(np.float32)
    pooled = error[:, None] * w["out"]
    along = (pooled[owner] * f["hidden"]).sum(axis=1)
    mean = np.add.reduceat(f["attention"] * along, first[:-1])
    raw = f["attention"] * (along - mean[owner])
    both = raw[:, None] * w["weigh"]
    value = both * f["gate"] * (1 - f["tanh"] ** 2)
    gate = both * f["tanh"] * f["gate"] * (1 - f["gate"])
    hidden = f["attention"][:, None] * pooled[owner] + value @ w["value"].T + gate @ w["gate"].T
    encoded = hidden * (1 - f["hidden"] ** 2)
    return {
        "out": f["pooled"].T @ error, "bias": error.sum(keepdims=True), "weigh": (f["tanh"] * f["gate"]).T @ raw,
        "value": f["hidden"].T @ value, "gate": f["hidden"].T @ gate, "encode": x.T @ encoded, "shift": encoded.sum(axis=0),
    }


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Adam on all rows at once; both classes weigh as many rows as they have."""
    w = _start()
    weight = np.full(len(labels), 1 / len(labels), dtype=np.float32)
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in w.items()}
    for step in range(1, steps + 1):
        for name, g in _gradients(w, x, first, labels, weight).items():
            g = g + 1e-5 * w[name]
            a, b = moments[name]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w[name] = w[name] - 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return Model(w)


def _constant(share: float) -> Model:
    odds = np.log((share + 1e-6) / (1 - share + 1e-6))
    return Model({n: 0 * v for n, v in _start().items()} | {"bias": np.array([odds])})


def train(sample: DataFrame) -> Model:
    """Fit on (text, label) rows in one task; their number must be bounded by the caller.

    Without rows of both classes the model gives every text the share of label 1, or a half.
    """

    def run(batches):
        held, sizes, labels = [], [], []
        for part in slices(batches):
            x, first = passages(texts(part))
            held.append(x)
            sizes.append(np.diff(first))
            labels += part.column(1).to_pylist()
        y = np.array(labels, dtype=np.float32)
        if 0 < y.sum() < len(y):
            model = fit(np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), y)
        else:
            model = _constant(float(y.mean()) if len(y) else 0.5)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.weights)], pa.binary())], names=["weights"])

    fitted = sample.select("text", "label").repartition(1).mapInArrow(run, "weights binary").first()
    return _constant(0.5) if fitted is None else Model(pickle.loads(fitted.weights))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on) to the kept columns (default: ``doc_id``).

    Texts are scored whole. Null and empty texts are one empty passage; rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(_: pa.RecordBatch, values: list[str]) -> dict:
        found = shared.value.scores(values)
        return {"score": pa.array(found), "predicted": pa.array((found >= THRESHOLD).astype(np.int32))}

    return map_texts(docs, work, "score double, predicted int", keep or ["doc_id"])
