"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs with one word
between (letters and digits, A-Z lower-cased), each present or not. Learning is online and keeps
two numbers a coordinate, so rates differ by coordinate; the L1 term leaves few weights that aren't
zero, and those alone go to the executors (at most 2**BITS numbers).

The classifier is fitted on a bounded sample of the labelled rows: for each label the MOST rows of
least hash, so the sample doesn't depend on partitions. One task learns from it. Scoring is a pass
over whole texts without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, as_bytes, bucketed, memo
from .words import plain_words, word_ids

BITS = 20
MOST = 6000
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct indices below 2**bits."""
    h = word_ids(plain_words(text))
    a, b, c, d = (np.uint64(m) for m in MIXERS)
    found = np.concatenate([h * a, h[:-1] * b + h[1:] * c, h[:-2] * d + h[2:] * a])
    found = (found ^ (found >> np.uint64(29))) * b
    return np.unique(found >> np.uint64(64 - bits)).astype(np.int32)


def learn(rows: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.0, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights that aren't zero, and the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        s = z[at]
        w = -(s - np.sign(s) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(s) <= l1, 0.0, w)

    for _ in range(epochs):
        for own, label in zip(rows, labels, strict=True):
            at = np.append(own, last)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(last + 1))
    at = np.flatnonzero(w[:last])
    return at.astype(np.int32), w[at], float(w[last])


def sample(labels: DataFrame, seed: int, most: int = MOST) -> DataFrame:
    """labels: (doc_id, label 0 or 1). For each label the `most` rows of least hash; one row an id, 1 where they differ."""
    own = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.withColumn("at", bucketed([F.col("doc_id")], seed))
    return own.where("label = 0").orderBy("at", "doc_id").limit(most).union(own.where("label = 1").orderBy("at", "doc_id").limit(most))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """docs: (doc_id, text); labels: (doc_id, label). Without rows of both labels the model is a constant: 0.5 after toxic rows alone, else near 0.

    Of rows that share an id the least text by code points is learned, so that 2 * most rows is a bound.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        return {"at": batch.column("at"), "label": batch.column("label"), "own": [features(x, bits) for x in as_bytes(batch, "text")]}

    def train(batches):
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts).sort_values(["at", "label"]) if parts else pd.DataFrame({"own": [], "label": []})
        if rows.label.nunique() < 2:
            # Toxic rows alone say nothing about what is clean: a half, which no threshold above it rejects.
            at, w, bias = np.zeros(0, np.int32), np.zeros(0), 0.0 if len(rows) and rows.label.iloc[0] else -4.0
        else:
            at, w, bias = learn(list(rows.own), rows.label.tolist(), bits)
        yield pd.DataFrame({"at": [at], "w": [w], "bias": [bias]})

    few = F.broadcast(sample(labels, seed, most))  # 2 * most rows at most
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").groupBy("doc_id").agg(F.min("at").alias("at"), F.min("label").alias("label"), F.min("text").alias("text"))
    rows = arrow_map(own.select("at", "label", "text"), cut, "at double, label int, own array<int>")
    model = rows.repartition(1).mapInPandas(train, "at array<int>, w array<double>, bias double").first()
    return np.array(model.at, np.int32), np.array(model.w, np.float64), float(model.bias)


_dense = memo()


def _table(at: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    key = hashlib.sha256(at.tobytes() + w.tobytes()).digest()
    if key not in _dense:
        _dense.clear()
        _dense[key] = np.zeros(1 << bits)
        _dense[key][at] = w
    return _dense[key]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """docs: doc_id, text and others. (doc_id, score): 0 to 1 for each row's whole text; null and empty texts get the bias alone."""
    at, w, bias = model

    def kernel(batch: pa.RecordBatch) -> dict:
        table = _table(at, w, bits)
        total = [bias + float(table[features(x, bits)].sum()) for x in as_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "score": (1 / (1 + np.exp(-np.clip(total, -35, 35)))).tolist()}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, score double")


def filtered(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    at, w, bias = model

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(at, w, bits)
        total = np.array([bias + float(table[features(x, bits)].sum()) for x in as_bytes(batch, "text")])
        return batch.filter(pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))) < threshold))

    return arrow_rows(docs, kernel)
