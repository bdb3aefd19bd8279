"""Language ID by nearest centroid.

A text is the vector of its letter n-grams (1 to 3, within and across words, lower-cased), hashed to
2**BITS places, with weights (1 + ln tf) * idf, of length one. Each language has several centroids,
found by spherical k-means; a text gets the language of the centroid with the largest cosine. A
text that lies further from that centroid than the centroid's own documents did is rejected: it
keeps its nearest language in lang_pred, and rejected is true.

Document frequencies cover all learnable rows. Centroids are fitted on a bounded sample: for each
language the distinct texts with a letter of least hash, about MOST of them (MOST at most), in one
task a language. Copies of a text count once, so a hot text neither crowds out others nor fills a task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, bucketed, prepare, remainder

BITS = 12
MOST = 800
CENTROIDS = 4
ROUNDS = 8
#: Cosines of a centroid's own documents below which a text is rejected: this quantile, less the slack.
QUANTILE, SLACK = 0.005, 0.05


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and their counts; None without a letter."""
    code = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, 32).astype(np.uint32)
    code = np.concatenate([[32], code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])], [32]]).astype(np.uint32)
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = code[code != 32] * a
    two = code[:-1] * b + code[1:] * c + np.uint32(1)
    three = (code[:-2] * a + code[1:-1] * b) * c + code[2:] * a + np.uint32(2)
    h = np.concatenate([one, two, three])
    h = (h ^ (h >> np.uint32(15))) * b
    counts = np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def vectors(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which texts have a letter."""
    out, ok = np.zeros((len(texts), 1 << BITS), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if g := grams(t):
            ok[i] = True
            out[i, g[0]] = (1 + np.log(g[1])) * idf[g[0]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), ok


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of docs (text): how many texts have each place, and how many have letters."""

    def count(batches):
        found, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in as_bytes(batch, "text"):
                if g := grams(text):
                    found[g[0]] += 1
                    n += 1
        yield pa.record_batch({"at": pa.array(np.arange((1 << BITS) + 1, dtype=np.int32)), "n": pa.array(np.append(found, n))})

    prepare(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        found[r.at] = r.n
    return found[:-1], int(found[-1])


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids, and each row's cosine with its own."""
    first = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[first[0]]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def fit(docs: DataFrame, lang: str = "lang", seed: int = 5, most: int = MOST) -> dict:
    """docs: learnable rows only, with text and lang. The model: idf, languages, centroids and the cosine below which each rejects."""
    own = docs.where(F.col(lang).isNotNull()).select("text", F.col(lang).alias("lang"))
    found, n = document_frequencies(own)
    idf = np.log((1 + n) / (1 + found)) + 1
    drawn = own.where(F.col("text").rlike("\\p{L}")).withColumn("at", bucketed([F.col("text")], seed))
    counts = {r["lang"]: r["n"] for r in drawn.select("lang", "at").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"idf": idf, "langs": [], "centroids": np.zeros((0, 1 << BITS), np.float32), "least": np.zeros(0)}
    share = F.lit(0.0)
    for name, k in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, most / k))).otherwise(share)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "text"]).head(most)
        x, ok = vectors([t.encode("utf-8", "replace") for t in rows.text.fillna("")], idf)
        if not ok.any():
            return pd.DataFrame({"lang": [], "k": [], "centroid": [], "least": []})
        x = x[ok]
        c, near = k_means(x, CENTROIDS)
        best = near.argmax(1)
        least = [float(np.quantile(near[best == j, j], QUANTILE)) - SLACK if (best == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [rows.lang.iloc[0]] * len(c), "k": range(len(c)), "centroid": list(c), "least": least})

    sample = drawn.where(F.col("at") < share).dropDuplicates(["lang", "text"])
    rows = sample.groupBy("lang").applyInPandas(learn, "lang string, k int, centroid array<float>, least double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["k"]))
    return {"idf": idf, "langs": [r["lang"] for r in rows], "centroids": np.array([r["centroid"] for r in rows], np.float32).reshape(-1, 1 << BITS), "least": np.array([r["least"] for r in rows])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs: doc_id, text and others. (doc_id, lang_pred, score, rejected), from the text alone.

    lang_pred is `und` for a null text, a text without a letter, and where nothing was learned; its
    score is then 0. Ties go to the first language by name. No shuffle.
    """
    langs, weights = model["langs"], model["centroids"].T.copy()

    def kernel(batch: pa.RecordBatch) -> dict:
        pred, score, rejected = [], [], []
        texts = as_bytes(batch, "text")
        for at in range(0, len(texts), 256):
            x, ok = vectors(texts[at : at + 256], model["idf"])
            near = x @ weights if langs else np.zeros((len(x), 1))
            best = near.argmax(1)
            for i, b in enumerate(best.tolist()):
                known = bool(langs) and bool(ok[i])
                pred.append(langs[b] if known else "und")
                score.append(min(1.0, max(0.0, float(near[i, b]))) if known else 0.0)
                rejected.append(not known or bool(near[i, b] < model["least"][b]))
        return {"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score, "rejected": rejected}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(True))
