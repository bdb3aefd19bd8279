import random

import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hitlake.llm import toxicity

CLEAN, BAD = [f"w{k}" for k in range(200)], ["vile", "nasty", "awful"]


def corpus(n, seed=0):
    random.seed(seed)
    rows = []
    for k in range(n):
        words = random.choices(CLEAN, k=random.randint(5, 60))
        if k % 4 == 0:
            words = [w for x in words for w in ([x, random.choice(BAD)] if random.random() < 0.2 else [x])] + [random.choice(BAD)]
        rows.append((k, " ".join(words)))
    return rows


def test_held_out_accuracy(spark, docs):
    df = docs(corpus(1500))
    labels = df.where("doc_id % 3 != 0").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label"))
    model = toxicity.fit(df, labels)
    got = toxicity.score(df.where("doc_id % 3 = 0"), model).collect()
    hit = np.array([(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got])
    assert hit.mean() > 0.95
    assert len(model[0]) < 2000, "L1 leaves few weights"
    kept = {r.doc_id for r in toxicity.filtered(df, model, 0.7).collect()}
    assert kept == {r.doc_id for r in toxicity.score(df, model).collect() if r.score < 0.7}


def test_order_of_partitions_plays_no_part(docs):
    df = docs(corpus(200))
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label"))
    a, b = toxicity.fit(df.repartition(1), labels), toxicity.fit(df.repartition(4), labels.repartition(3))
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_sample_is_bounded(spark):
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert toxicity.sample(labels, 1, 50).groupBy("label").count().orderBy("label").collect() == [(0, 50), (1, 50)]


def test_edges(spark, docs, edge, empty):
    df = docs(corpus(100))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(100)] + [(None, 1), (5, None), (5, 7), (8, 0), (8, 1)], "doc_id long, label int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(edge, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert toxicity.score(edge, none).first().score < 0.1
    assert set(toxicity.filtered(edge, model, 0.7).columns) == set(edge.columns)


def test_learning_matches_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 12))).astype(np.int32) for _ in range(80)]
    labels = [int(3 in r or 7 in r) for r in rows]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for row, y in zip(rows, labels):
            own = [*row.tolist(), 32]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    at, w, bias = toxicity.learn(rows, labels, 5, alpha, beta, l1, l2, 3)
    want = {i: weight(i) for i in range(32) if weight(i)}
    assert at.tolist() == sorted(want) and len(want) < 32
    assert np.allclose(w, [want[i] for i in at.tolist()]) and abs(bias - weight(32)) < 1e-12


def test_features_match_plain_grams():
    text = "You ARE, you-are vile é".encode()
    words = ["you", "are", "you", "are", "vile", "é"]
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    a, b, c, d = toxicity.MIXERS
    grams = [x * a for x in h] + [x * b + y * c for x, y in zip(h, h[1:])] + [x * d + y * a for x, y in zip(h, h[2:])]
    mask = (1 << 64) - 1
    want = sorted({((g & mask ^ (g & mask) >> 29) * b & mask) >> 64 - toxicity.BITS for g in grams})
    assert toxicity.features(text).tolist() == want


def test_repeated_learnable_rows_are_one(docs):
    rows = [(k, ("vile " if k % 2 else "kind ") + f"w{k}") for k in range(40)]
    labels = docs(rows).selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    once = toxicity.fit(docs(rows), labels, bits=12)
    more = toxicity.fit(docs(rows + rows[:9] * 3 + [(5, "vile zzz")]), labels.union(labels), bits=12)
    assert all(np.array_equal(x, y) for x, y in zip(once[:2], more[:2])) and once[2] == more[2]
