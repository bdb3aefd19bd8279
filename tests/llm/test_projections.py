import numpy as np
import pytest

from hitlake.llm import projections

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, n string"


def brute(rows):
    ok = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and y is not None]
    links, up = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, v, y) in enumerate(ok):
        for j, w, z in ok[:k]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i, *_ in rows}


def run(spark, rows):
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projections.near_duplicates(df).collect()}


def vectors(n, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        v = rng.normal(size=16)
        if k % 4 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.2])
        rows.append((k, v.tolist(), int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    monkeypatch.setattr(projections, "FEW", 20)
    rows = vectors(300)
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(v[0] for v in got.values()) > 50


def test_collisions_are_counted():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 5)), rng.normal(size=(30, 5))
    assert (projections.collisions(a, b, 0.3) == (np.abs(a[:, None] - b[None]) <= 0.3).sum(2)).all()


def test_hot_vector_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0, 0.0], 1) for k in range(100)] + [
        (200, None, 1), (201, [0.0, 0.0, 0.0], 1), (202, [1.0, None, 0.0], 1), (203, [nan, 1.0, 0.0], 1), (204, [inf, 1.0, 0.0], 1), (205, [], 1), (206, [1.0, 0.0, 0.0], None),
        (207, [1.0, 0.0], 1), (208, [5.0, 0.0, 0.0], 1), (209, [-1.0, 0.0, 0.0], 1), (210, [1.0, 0.0, 0.0], 2), (211, [1.0, 0.2, 0.0], 1),
    ]
    assert run(spark, rows) == brute(rows)


def test_components_keep_their_precision(spark):
    df = spark.createDataFrame([(1, [1e39, 0.0], 1), (2, [2e39, 1e38], 1), (3, [0.0, 1e-300], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in projections.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_null_ids_and_nothing(spark):
    got = projections.near_duplicates(spark.createDataFrame([(None, [1.0], 1, 1, "x"), (3, [1.0], 1, 1, "x")], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("3", 0, 3, True), ("None", 0, None, False)]
    assert run(spark, []) == {}
