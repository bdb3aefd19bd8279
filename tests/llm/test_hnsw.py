import numpy as np

from hitlake.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, h int, shard string"


def brute(rows, asked, top):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            near = sorted((-(ok[q] * w).sum(), i) for i, w in ok.items() if i != q and len(w) == len(ok[q]))[:top]
            out[q] = [(i, -s) for s, i in near]
    return out


def run(spark, rows, every, top=20):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    got: dict = {}
    for r in sorted(hnsw.nearest(df, df.where(f"vec_id % {every} = 0"), top).collect(), key=lambda r: (r.query_id, r.rank)):
        own = got.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return got


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 700)
    monkeypatch.setattr(hnsw, "BLOCK", 20)
    x = np.random.default_rng(0).normal(size=(2000, 24)) * np.random.default_rng(1).uniform(0.5, 2, (2000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, want = run(spark, rows, 40), brute(rows, range(0, 2000, 40), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    scores = {(q, i): s for q, v in brute(rows, range(0, 2000, 40), 2000).items() for i, s in v}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v)
    assert all([s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())


def test_graph_layers():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    layers = hnsw.build(x, np.random.default_rng(1).random(500))
    assert len(layers[-1][0]) == 500 and len(layers) > 1
    assert all(t.shape == (len(n), hnsw.WIDTH) and set(t[t >= 0].tolist()) <= set(n.tolist()) for n, t in layers)


def test_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1, 24)) * 3 + rng.normal(size=(900, 24)) * 0.02, rng.normal(size=(600, 24))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, want = run(spark, rows, 50), brute(rows, range(0, 1500, 50), 20)
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert min(found) >= 0.8 and np.mean(found) >= 0.97


def test_components_keep_their_precision(spark):
    rows = [(k, [1e39 * (1 + k * 1e-12), 1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in hnsw.nearest(df, df.where("vec_id = 0"), 5).collect()]
    assert sorted(got, key=lambda r: -r[1]) == [(k, rows[0][1][0] * rows[k][1][0] + 1.0) for k in (39, 38, 37, 36, 35)]


def test_ties_copies_and_few_candidates(spark):
    rows = [(k, [1.0, 0.0]) for k in range(50)] + [(60, [0.5, 0.5]), (61, [-1.0, 0.0])]
    assert run(spark, rows, 20) == brute(rows, [0, 20, 40, 60], 20)
    few = rows[:5]
    assert run(spark, few, 20) == brute(few, [0], 20)
    assert run(spark, [(0, [1.0])], 20) == {}


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, None]), (100, []), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0]), (120, [3.0]), (1, [2.0, 1.0])]
    assert run(spark, rows, 20) == brute(rows, [0, 20, 40, 60, 80, 100, 120], 20)
    assert run(spark, [], 20) == {}
