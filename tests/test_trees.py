"""Boosted trees: splits by hand, missing values, a plain version that tries all splits, folds that don't leak."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.functions import trees
from hitlake.operators import boosting


def auc(p, y):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        rank[p == v] = rank[p == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def plain_split(bins, g, h):
    """(gain, feature, bin, missing to the left) by trying everything row by row."""
    best = (0.0, 0, 0, False)
    score = lambda m: g[m].sum() ** 2 / h[m].sum()
    for j in range(bins.shape[1]):
        for b in range(1, bins.max()):
            for missing in (False, True):
                left = (bins[:, j] <= b) & ((bins[:, j] > 0) | missing)
                if min(left.sum(), (~left).sum()) >= trees.ROWS:
                    gain = score(left) + score(~left) - g.sum() ** 2 / h.sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, j, b, missing)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_split_against_trying_all(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 9, (300, 3)).astype(np.uint8)
    g, h = rng.normal(size=300) + (bins[:, 1] > 4), rng.random(300) + 0.1
    gain, j, b, missing = trees._best_split(trees._histogram(bins, np.arange(300), g, h, 9))
    want = plain_split(bins, g, h)
    assert gain == pytest.approx(want[0]) and (j, b, missing) == want[1:]


def test_leaves_hold_their_rows():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 30, (2000, 4)).astype(np.uint8)
    y = ((bins[:, 0] > 12) ^ (bins[:, 2] == 0)).astype(float)
    forest = trees.boost(bins, y, 20)
    assert auc(trees.probability(forest, bins), y) > 0.999
    nodes, values = trees.grow(bins, 0.5 - y, np.full(2000, 0.25), 30)
    one = trees.Forest(0.0, *(np.array([[n[k] for n in nodes]]) for k in range(5)))
    assert np.allclose(np.log(1 / trees.probability(one, bins) - 1), -values) and sum(n[0] < 0 for n in nodes) <= trees.LEAVES
    sizes = np.unique(values, return_counts=True)[1]
    assert sizes.min() >= trees.ROWS


def test_missing_values_have_a_side_of_their_own():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 1))
    x[rng.random(1500) < 0.4] = np.nan
    y = np.where(np.isnan(x[:, 0]), 1.0, (rng.random(1500) < 0.2))
    bins = trees.binned(x, [np.linspace(-2, 2, 30)])
    assert (bins[np.isnan(x)] == 0).all() and bins[np.isfinite(x)].min() >= 1
    p = trees.probability(trees.boost(bins, y, 30), bins)
    assert p[np.isnan(x[:, 0])].min() > 0.8 and p[np.isfinite(x[:, 0])].max() < 0.6


def test_no_rounds_and_one_value():
    bins, y = np.ones((50, 2), np.uint8), np.array([0.0, 1.0] * 25)
    assert np.allclose(trees.probability(trees.boost(bins, y, 0), bins), 0.5) and np.allclose(trees.probability(trees.boost(bins, y, 3), bins), 0.5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=3000) * 0.5 > 0).astype(int)
    x[rng.random((3000, 3)) < 0.1] = np.nan
    rows = [(k, k % 3, int(y[k]), *(None if np.isnan(v) else float(v) for v in x[k])) for k in range(3000)]
    return spark.createDataFrame(rows, "id long, fold int, label int, a double, b double, c double").cache(), x, y


def test_folds_against_the_kernel_alone(spark, table):
    df, x, y = table
    models = boosting.fit(df, ["a", "b", "c"], 3, [0, 1], 40)
    assert {k: len(v) for k, v in models.items()} == {0: 2, 1: 2, 2: 2}
    got = df.withColumn("s", boosting.score(df, models, ["a", "b", "c"], F.col("fold"))).toPandas().sort_values("id")
    fold = np.arange(3000) % 3
    want = np.zeros(3000)
    for k in range(3):
        other = fold != k
        edges = [np.unique(np.nanquantile(x[:, j], np.linspace(0, 1, 254))) for j in range(3)]
        alone = trees.boost(trees.binned(x[other], edges), y[other].astype(float), 40)
        want[~other] = trees.probability(alone, trees.binned(x[~other], edges))
    a, b = auc(got.s.to_numpy(), y), auc(want, y)
    assert a > 0.8 and abs(a - b) < 0.01
    assert models[0][0].edges[0].tolist() != models[0][1].edges[0].tolist(), "seeds bin differently"


def test_a_fold_teaches_its_own_models_nothing(spark, table):
    df, _, _ = table
    turned = df.withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    one, two = (boosting.fit(d, ["a", "b", "c"], 3, [0], 10) for d in (df, turned))
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert np.array_equal(one[0][0].probability(x), two[0][0].probability(x)) and not np.array_equal(one[1][0].probability(x), two[1][0].probability(x))


def test_mean_of_all_models_without_a_fold(spark, table):
    df, _, _ = table
    models = boosting.fit(df, ["a", "b"], 3, [0], 5)
    got = df.where("id < 40").select("a", "b", boosting.score(df, models, ["a", "b"], F.lit(None).cast("int")).alias("s")).collect()
    x = np.array([[np.nan if v is None else v for v in (r.a, r.b)] for r in got])
    assert np.allclose([r.s for r in got], np.mean([models[k][0].probability(x) for k in range(3)], axis=0))


def test_equal_rows_count_as_often_as_they_stand():
    rng = np.random.default_rng(8)
    bins = np.asfortranarray(rng.integers(0, 12, (3000, 2)).astype(np.uint8))
    y = (rng.random(3000) < bins[:, 0] / 12).astype(float)
    rows, first, times = np.unique(np.column_stack([bins, y]), axis=0, return_index=True, return_counts=True)
    assert len(rows) < 300
    one, all_ = trees.boost(np.asfortranarray(bins[first]), y[first], 20, times=times.astype(float)), trees.boost(bins, y, 20)
    assert trees.probability(one, bins) == pytest.approx(trees.probability(all_, bins), abs=1e-9)


def test_growing_by_asking_makes_the_same_tree():
    rng = np.random.default_rng(9)
    bins = np.asfortranarray(rng.integers(0, 40, (4000, 3)).astype(np.uint8))
    g, h = rng.normal(size=4000) + (bins[:, 1] > 20) * (bins[:, 0] < 9), rng.random(4000) + 0.1
    want, _ = trees.grow(bins, g, h, 256)
    own, asked = trees.Growing(), 0
    while nodes := own.asks():
        asked, at = asked + 1, trees.parts(own.nodes, bins)
        own.known |= {k: trees.measured(trees._histogram(bins, at[k], g, h, 256)) for k in nodes}
    got = own.tree()
    assert [n[:4] for n in got] == [n[:4] for n in want] and np.allclose([n[4] for n in got], [n[4] for n in want]) and asked < 25


def test_every_row_teaches_however_many_they_are(spark, table, monkeypatch):
    """3000 different rows where a task takes 500: the forests are those of all rows, not of some."""
    df, _, _ = table
    monkeypatch.setattr(boosting, "STORED", 2)
    want, got = (boosting.fit(d, ["a", "b", "c"], 3, [0], 5, most) for d, most in ((df, 10_000), (df.repartition(7), 500)))
    x = np.random.default_rng(2).normal(size=(500, 3))
    assert {k: len(v) for k, v in got.items()} == {0: 1, 1: 1, 2: 1}
    for k in range(3):
        off = np.abs(got[k][0].probability(x) - want[k][0].probability(x))
        assert np.mean(off > 1e-6) < 0.02 and off.mean() < 1e-3, "but for splits of equal gain"


def test_edges_are_exact_quantiles(spark):
    df = spark.range(40_000).selectExpr("double(id) as x0")
    (edges,) = boosting._edges(df, ["x0"], [0])[0]
    at = 39_999 * (np.arange(boosting.EDGES) + np.random.default_rng(0).random()) / boosting.EDGES
    assert edges == pytest.approx((at[:-1] + at[1:]) / 2)
