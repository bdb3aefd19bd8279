import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.functions import hdbscan, ward
from hitlake.functions import masks as M
from hitlake.operators import clusters as C
from hitlake.operators import quality as Q
from hitlake.operators import scoring as S
from hitlake.plans import clusters as plans


def blobs(k=3, n=120, spread=0.3, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([c * 8 + rng.normal(size=(n, 3)) * spread for c in np.eye(3)[:k]])


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_hdbscan_finds_blobs(selection):
    got = hdbscan.labels(blobs(), 60, 8, selection)
    assert all(len(set(got[k * 120 : k * 120 + 120].tolist()) - {-1}) == 1 for k in range(3)) and got.max() == 2
    assert (hdbscan.labels(np.zeros((3, 2)), 4, 8) == -1).all()
    assert len(hdbscan.labels(np.zeros((40, 2)), 4, 8)) == 40
    with pytest.raises(MemoryError):
        hdbscan.labels(np.zeros((hdbscan.MOST + 1, 1)))


def test_core_distances_keep_no_table(monkeypatch):
    monkeypatch.setattr(hdbscan, "BLOCK", 1 << 16)
    x = np.random.default_rng(2).normal(size=(2000, 3))
    tracemalloc.start()
    got = hdbscan.core_distances(x, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6, "a table of all distances has 32 MB"
    assert got == pytest.approx(np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 7])


def test_tree_is_the_same_from_a_table_and_row_by_row(monkeypatch):
    x = np.round(np.random.default_rng(3).normal(size=(400, 3)), 1)  # many ties
    want = hdbscan.spanning_tree(x, 8)
    monkeypatch.setattr(hdbscan, "NEAR", 1000)
    assert (hdbscan.spanning_tree(x, 8) == want).all()
    monkeypatch.setattr(hdbscan, "BLOCK", 1 << 17)
    assert (hdbscan.spanning_tree(x, 8) == want).all() and len(want) == 399


def test_hits_are_derived_once_before_scaling(spark, monkeypatch):
    read = []
    scale = plans.T.scale
    monkeypatch.setattr(plans.T, "scale", lambda df, columns: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or scale(df, columns))
    monkeypatch.setattr(plans.C, "cluster_epochs", lambda df, columns, **options: (df, []))
    plans.found(spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and "props" not in read[0], "each pass of the scaling would take the events apart again"


def test_ward_heights_match_the_definition():
    x = np.random.default_rng(1).normal(size=(12, 3))
    z = ward.linkage(x)
    groups, heights = [[k] for k in range(12)], []
    while len(groups) > 1:
        cost = lambda a, b: (2 * len(a) * len(b) / (len(a) + len(b))) ** 0.5 * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        d, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        heights.append(d)
        groups[j] = groups[j] + groups.pop(i)
    assert z[:, 2] == pytest.approx(heights)
    assert z[-1, 3] == 12
    for k in (2, 5, 11):
        assert len(set(ward.cut_to(z, 12, k).tolist())) == k
        assert (ward.cut(z, 12, z[11 - k, 2]) == ward.cut_to(z, 12, k)).all()


def table(spark, x, **more):
    n = len(x)
    rows = [(k, *map(float, v), *(more[m][k] for m in more)) for k, v in enumerate(x)]
    kinds = {int: "int", float: "double", str: "string"}
    assert n
    return spark.createDataFrame(rows, "id long, a double, b double, c double" + "".join(f", {m} {kinds[type(more[m][0])]}" for m in more))


def test_epochs_are_reproducible_and_number_clusters_apart(spark):
    df = table(spark, blobs(n=200))
    a, trace = C.cluster_epochs(df, ["a", "b", "c"], batch=150, min_cluster_size=10, epochs=3)
    rows = {r.id: r.cluster for r in a.collect()}
    assert rows == {r.id: r.cluster for r in C.cluster_epochs(df.repartition(5), ["a", "b", "c"], batch=150, min_cluster_size=10, epochs=3)[0].collect()}
    assert len(rows) == 600 and all(x >= y for x, y in zip(trace, trace[1:]))
    pure = {}
    for k, v in rows.items():
        if v >= 0:
            pure.setdefault(v, set()).add(k // 200)
    assert len(pure) >= 3 and all(len(s) == 1 for s in pure.values())
    families, info = C.match(df.join(a, "id"), ["a", "b", "c"], n_families=3)
    of = {}
    for r in families.where("family >= 0").collect():
        of.setdefault(r.id // 200, set()).add(r.family)
    assert all(len(s) == 1 for s in of.values()) and info["cut_source"] == "n_families" and info["n_families"] == 3


def test_rows_that_are_not_finite_are_skipped(spark):
    x = blobs(n=40)
    x[0, 0] = np.nan
    got = {r.id: r.cluster for r in C.cluster_epochs(table(spark, x), ["a", "b", "c"], min_cluster_size=10)[0].collect()}
    assert got[0] == C.SKIPPED and len(got) == 120
    few = C.cluster_epochs(table(spark, x[1:4]), ["a", "b", "c"])[0].collect()
    assert {r.cluster for r in few} == {C.NOISE}


def test_match_without_or_with_one_cluster(spark):
    df = table(spark, blobs(n=3), cluster=[-1] * 9)
    got, info = C.match(df, ["a", "b", "c"])
    assert {r.family for r in got.collect()} == {-1} and info["n_families"] == 0
    got, info = C.match(df.withColumn("cluster", F.lit(4)), ["a", "b", "c"])
    assert {r.family for r in got.collect()} == {0} and info["cut_source"] == "too few clusters"
    with pytest.raises(ValueError, match="unknown rule"):
        C.match(table(spark, blobs(n=3), cluster=[k % 3 for k in range(9)]), ["a", "b", "c"], rule="x")


def test_plurality_ties_go_to_the_first_by_name(spark):
    rows = [(0, 900.0), (0, 930.0), (0, 1.0), (1, 2.0)]
    df = spark.createDataFrame([(f, x, 0.1, 10.0, 1, "o") for f, x in rows], "family int, frequency double, driftRate double, snr double, n_beams int, obsid string")
    got = {r.family: r for r in C.name_families(df, M.band_of(F.col("frequency"))).collect()}
    assert got[0].band == "GSM downlink" and got[0].band_frac == pytest.approx(1 / 3) and got[0].explained
    assert got[1].band is None and not got[1].explained and got[1].band_frac == 0
    assert {r.family for r in C.candidate_hits(df, C.name_families(df, M.band_of(F.col("frequency")))).collect()} == {1}


def test_adjusted_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "p int, q int")
    assert Q.adjusted_rand(df, "p", "q").first()[0] == 1.0
    assert Q.adjusted_mutual_information(df, "p", "q") == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    noise = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 4, (2000, 2))], "p int, q int")
    assert abs(Q.adjusted_rand(noise, "p", "q").first()[0]) < 0.02 and abs(Q.adjusted_mutual_information(noise, "p", "q")) < 0.02


def test_hypergeometric_tail():
    assert Q.hypergeometric_tail(0, 5, 3, 10) == pytest.approx(1)
    assert Q.hypergeometric_tail(3, 3, 3, 10) == pytest.approx(1 / 120)


def test_shuffling_keeps_the_values(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    got = Q.shuffled(df, "v", 3)
    assert sorted(r.v for r in got.collect()) == sorted(r.v for r in df.collect())
    assert {r.id for r in got.collect()} == set(range(500)) and got.join(df.withColumnRenamed("v", "w"), "id").where("v != w").count() > 300


def test_quality_of_nothing_clustered(spark):
    df = spark.createDataFrame([(k, 100.0 + k, -1) for k in range(5)], "id long, frequency double, cluster int")
    got = Q.quality(df)
    assert got["n_clusters"] == 0 and np.isnan(got["narrow_frac"])


def test_quality_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(k, 100.0 + k % 3, k % 4, k % 2) for k in range(60)], "id long, frequency double, cluster int, weak_label int").repartition(3)
    got = Q.quality(df.mapInPandas(count, df.schema))
    assert seen.value == 60 and got["n"] == 60 and got["n_clusters"] == 4


def test_stability_gives_three_numbers(spark):
    a = spark.createDataFrame([(k, k % 2) for k in range(20)], "id long, cluster int")
    b = spark.createDataFrame([(k, -1 if k < 10 else k % 2) for k in range(20)], "id long, cluster int")
    got = Q.stability([a, b])
    assert got["ari_restricted"] == 1.0 and got["noise_agreement"] == 0.5 and got["ari_composite"] < 1
    assert Q.epoch_trace([40, 10], 100)[1] == {"epoch": 2, "alive": 10, "removed": 30, "pct_of_original": 30.0}


def test_auc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert S.roc_auc(df).first()[0] is None and S.average_precision(df).first()[0] == 1.0


def test_scores_leak_nothing(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"g{k % 6}", int(k % 3 == 0) if k % 5 else -1, float(rng.normal() + 2 * (k % 3 == 0)), None if k % 11 == 0 else float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, group_id string, weak_label int, x double, z double")
    models, folds = S.fold_models(df, ["x", "z"], n_splits=3, max_iter=3)
    assert sorted(set(folds.values())) == [0, 1, 2] and len(folds) == 6
    got = S.predict_held_out(models, folds, df.withColumn("group_id", F.when(F.col("id") == 0, "new").otherwise(F.col("group_id"))), ["x", "z"])
    assert got.count() == 400 and {r.fold_used for r in got.where("id = 0").collect()} == {-1}
    scored = S.fit_score(df, ["x", "z"], n_splits=3, max_iter=3)
    assert scored.count() == 400 and S.roc_auc(scored.where("weak_label >= 0"), "weak_label", "rfi_score").first()[0] > 0.8
    with pytest.raises(ValueError, match="gives the label away"):
        S.fold_models(df, ["n_beams_n"])
    with pytest.raises(ValueError, match="both classes"):
        S.fold_models(df.where("weak_label = 1"), ["x"])
    with pytest.raises(ValueError, match="folds"):
        S.group_folds(df, n_splits=9)
    with pytest.raises(ValueError, match="unknown feature set"):
        S.feature_columns("other")


def test_beam_edges_part_where_labels_begin(spark):
    df = spark.createDataFrame([(b, 0.5) for b in (1, 2, 31, 32, 64)], "n_beams int, s double")
    assert [(r.low, r.high) for r in S.beam_bins(df).orderBy("bin").collect()] == [(0, 1), (1, 2), (17, 31), (31, 32), (49, 65)]
