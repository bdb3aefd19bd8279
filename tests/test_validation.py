import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.functions import hdbscan, ward
from hitlake.operators import clusters as C
from hitlake.operators import explore as E
from hitlake.operators import injection as I
from hitlake.operators import quality as Q
from hitlake.operators import scoring as S
from hitlake.operators import transforms as T
from hitlake.service import HISTORY, Bench, signature, stamp
from hitlake.sources import files


@pytest.fixture(scope="module")
def known(spark):
    """Hits of three files, one of them selected beforehand, whose label shows in feature a."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(900):
        y = int(rng.random() < 0.4)
        file = ["one", "two", "mk_sample_hits"][k % 3]
        rows.append((k, file, f"g{k % 30}", y if k % 5 else -1, float(y + rng.normal()), float(rng.normal()), 8.0 + k % 90, 0.1 * (k % 4), 700.0 + k, k // 3, [1, 8, 40][k % 3], y == 0))
    shape = "id long, file string, group_id string, weak_label int, a_n double, b_n double, snr double, driftRate double, frequency double, coarseChannel int, n_beams int, pass_all boolean"
    return spark.createDataFrame(rows, shape).cache()


def test_scores_are_of_models_that_have_not_seen_a_group(known):
    got = S.fit_score(known, ["a_n", "b_n"], n_splits=3, max_iter=3, n_seeds=2)
    rows = got.collect()
    assert len(rows) == 900 and all(0 <= r.rfi_score <= 1 for r in rows) and set(got.columns) == {*known.columns, "rfi_score"}
    models, folds = S.fold_models(known, ["a_n", "b_n"], n_splits=3, max_iter=3, n_seeds=2)
    one = {r.id: r for r in S.predict_held_out(models, folds, S.evaluation_rows(known), ["a_n", "b_n"]).collect()}
    by = {r.id: r.rfi_score for r in rows}
    assert all(abs(by[k] - r.rfi_score) < 1e-9 and r.fold_used == folds[r.group_id] for k, r in one.items()) and len(one) > 400
    assert S.roc_auc(got.where("weak_label >= 0"), "weak_label", "rfi_score").first()[0] > 0.65
    with pytest.raises(ValueError, match="gives the label away"):
        S.fold_models(known, ["n_beams_n"])


def test_report_of_a_score(known, tmp_path):
    df = known.withColumn("rfi_score", 1 / (1 + F.exp(-F.col("a_n")))).withColumn("other", F.col("b_n"))
    report = S.validate(df, sets={"a": "rfi_score", "b": "other"}, band=F.col("file"), features=["a_n"], prefiltered=("mk_sample_hits",), max_iter=2)
    rows = [r for r in df.collect() if r.weak_label >= 0]
    assert report["n_evaluated"] == sum(r.file != "mk_sample_hits" for r in rows)
    assert report["ablation"]["a"]["roc_auc"] == pytest.approx(report["roc_auc"]) and report["ablation"]["b"]["roc_auc"] < 0.6 < report["roc_auc"]
    assert report["ood"]["n"] == sum(r.file == "mk_sample_hits" for r in rows)
    assert set(report["cross_band"]) == {"one", "two"} and all(v["auc"] > 0.6 for v in report["cross_band"].values())
    assert {f["file"] for f in report["files"]} == {"one", "two"} and report["signal_level"]["n_signals"] <= report["n_evaluated"]
    path = f"{tmp_path}/report.json"
    files.write_json({"validation": report}, path)
    assert files.read_report(path)["validation"]["n_evaluated"] == report["n_evaluated"]
    (tmp_path / "bare.json").write_text(json.dumps({}))
    with pytest.raises(ValueError, match="no validation"):
        files.read_report(f"{tmp_path}/bare.json")


def test_band_holdout_needs_both_classes_elsewhere(known):
    one = known.where("file = 'one' or weak_label = 0")
    got = S.band_holdout(one, ["a_n"], F.col("file"), max_iter=2)
    assert {r.band for r in got.select("band").distinct().collect()} == {"two"}


def test_weights_by_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 1, 4]
    df = spark.createDataFrame([(k, *map(float, r), float(k % 2)) for k, r in enumerate(x)], "id long, a double, b double, c double, flag double")
    columns, kinds = ["a", "b", "c", "flag"], {"flag": "boolean"}
    closed, info = T.weights_and_trace(df, columns, kinds)
    assert info["dev_trace"] == [] and info["skipped"] == ["flag"] and closed["flag"] == 1.0 and closed["c"] < closed["a"] / 3
    hybrid, info = T.weights_and_trace(df, columns, kinds, strategy="hybrid", iters=2, k=5)
    assert len(info["dev_trace"]) == 2 and hybrid["flag"] == 1.0
    knn, info = T.weights_and_trace(df, columns, kinds, strategy="knn", iters=3, cap=2.0, k=5)
    assert all(0.5 <= w <= 2.0 for w in knn.values()) and knn["c"] < knn["a"]
    wild, info = T.weights_and_trace(df.withColumn("d", F.col("a") / 1000), ["a", "c", "d"], {})
    assert info["spread_warning"] and max(wild.values()) <= 5.0
    with pytest.raises(ValueError):
        T.weights_and_trace(df, columns, kinds, strategy="x")


def test_audit_of_equalised_columns(spark):
    rows = [(k, float(k % 100), 0.0 if k % 4 else float(k % 50), 50.0 if k % 40 == 0 else float(k % 7), float(k % 2)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, even double, tied double, wild double, flag double")
    got = {r.feature: r for r in Q.column_audit(df, ["even", "tied", "wild", "flag"], {"flag": "boolean"}, "robust-equalised").collect()}
    assert got["flag"].weight == 1.0 and "tie" not in got["flag"].flags.split(",")
    assert got["tied"].tie_value == 0.0 and got["tied"].tie_frac >= 0.75 and "tie" in got["tied"].flags.split(",")
    assert got["wild"].clip_frac == pytest.approx(10 / 400) and "clip" in got["wild"].flags.split(",")
    assert sum(r.share_knn for r in got.values()) == pytest.approx(1) and sum(r.share_global for r in got.values()) == pytest.approx(1)
    assert all(r.clip_frac == 0 for r in Q.column_audit(df, ["wild"], {}, "none").collect())


def test_thinned_curves_stay_close(spark, monkeypatch):
    df = spark.createDataFrame([(k, "f", float(k)) for k in range(3000)], "id long, file string, x double")
    known = T.normalise(df, {"x": "unit"})[0]
    assert len(T.curves(known, ["x"], grid=100)["f", "x"][0]) < 200
    new = df.withColumn("x", F.col("x") * 1.01 - 5)
    exact = {r.id: r for r in T.normalise_like(known, new, ["x"]).collect()}
    monkeypatch.setattr(T, "GRID", 100)
    assert all(abs(exact[k].x_n - min(1, max(0, (1.01 * k - 5) / 2999))) < 1e-9 for k in exact)
    assert sum(r.out_of_range for r in exact.values()) == sum(not 0 <= 1.01 * k - 5 <= 2999 for k in range(3000))
    with pytest.raises(ValueError, match="no reference rows"):
        T.normalise_like(known, new.withColumn("file", F.lit("g")), ["x"])


def test_run_of_injections(spark):
    rng = np.random.default_rng(2)
    raw = ["f04_spectral_skew", "x02_time_occupancy"]
    cubes = [(k, f"f{k % 2}", f"g{k % 9}", 6.0 + k % 3, [1, 10, 50][k % 3], 24, int(k % 3 == 2), None if k == 4 else rng.gamma(15, size=(14, 24)).tolist()) for k in range(180)]
    df = spark.createDataFrame(cubes, "id long, file string, group_id string, snr double, n_beams int, numChannels int, weak_label int, img array<array<double>>").cache()
    from hitlake.functions.registry import with_cutout_features

    table = T.normalise(with_cutout_features(df.where("img is not null"), 24, 1.5).drop("img"), {c: "unit" for c in raw})[0].cache()
    models, folds = S.fold_models(table, [f"{c}_n" for c in raw], n_splits=3, max_iter=2)
    got = I.run(df, table, models, folds, raw, steps=14, channels=24, df_hz=1.5, dt_s=18.0, n_per_class=5, snrs=(5, 50), drifts=(0.0, 0.1)).cache()
    rows = got.collect()
    assert len(rows) == 3 * 5 * 5 and {r.substrate_class for r in rows} == {"single", "mid", "multibeam"} and 4 not in {r.id for r in rows}
    for r in rows:
        assert r.stored_score is not None and r.fold_used == folds[r.group_id]
        if r.kind == "control":
            assert r.amplitude == 0 and abs(r.rfi_score - r.stored_score) < 1e-6, "an untouched cutout scores as it is stored"
    assert len(I.report(got)) == 15
    few = I.injected_vs_real(got.where("kind = 'injected'"), table, [f"{c}_n" for c in raw], min_n=1000)
    assert few["n_injected"] == 60 and few["auc"] != few["auc"]
    told = I.injected_vs_real(got.where("inj_snr = 50").withColumn("dedoppler_snr", F.lit(7.0)), table, [f"{c}_n" for c in raw], min_n=10, max_iter=3)
    assert 0 <= told["auc"] <= 1 and told["n_real"] > 100
    with pytest.raises(ValueError, match="several rows"):
        I.run(df, table.union(table), models, folds, raw, steps=14, channels=24, df_hz=1.5, dt_s=18.0)


def test_selections_and_names(spark):
    df = spark.createDataFrame([(k, k, "f", float(k % 10), float(k % 3 - 1)) for k in range(30)], "id long, row long, file string, snr double, driftRate double")
    assert [r.id for r in E.selection(df, 3, "snr").collect()] == [9, 19, 29]
    assert all(r.driftRate for r in E.selection(df, 9, "nonzero-drift").collect())
    assert {r.id for r in E.selection(df, 5, "random", 1).collect()} == {r.id for r in E.selection(df.repartition(3), 5, "random", 1).collect()}
    rows = spark.createDataFrame([(3, "f", 1), (5, "f", 2), (7, "g", 2)], "row long, file string, family int")
    assert [r.id for r in E.chosen(df, rows, 9, "f").orderBy("id").collect()] == [3, 5]
    assert [r.id for r in E.chosen(df, rows, 9, "f", 2).collect()] == [5]
    for wrong in (lambda: E.chosen(df, rows, 9), lambda: E.chosen(df, rows, 9, "f", 5), lambda: E.chosen(df, rows.drop("row"), 9), lambda: E.selection(df, 3, "x")):
        with pytest.raises(ValueError):
            wrong()
    assert [E.stamp_tag("a", "snr"), E.stamp_tag("a", rows="/x/a_candidates.csv", family=4), E.stamp_tag("b", rows="a_candidates.csv")] == ["snr", "candidates_fam4", "a_candidates"]


def test_display_of_cutouts(spark):
    rows = [(0, [[-1.0, 2.0, 4.0], [-1.0, 6.0, -1.0]]), (1, [[-1.0, -1.0]]), (2, [[0.0, 0.0], [0.0, 5.0]])]
    df = spark.createDataFrame(rows, "id long, img array<array<double>>")
    got = {r.id: r.c for r in df.select("id", E.clean_stamp(F.col("img")).alias("c")).collect()}
    assert (got[0].img, got[0].n_valid) == ([[2.0, 4.0], [6.0, -1.0]], 2) and (got[1].img, got[1].n_valid) == ([[-1.0, -1.0]], 0)
    shown = {r.id: r.s for r in df.select("id", E.norm_stamp(F.col("img")).alias("s")).collect()}
    assert shown[2] == [[0.001, 0.001], [0.001, 1.0]]
    cutouts = df.withColumns({"file": F.lit("f"), "row": F.col("id")})
    assert stamp(cutouts, "f", 0) == [[2 / 3, 4 / 3], [2.0, 0.001]] and stamp(cutouts, "f", 9) is None


def test_bench(spark):
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in (0, 3, 6)])
    rows = [(k, float(x), float(y), k % 7 != 0, 1400.0 + k, 9.0, k % 3, 1 + k % 8, f"o{k % 4}") for k, (x, y) in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, a_n double, b_n double, feature_ok boolean, frequency double, snr double, weak_label int, n_beams int, obsid string")
    bench = Bench(spark)
    data = bench.load("x", 0, df=df, columns=["a_n", "b_n"])
    assert bench.load("x", 0) is data and data.df.count() == df.where("feature_ok").count()
    part = bench.load("x", 50, 1, df=df, columns=["a_n", "b_n"])
    assert part.df.count() == 50 and part.stats == data.stats, "scaling is fitted on all rows, then a sample is drawn"
    run = bench.cluster(data.key, mcs=10, ms=3, epochs=1, batch=500, match=True)
    assert bench.cluster(data.key, mcs=10, ms=3, epochs=1, batch=500, match=True) is run and run.stats["n_clusters"] == 3
    rows = run.summary.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [0, 1, 2] and {(r.epoch, r.batch) for r in rows} == {(1, 0)} and rows[0].n >= rows[-1].n
    assert bench.labels(run.signature).count() == data.df.count() and {r.label for r in bench.labels(run.signature, "family").collect()} <= {-1, 0, 1, 2}
    assert bench.hit(data.key, 1, run.signature)["cluster"] >= 0 and bench.values(data.key, "snr").count() == data.df.count()
    sign, points = bench.embedding(data.key)
    assert sign != bench.embedding(part.key)[0] and points.agg(F.max("x"), F.min("y")).first() == (1.0, 0.0)
    assert bench.weights(data.key, "robust-equalised")["a_n_s"] == pytest.approx(1, abs=0.2)
    single = bench.cluster(data.key, mode="single", mcs=10, ms=3, csm="leaf")
    assert [h["signature"] for h in bench.history()][0] == single.signature
    for wrong in (lambda: bench.cluster("none"), lambda: bench.hit(data.key, 10_000), lambda: bench.run("none")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        bench.cluster(data.key, ["a_n"])
    for k in range(HISTORY + 2):
        bench.runs[f"r{k}"] = run
    bench.cluster(data.key, mode="single", mcs=11, ms=3)
    assert len(bench.runs) == HISTORY
    assert signature({"a": 1, "b": 2}) == signature({"b": 2, "a": 1}) != signature({"a": 2, "b": 1})


def test_origins_and_warning(spark):
    labels = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 1, 2), (3, 1, 2, 0), (4, -1, 0, 0)], "id long, cluster long, epoch int, batch int")
    assert sorted(map(tuple, C.origins(labels).collect())) == [(0, 1, 2), (1, 2, 0)] and sorted(map(tuple, C.sizes(labels).collect())) == [(0, 2), (1, 1)]
    assert C.warning_of("robust-equalised", "eom") and not C.warning_of("robust", "eom") and not C.warning_of("robust-equalised", "leaf")


def test_kernels_by_blocks(monkeypatch):
    x = np.random.default_rng(4).normal(size=(200, 3))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(far, axis=1)[:, 4]
    monkeypatch.setattr(hdbscan, "BLOCK", 700)
    assert np.allclose(hdbscan.core_distances(x, 5), core)
    tree = hdbscan.spanning_tree(x, 5)
    reach = np.maximum(np.maximum(far, core[:, None]), core[None])
    assert np.allclose(tree[:, 2], [reach[int(a), int(b)] for a, b, _ in tree])
    np.fill_diagonal(far, np.inf)
    assert ward.height_at_neighbours(x, 30) == pytest.approx(np.percentile(far.min(1), 30))
