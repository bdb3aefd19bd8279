import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.operators import dedupe as D
from hitlake.operators import injection as I
from hitlake.operators import transforms as T
from hitlake.sources import files

nan, inf = float("nan"), float("inf")


def frame(spark, v, file="f"):
    return spark.createDataFrame([(k, file, x) for k, x in enumerate(v)], "id long, file string, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("how", "want"), [("unit", [0.0, 0.5, 1.0, None, None]), ("unit-max", [0.25, 0.625, 1.0, None, None]), ("none", [1.0, 2.5, 4.0, None, None]), ("log-unit", [0.0, 0.6609640474436812, 1.0, None, None])])
def test_normalise(spark, how, want):
    got = column(T.normalise(frame(spark, [1.0, 2.5, 4.0, nan, None]), {"x": how})[0], "x_n")
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_normalise_few_or_constant_values(spark):
    assert column(T.normalise(frame(spark, [1.0, None]), {"x": "unit"})[0], "x_n") == [None, None]
    assert column(T.normalise(frame(spark, [2.0, 2.0]), {"x": "unit"})[0], "x_n") == [0.0, 0.0]
    assert column(T.normalise(frame(spark, [-1.0, 0.0, 10.0, 100.0]), {"x": "log-unit"})[0], "x_n") == [None, None, 0.0, 1.0]


def test_normalise_is_per_file(spark):
    df = frame(spark, [0.0, 1.0], "a").union(frame(spark, [10.0, 20.0], "b"))
    assert sorted(r.x_n for r in T.normalise(df, {"x": "unit"})[0].collect()) == [0, 0, 1, 1]


def test_quantiles(spark):
    got = column(T.normalise(frame(spark, [5.0, 1.0, 1.0, 9.0]), {"x": "quantile-uniform"})[0], "x_n")
    assert got == pytest.approx([2 / 3, 1 / 6, 1 / 6, 1.0], abs=2e-3)
    normal = column(T.normalise(frame(spark, [float(k) for k in range(101)]), {"x": "quantile-normal"})[0], "x_n")
    assert normal[50] == pytest.approx(0, abs=1e-9) and normal[0] < -5 and normal == sorted(normal)


def test_scale(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 1000.0])
    assert column(T.scale(df, ["x"]), "x_s") == [-1.0, -0.5, 0.0, 0.5, 5.0]
    assert column(T.scale(frame(spark, [1.0, 1.0, 1.0, 2.0]), ["x"], "none"), "x_s") == [1.0, 1.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="unknown scaling"):
        T.scale(df, ["x"], "other")


def test_weights(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 10.0, 1.0, 1.0)], "a double, b double, c double, d double")
    w = T.equalising_weights(df, list("abcd"), {"d": "flag"})
    assert w["c"] == w["d"] == 1.0 and w["a"] / w["b"] == pytest.approx(10) and (w["a"] + w["b"]) / 2 == pytest.approx(1)
    share = {r.feature: r.share for r in T.distance_share(df, ["a", "b"]).collect()}
    assert share["b"] == pytest.approx(100 / 101)


def test_normalise_like(spark):
    known, _ = T.normalise(frame(spark, [0.0, 10.0, 20.0]), {"x": "unit"})
    got = T.normalise_like(known, frame(spark, [5.0, 30.0, nan]), ["x"])
    rows = got.orderBy("id").collect()
    assert [r.x_n for r in rows] == [0.25, 1.0, None] and [r.out_of_range for r in rows] == [0, 1, 0]
    with pytest.raises(ValueError, match="no reference"):
        T.normalise_like(known, frame(spark, [1.0], "other"), ["x"])


@pytest.mark.parametrize("grid", [4096, 40])
def test_long_curves_are_met_at_every_point(spark, monkeypatch, grid):
    x = np.random.default_rng(3).lognormal(size=500).round(2)
    df = spark.createDataFrame([(k, "ab"[k % 2], float(v), float(v) ** 2) for k, v in enumerate(x)], "id long, file string, x double, z double")
    known, _ = T.normalise(df, {"x": "log-unit", "z": "log-unit"})
    monkeypatch.setattr(T, "GRID", grid)
    odd = [(1000, "a", nan, 1.0), (1001, "b", float("inf"), None), (1002, "b", -5.0, 1e9)]
    new = df.withColumn("x", F.col("x") * 1.07).unionByName(spark.createDataFrame(odd, df.schema)).unionByName(df.where("id = 7"))
    rows = known.toPandas()
    got = T.normalise_like(known, new, ["x", "z"]).toPandas()
    assert len(got) == 504
    for file in "ab":
        own, out = rows[rows.file == file], got[got.file == file]
        for c in "xz":
            first = own.groupby(c)[f"{c}_n"].min()
            fine = np.isfinite(out[c].to_numpy(float))
            assert out[f"{c}_n"][fine].to_numpy() == pytest.approx(np.interp(out[c][fine], first.index, first), abs=1e-12)
            assert out[f"{c}_n"][~fine].isna().all()
        beyond = sum(((out[c] < own[c].min()) | (out[c] > own[c].max())).to_numpy(int) for c in "xz")
        assert (out.out_of_range == beyond / 2).all()


def test_rows_of_one_file_do_not_meet_in_one_task(spark):
    df = spark.createDataFrame([(k, "a", k) for k in range(50)], "id long, file string, row int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.deduplicate(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_duplicates_come_from_the_largest_file(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "b", 1), (3, "a", 1), (4, "b", 2)], "id long, file string, row int")
    assert {(r.id, r.file) for r in D.deduplicate(df, ["id"]).collect()} == {(1, "b"), (2, "b"), (3, "a"), (4, "b")}


@pytest.mark.parametrize(("good", "twin", "left"), [(3, 2, "x"), (2, 3, "x_clean"), (2, 2, "x")])
def test_superseded(spark, good, twin, left):
    rows = [("x", k < good) for k in range(4)] + [("x_clean", k < twin) for k in range(4)] + [("y", True)]
    got = {r.file for r in D.drop_superseded(spark.createDataFrame(rows, "file string, feature_ok boolean")).collect()}
    assert got == {left, "y"}


def test_sample_is_the_same_for_any_partitioning(spark):
    a = {r.id for r in D.sample(spark.range(1000).repartition(7), 50).collect()}
    assert a == {r.id for r in D.sample(spark.range(1000), 50).collect()} and len(a) == 50
    assert D.sample(spark.range(5), 50).count() == 5


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([(k, True, True, 0) for k in range(3)], "id long, feature_ok boolean, stamp_ok boolean, weak_label int")
    files.write(df, f"{tmp_path}/s_band_long_globular.parquet")
    files.write(df, f"{tmp_path}/old_features.parquet")
    df.drop("stamp_ok").write.parquet(f"{tmp_path}/foreign_globular.parquet")
    assert set(files.discover(spark, str(tmp_path))) == {"s_band_long", "old"}
    assert files.migrate(spark, str(tmp_path)) == (["old"], []) and files.migrate(spark, str(tmp_path)) == ([], ["old"])
    assert files.find(spark, str(tmp_path), "old").endswith("old_globular.parquet")
    assert files.read(spark, files.find(spark, str(tmp_path), "old"), ["weak_label"]).columns == ["id", "weak_label"]
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.write(df.union(df.limit(1)), f"{tmp_path}/bad.parquet")
    with pytest.raises(ValueError, match="needs an id"):
        files.write(df.drop("id"), f"{tmp_path}/bad.parquet")
    with pytest.raises(FileNotFoundError):
        files.find(spark, str(tmp_path), "none")
    assert files.split_filename("a_b_globular.parquet") == ("a_b", "globular") and files.split_filename("a_other.parquet")[1] is None


def test_strict_json(tmp_path):
    path = str(tmp_path / "r.json")
    files.write_json({"a": nan, "b": [inf, True, np.float64(2)], "c": np.bool_(False)}, path)
    import json

    assert json.load(open(path)) == {"a": None, "b": [None, True, 2.0], "c": False}


def test_injection_keeps_padding_and_gives_the_snr(spark):
    img = np.concatenate([np.full((24, 8), -1.0), np.random.default_rng(0).gamma(15, size=(24, 16))], axis=1)
    df = spark.createDataFrame([(1, img.tolist(), 16), (2, np.full((24, 24), -1.0).tolist(), 16)], "id long, img array<array<double>>, numChannels int")
    got = {r.id: r for r in I.inject(df, 24, 1.0, 18.0, snr=F.lit(20.0), drift_hz_s=F.lit(0.0)).collect()}
    new = np.array(got[1].img)
    assert (new[:, :8] == -1).all() and (new[:, 8:] >= img[:, 8:]).all()
    g = (new - img)[:, 8:]
    real = img[:, 8:]
    sigma = 1.4826 * np.median(np.abs(real - np.median(real)))
    assert (g * g).sum() ** 0.5 / sigma == pytest.approx(20)
    assert (np.array(got[2].img) == -1).all() and got[2].amplitude == 0
    wild = I.inject(df.where("id = 1"), 24, 1.0, 18.0, snr=F.lit(20.0), drift_hz_s=F.lit(0.0), fluctuate=True).first()
    assert (np.array(wild.img)[:, :8] == -1).all() and np.array(wild.img).sum() == pytest.approx(new.sum(), rel=0.05)
