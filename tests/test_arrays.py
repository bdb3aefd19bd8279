import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.functions import arrays as A
from hitlake.functions import registry as R


def one(spark, v, expr, kind="array<double>"):
    return spark.createDataFrame([(v,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def test_moments_of_constant_and_empty(spark):
    assert one(spark, [2.0] * 5, lambda v: A.let(A.moments(v), A.skewness)) is None
    assert one(spark, [], lambda v: A.let(A.moments(v), A.kurtosis)) is None
    assert one(spark, [], A.median) is None
    assert one(spark, [3.0, 1.0, 2.0, 10.0], A.median) == 2.5
    x = np.random.default_rng(0).normal(size=50)
    m = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert one(spark, x.tolist(), lambda v: A.let(A.moments(v), A.skewness)) == pytest.approx(m)


def test_peak_run(spark):
    v = [0.0, 0.0, 0.0, 1.0, 5.0, 9.0, 5.0, 1.0, 0.0, 0.0, 0.0]
    assert tuple(one(spark, v, A.peak_run)) == (5.0, False)
    assert tuple(one(spark, [9.0, 5.0, 0.0, 0.0, 0.0], A.peak_run)) == (2.0, True)
    assert tuple(one(spark, [1.0] * 6, A.peak_run)) == (0.0, False)


def test_argmax_takes_the_first(spark):
    assert one(spark, [1.0, 7.0, 7.0], A.argmax) == 1


def test_widths():
    assert A.widths(60)[0] == 3 and A.widths(60)[-1] == 60 and A.widths(60) == sorted(set(A.widths(60)))


def test_redness_is_a_ratio_of_powers(spark):
    x = np.random.default_rng(1).normal(size=40)
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    assert one(spark, x.tolist(), lambda v: A.redness(v, 40)) == pytest.approx(p[1:3].mean() / p[3:5].mean())


def test_drift_residual_of_a_straight_line(spark):
    img = np.eye(6).tolist()
    assert one(spark, img, A.drift_residual, "array<array<double>>") == pytest.approx(0)
    assert one(spark, img, A.time_occupancy, "array<array<double>>") == 1.0


def test_crop_and_fill(spark):
    img = [[-1.0, -1.0, 1.0, 2.0, 3.0, float("nan")], [-1.0, -1.0, 4.0, 5.0, 6.0, 7.0]]
    got = one(spark, img, lambda v: A.crop_fill(v, F.lit(4), 4), "array<array<double>>")
    assert got == [[1.0, 2.0, 3.0, 4.0], [4.0, 5.0, 6.0, 7.0]]
    pad = [[-1.0] * 4] * 2
    assert one(spark, pad, lambda v: A.crop_fill(v, F.lit(4), 3), "array<array<double>>") == [[0.0] * 3] * 2
    assert one(spark, pad, A.noise_sigma, "array<array<double>>") is None


def test_registry_takes_new_features_once(spark):
    @R.feature("kernel", "k_peak")
    def loudest(cubes):
        return {"k_peak": [c.max() for c in cubes]}

    try:
        with pytest.raises(ValueError, match="already"):
            R.feature("kernel", "k_peak")(loudest)
        img = np.random.default_rng(0).normal(size=(8, 8))
        got = R.with_cutout_features(spark.createDataFrame([(1, img.tolist())], "id long, img array<array<double>>"), 8, 1.5).first()
        assert got.k_peak == pytest.approx(img.max()) and got.feature_ok in (True, False)
    finally:
        del R.FEATURES["loudest"]
    assert len(R.all_columns()) == 18 and R.column_kinds()["f12_bandwidth_saturated"] == "flag" and len(R.describe()) == len(R.FEATURES)
