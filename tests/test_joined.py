"""Stored tables join without a shuffle; the matrix and the summary of combined tables."""

import pytest
from pyspark.sql import functions as F

from hitlake.operators import tables as J


@pytest.fixture
def pair(spark):
    rows = spark.range(500).select("id", F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").alias("row"))
    features = rows.withColumns({"x": F.col("id") * 0.5, "flag_old": F.lit(True), "pass_all": F.lit(False)})
    flags = rows.where("id < 400").withColumns({"flag_a": F.col("id") % 2 == 0, "pass_all": F.col("id") % 4 == 1})
    return features, flags


def test_flags_join_by_file_and_row(spark, pair):
    features, flags = pair
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = (J.stored(d, ["file", "row"], buckets=4) for d in pair)
        got = J.with_flags(a, b)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = {r.id: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == 500 and all(r.flag_a == (k % 2 == 0) and r.pass_all == (k % 4 == 1) for k, r in rows.items() if k < 400)
    assert all(r.flag_a is None and r.pass_all is None and r.flag_old for k, r in rows.items() if k >= 400)
    with pytest.raises(ValueError, match="several rows"):
        J.with_flags(features, flags.union(flags))


def test_matrix(spark):
    df = spark.createDataFrame([(k, float(k), 2.0 * k, None if k == 3 else float("nan") if k == 5 else float(k), 1.0) for k in range(40)], "id long, f03_snr double, f03_snr_n double, f12_bandwidth_hz_n double, f08_turning_bw_hz_n double")
    got = J.feature_matrix(df)
    assert got.columns == ["f03_snr", "f12_bandwidth_hz"] and got.space == ["f03_snr_s", "f12_bandwidth_hz_s"]
    rows = {r.id: r for r in got.rows.collect()}
    assert len(rows) == 40 and got.usable().count() == 38 and not rows[3].usable and rows[5].f03_snr_s is None and rows[5].f03_snr == 5.0
    middle = sorted(2.0 * k for k in range(40) if k not in (3, 5))
    assert rows[0].f03_snr_s == pytest.approx((0 - (middle[18] + middle[19]) / 2) / 39.5, rel=0.1) and rows[39].f03_snr_n == 78.0
    assert "f08_turning_bw_hz" in J.feature_matrix(df, drop_saturated=False).columns
    plain = J.feature_matrix(df, ["f03_snr"], scaling="none").rows.collect()
    assert all(r.f03_snr_s == r.f03_snr_n for r in plain)
    with pytest.raises(ValueError, match="no columns"):
        J.feature_matrix(df, ["other"])


def test_summary(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (2.0, 0, "a"), (None, -1, "b"), (3.0, -1, None)], "x double, weak_label int, group_id string")
    got = {(r.part, r["name"]): r for r in J.combined_summary(df, ["x"]).collect()}
    assert got["feature", "x"].pct == 75 and got["feature", "x"].p50 == 2 and got["label", "ambiguous"].n == 2 and got["label", "rfi"].pct == 25
    assert got["groups", "group_id"].n == 2 and got["rows", "all"].n == 4
    none = {(r.part, r["name"]): r for r in J.combined_summary(df.where("false"), ["x"]).collect()}
    assert none["rows", "all"].n == 0 and none["label", "rfi"].pct is None
