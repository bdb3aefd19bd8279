import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.operators import ranks

POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_keys_sort_as_numbers_do():
    x = np.array([-1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300])
    keys = ranks.sort_keys(x)
    assert (np.diff(keys[[0, 1, 2, 4, 5, 6, 7, 8]].astype(float)) >= 0).all() and keys[3] == keys[4]
    assert sorted(keys.tolist()) == keys.tolist() and (ranks.from_keys(keys) == x).all()


@pytest.mark.parametrize("few", [0, 50, 100_000])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, few):
    """With few = 0 every column is narrowed to its last bit."""
    monkeypatch.setattr(ranks, "FEW", few)
    k = F.col("id")
    df = spark.range(0, 4000, 1, 7).select(
        (F.rand(1) * 1e6 - 3e5).alias("wide"), F.when(k % 3 == 0, 1.5).otherwise(F.randn(2)).alias("tied"), F.exp(F.randn(3) * 40).alias("steep"), F.lit(-2.0).alias("one"),
        F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, float("-inf")).when(k % 11 > 0, F.floor(k / 100)).alias("holes"), F.lit(None).cast("double").alias("none"), (k % 4).cast("int").alias("few"),
    )
    df = spark.createDataFrame(df.toPandas(), df.schema).repartition(5)
    got = ranks.quantiles(df, {c: c for c in df.columns}, POINTS)
    good = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in df.columns]
    want = df.agg(*(F.percentile(x, F.array(*map(F.lit, POINTS))).alias(c) for x, c in zip(good, df.columns, strict=True))).first()
    assert got == want.asDict()


def test_as_few_jobs_as_passes(spark, monkeypatch):
    seen = []
    count = ranks._counts
    monkeypatch.setattr(ranks, "_counts", lambda *a: seen.append(1) or count(*a))
    df = spark.range(50_000).select((F.rand(1) * 1000).alias("x"), F.lit(3.0).alias("y"))
    ranks.quantiles(df, {"x": "x", "y": "y", "z": F.col("x") * 2}, [0.5])
    assert len(seen) <= 6, "one a pass for all columns; the constant one is narrowed to its end"


def test_columns_beyond_the_ranges_take_another_run(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGES", 2)
    df = spark.createDataFrame([(float(v), -float(v)) for v in range(9)], "a double, b double")
    assert ranks.quantiles(df, {"a": "a", "b": "b"}, [0.5]) == {"a": [4.0], "b": [-4.0]}
    assert ranks.quantiles(df.limit(0), {"a": "a"}, [0.5]) == {"a": None}
    assert ranks.quantiles(df, {}, [0.5]) == {}
