"""Duplicate ids, superseded files, and the health of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import finite
from .ranks import quantiles


def deduplicate(df: DataFrame, keys: list[str], file: str = "file", order: list[str] = ("row",)) -> DataFrame:
    """One row a key: from the file with most rows, then by name and order. File sizes are a small table, a row a file, and are sent: rows meet by key alone."""
    sizes = df.groupBy(file).agg(F.count("*").alias("_size"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_size"), file, *order)
    return df.join(F.broadcast(sizes), file).withColumn("_k", F.row_number().over(best)).where("_k = 1").select(df.columns)


def drop_superseded(df: DataFrame, suffix: str = "_clean") -> DataFrame:
    """Of a file and its repaired twin the one with fewer feature_ok rows goes; a tie drops the twin."""
    good = df.groupBy("file").agg(F.count_if("feature_ok").alias("good"))
    twin = good.where(F.col("file").endswith(suffix)).select(F.expr(f"substring(file, 1, length(file) - {len(suffix)})").alias("base"), F.col("file").alias("twin"), F.col("good").alias("twin_good"))
    loser = good.join(twin, good.file == twin.base).select(F.when(F.col("twin_good") > F.col("good"), F.col("base")).otherwise(F.col("twin")).alias("file"))
    return df.join(loser, "file", "left_anti").select(df.columns)


def combine(tables: list[DataFrame], keys: list[str] = ("id",)) -> DataFrame:
    """Per-file tables as one: superseded files go, then duplicate ids."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return deduplicate(drop_superseded(both), list(keys))


def feature_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, pct_finite, p1, p50, p99), one row a column: exact quantiles by ranks, shares in one aggregation."""
    at = quantiles(df, {c: c for c in columns}, [0.01, 0.5, 0.99])
    told = lambda c, k: F.lit(at[c][k] if at[c] else None).cast("double")
    shares = [F.try_divide(100.0 * F.count_if(finite(c)), F.count("*")).alias(f"{c}|f") for c in columns]
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|f`").alias("pct_finite"), *(told(c, k).alias(p) for k, p in enumerate(("p1", "p50", "p99")))) for c in columns))
    return df.agg(*shares).select(F.inline(rows))


def file_info(df: DataFrame) -> DataFrame:
    """What a delivery holds, one row a file."""
    return df.groupBy("file").agg(
        F.count("*").alias("n"), F.min("numTimesteps").alias("min_timesteps"), F.max("numTimesteps").alias("max_timesteps"), F.min("snr").alias("min_snr"), F.max("snr").alias("max_snr"),
        F.median("snr").alias("median_snr"), F.max(F.abs("driftRate")).alias("max_abs_drift"), (100.0 * F.count_if(F.col("driftRate") == 0) / F.count("*")).alias("pct_zero_drift"),
        F.countDistinct("obsid").alias("n_obs"), F.countDistinct("sourceName").alias("n_sources"), F.countDistinct("beam").alias("n_beams"), (F.count_if(F.col("incoherentPower") != 0) == 0).alias("incoherent_all_zero"),
    )


def coincidence_table(df: DataFrame, limits: tuple[int, ...] = (1, 2, 4, 8, 16, 32), nb: str = "nb", max_beams: int = 4) -> DataFrame:
    """(max_beams, n_hits) for each limit, and the hits that drift as well: one pass."""
    sums = df.agg(*(F.count_if(F.col(nb) <= k).alias(f"n{k}") for k in limits), F.count_if((F.col(nb) <= max_beams) & (F.col("driftRate") != 0)).alias("drifting"))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("max_beams"), F.col(f"n{k}").alias("n_hits"), F.col("drifting")) for k in limits))))


def beams_formed(df: DataFrame) -> DataFrame:
    """One row an observation: beams formed and seen, whether they are contiguous and have one source each, mean position."""
    per = df.groupBy("obsid", "beam").agg(F.countDistinct("sourceName").alias("sources"), F.sum("ra").alias("ra"), F.sum("dec").alias("dec"), F.count("*").alias("n"))
    return per.groupBy("obsid").agg(
        (F.max("beam") + 1).alias("n_formed"), F.count("*").alias("n_seen"), (F.max("sources") <= 1).alias("one_source_a_beam"), (F.max("beam") - F.min("beam") + 1 == F.count("*")).alias("contiguous"),
        (F.sum("ra") / F.sum("n")).alias("mean_ra"), (F.sum("dec") / F.sum("n")).alias("mean_dec"),
    )


def occupancy(df: DataFrame, beams: int = 64) -> DataFrame:
    """Hits of each observation and beam, as one array an observation."""
    counts = df.groupBy("obsid", "beam").agg(F.count("*").alias("n")).groupBy("obsid").agg(F.map_from_entries(F.collect_list(F.struct("beam", "n"))).alias("m"))
    return counts.select("obsid", F.transform(F.sequence(F.lit(0), F.lit(beams - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("hits"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from low to high; the last holds its upper end."""
    k = F.when(F.col(column) == high, F.lit(bins - 1)).otherwise(F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int"))
    return df.where(F.col(column).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for any partitioning: those of least hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
