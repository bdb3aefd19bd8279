"""Fitted transforms of feature columns. A fit is a small table or a dict; applying it is a plan of column expressions."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..schema import finite
from ..shared import saved
from .ranks import quantiles

EPS, TINY_IQR, CLIP = 1e-30, 1e-12, 5.0

#: How each feature is normalised.
TRANSFORMS = {
    "f01_frequency": "quantile-uniform",
    "f02_abs_drift": "quantile-normal",
    "f03_snr": "log-unit",
    "f04_spectral_skew": "unit",
    "f05_spectral_kurtosis": "log-unit",
    "f06_bimodality": "none",
    "f07_kurt_bw_corr": "none",
    "f08_turning_bw_hz": "log-unit",
    "f09_temporal_skew": "unit-max",
    "f10_timeseries_std": "log-unit",
    "f11_spectrum_std": "log-unit",
    "f12_bandwidth_hz": "unit",
    "f13_redness": "log-unit",
    "x01_drift_residual": "log-unit",
    "x02_time_occupancy": "none",
    "x03_channel_offset": "none",
}
QUANTILES = 1000
#: Probabilities below this, or as near to 1, count as this in a normal score.
NORMAL_END = 1e-7
#: Groups whose quantile curves may go to the executors with the plan (8 kB a curve).
GROUPS = 4096


def _usable(column: str, how: str) -> Column:
    """The value that is transformed, null where it can't be."""
    x = F.when(finite(column), F.col(column).cast("double"))
    return F.when(x > 0, F.log10(x)) if how.startswith("log") else x


def fit(df: DataFrame, transforms: dict[str, str], by: list[str] = ()) -> DataFrame:
    """One row a group: struct columns with what each transform needs. All columns in one aggregation.

    The curves of a whole table come by ranks (ranks.py); those of groups hold a group's distinct values.
    """
    places = [k / (QUANTILES - 1) for k in range(QUANTILES)]
    curved = {c: _usable(c, how) for c, how in transforms.items() if how.startswith("quantile")}
    whole = quantiles(df, curved, places) if curved and not by else {}
    stats = []
    for c, how in transforms.items():
        x = _usable(c, how)
        parts = [F.count(_usable(c, "none")).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.abs(x)).alias("most")]
        if c in whole:
            parts.append((F.lit(whole[c]) if whole[c] else F.lit(None)).cast("array<double>").alias("curve"))
        elif c in curved:
            parts.append(F.percentile(x, F.array(*map(F.lit, places))).alias("curve"))
        stats.append(F.struct(*parts).alias(f"_{c}"))
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def quantile_places(v: np.ndarray, curve: np.ndarray, normal: bool) -> np.ndarray:
    """Places on a quantile curve, 0 to 1: interpolated, ties in their middle; as normal scores where asked. NaN stays."""
    p = np.arange(len(curve)) / (len(curve) - 1)
    high, low = np.interp(v, curve, p), -np.interp(-v, -curve[::-1], -p[::-1])
    # A flat stretch has its last place from one side and its first from the other.
    out = np.where(np.isfinite(v), (high + low) / 2, np.nan)
    if normal:
        scores = NormalDist()
        out = np.array([scores.inv_cdf(min(max(x, NORMAL_END), 1 - NORMAL_END)) if x == x else np.nan for x in out])
    return out


def _on_curve(x: Column, key: Column, curves: dict[str, list[float]], normal: bool) -> Column:
    @F.pandas_udf("double")
    def place(values: pd.Series, keys: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=values.index)
        for k in keys.unique():
            if curves.get(k):
                out[keys == k] = quantile_places(values[keys == k].to_numpy(float), np.array(curves[k]), normal)
        return out

    return F.nanvl(place(x, key), F.lit(None))


def apply(df: DataFrame, fitted: DataFrame, transforms: dict[str, str], by: list[str] = (), suffix: str = "_n") -> DataFrame:
    """Adds the transformed twin of each column. The fit has one row a group and is joined on it."""
    names, out = df.columns, {}
    key, curves = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)), {}
    if curved := [c for c, how in transforms.items() if how.startswith("quantile")]:
        rows = fitted.select(key.alias("key"), *(F.col(f"_{c}.curve").alias(c) for c in curved)).limit(GROUPS + 1).collect()
        if len(rows) > GROUPS:
            raise ValueError(f"more than {GROUPS} groups with quantile curves")
        curves = {c: {r["key"]: r[c] for r in rows} for c in curved}
    df = df.join(fitted, list(by), "left") if by else df.crossJoin(F.broadcast(fitted))  # without groups, the fit is one row
    for c, how in transforms.items():
        x, s = _usable(c, how), F.col(f"_{c}")
        if how.startswith("quantile"):
            y = _on_curve(x, key, curves[c], how.endswith("normal"))
        elif how == "unit-max":
            y = F.when(s["most"] > EPS, x / s["most"]).otherwise(F.when(x.isNotNull(), 0.0))
        elif how == "none":
            y = x
        else:
            y = F.when(s["high"] - s["low"] > EPS, (x - s["low"]) / (s["high"] - s["low"])).otherwise(F.when(x.isNotNull(), 0.0))
        out[c + suffix] = F.when(s["n"] >= 2, y)
    return df.withColumns(out).select(*names, *out)


def normalise(df: DataFrame, transforms: dict[str, str] | None = None, by: list[str] = ("file",), suffix: str = "_n") -> tuple[DataFrame, DataFrame]:
    """The columns normalised within each file, and the fit. Fewer than two finite values give null."""
    transforms = {c: h for c, h in (transforms or TRANSFORMS).items() if c in df.columns}
    by = [c for c in by if c in df.columns]
    fitted = fit(df, transforms, by)
    return apply(df, fitted, transforms, by, suffix), fitted


def robust_stats(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    """Median and interquartile range of the finite rows.

    Exact ones take a few passes over df (ranks.py). An accuracy makes it one, with which ranks
    are off by one part in as many at most.
    """
    points = [0.25, 0.5, 0.75]
    if accuracy is None:
        row = quantiles(df, {c: c for c in columns}, points)
    else:
        row = df.agg(*(F.percentile_approx(F.when(finite(c), F.col(c)), F.array(*map(F.lit, points)), accuracy).alias(c) for c in columns)).first()
    return {c: (row[c][1], row[c][2] - row[c][0]) if row[c] else (0.0, 1.0) for c in columns}


def robust(column: str, middle: float, iqr: float) -> Column:
    return clip((F.col(column) - middle) / (iqr if iqr > TINY_IQR else 1.0), -CLIP, CLIP)


def scale(df: DataFrame, columns: list[str], scaling: str = "robust", stats: dict | None = None, weights: dict | None = None, suffix: str = "_s", kinds: dict[str, str] | None = None) -> DataFrame:
    """Distance scaling: robust, robust-equalised, quantile or none. kinds: of the columns; weights leave boolean ones and flags alone."""
    if scaling in ("robust", "robust-equalised"):
        stats = stats or robust_stats(df, columns)
        out = {c + suffix: robust(c, *stats[c]) for c in columns}
        if scaling == "robust-equalised":
            df = df.withColumns(out)
            weights = weights or equalising_weights(df, [c + suffix for c in columns], {c + suffix: (kinds or {}).get(c) for c in columns})
            return df.withColumns({c + suffix: F.col(c + suffix) * float(weights[c + suffix]) for c in columns})
        return df.withColumns(out)
    if scaling == "quantile":
        how = dict.fromkeys(columns, "quantile-uniform")
        return apply(df, fit(df, how), how, suffix=suffix)
    if scaling == "none":
        return df.withColumns({c + suffix: F.col(c) for c in columns})
    raise ValueError(f"unknown scaling {scaling!r}")


def equalising_weights(df: DataFrame, columns: list[str], kinds: dict[str, str], **options) -> dict[str, float]:
    """Weight by column; see weights.py."""
    from .weights import equalise

    return equalise(df, columns, kinds, **options).by_column


def weights_and_trace(df: DataFrame, columns: list[str], kinds: dict[str, str], **options) -> tuple[dict[str, float], dict]:
    """Weight by column, and how the steps went."""
    from .weights import equalise

    found = equalise(df, columns, kinds, **options)
    return found.by_column, {"dev_trace": found.steps, "skipped": found.fixed, "spread_warning": found.uneven}


#: Points of a stored curve that go to the executors, about, and of all curves at most.
GRID, POINTS = 4096, 4_000_000


def _points(reference: DataFrame, columns: list[str], suffix: str, by: str) -> DataFrame:
    """(file, column, raw, norm): distinct points of the curves, the least normalised value of each."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("raw"), F.col(c + suffix).cast("double").alias("norm")) for c in columns))
    return reference.select(F.col(by).cast("string").alias("file"), F.inline(pairs)).where(finite("raw") & finite("norm")).groupBy("file", "column", "raw").agg(F.min("norm").alias("norm"))


def _thinned(points: DataFrame, grid: int) -> tuple[dict, bool]:
    """Curves of about `grid` points each, and whether any was thinned."""
    sizes = points.groupBy("file", "column").agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
    kept = points.join(F.broadcast(sizes), ["file", "column"]).where((F.pmod(F.xxhash64("raw"), F.col("n")) < grid) | (F.col("raw") == F.col("low")) | (F.col("raw") == F.col("high")))  # a row a curve
    rows = kept.select("file", "column", "raw", "norm", (F.col("n") > grid).alias("thin")).limit(POINTS + 1).toPandas()
    if len(rows) > POINTS:
        raise ValueError(f"more than {POINTS} points of curves: normalise fewer files at once")
    return {key: (own["raw"].to_numpy(), own["norm"].to_numpy()) for key, own in rows.sort_values("raw", kind="stable").groupby(["file", "column"])}, bool(rows["thin"].any())


def curves(reference: DataFrame, columns: list[str], suffix: str = "_n", by: str = "file", grid: int = GRID) -> dict:
    """{(file, column): (raw values in order, normalised ones)}: distinct points, the first normalised value of each.

    A curve of more than `grid` points is thinned to about as many by a hash of the value; its ends stay.
    """
    return _thinned(_points(reference, columns, suffix, by), grid)[0]


def normalise_like(reference: DataFrame, new: DataFrame, columns: list[str], suffix: str = "_n", by: str = "file") -> DataFrame:
    """New raw values on the stored curves (raw, normalised) of their file, interpolated; outside, the end's value.

    Adds out_of_range, the share of columns beyond the file's values. A file without a curve is an
    error. Curves of GRID points at most are broadcast, so the new rows aren't shuffled. Of longer ones thinned curves
    are: these cut them into stretches, in which each different value finds the points on its two sides.
    """
    wanted = [r[by] for r in new.select(by).distinct().join(reference.select(by).distinct(), by, "left_anti").limit(5).collect()]
    if wanted:
        raise ValueError(f"no reference rows for {wanted}")
    points = saved(_points(reference, columns, suffix, by), "curves")
    short, thin = _thinned(points, GRID)
    known = new.sparkSession.sparkContext.broadcast(short)
    if thin:
        return _between_points(points, known, new, columns, suffix, by)
    shape = ", ".join(f"{c}{suffix} double" for c in columns) + ", out_of_range double"

    @F.pandas_udf(shape)
    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        out, outside = {}, np.zeros(len(rows))
        for c in columns:
            v, y = rows[c].to_numpy(float), np.full(len(rows), np.nan)
            for file in rows["file"].dropna().unique():
                if curve := known.value.get((file, c)):
                    at = (rows["file"] == file).to_numpy()
                    y[at] = np.where(np.isfinite(v[at]), np.interp(v[at], *curve), np.nan)
                    outside[at] += (v[at] < curve[0][0]) | (v[at] > curve[0][-1])
            out[c + suffix] = y
        return pd.DataFrame(out | {"out_of_range": outside / max(len(columns), 1)})

    given = F.struct(F.col(by).cast("string").alias("file"), *(F.col(c).cast("double").alias(c) for c in columns))
    done = new.withColumn("_like", placed(given))
    return done.select(*new.columns, *(F.nanvl(f"_like.{c}{suffix}", F.lit(None)).alias(c + suffix) for c in columns), "_like.out_of_range")


def _between_points(points: DataFrame, known, new: DataFrame, columns: list[str], suffix: str, by: str) -> DataFrame:
    """normalise_like() on all points of curves that are too long to be sent; known: thinned ones."""

    @F.pandas_udf("stretch int, raw double, norm double")
    def stretch(file: pd.Series, column: pd.Series, x: pd.Series) -> pd.DataFrame:
        """The stretch of a thinned curve from one of its points up to before the next, and that next point; -1 before the first."""
        at, raw, norm = np.full(len(x), -1, np.int32), np.full(len(x), np.nan), np.full(len(x), np.nan)
        for (f, c), own in x.groupby([file, column]):
            if curve := known.value.get((f, c)):
                where = x.index.get_indexer(own.index)
                k = np.searchsorted(curve[0], own.to_numpy(float), "right")
                at[where], inside = k - 1, k < len(curve[0])
                raw[where[inside]], norm[where[inside]] = curve[0][k[inside]], curve[1][k[inside]]
        return pd.DataFrame({"stretch": at, "raw": raw, "norm": norm})

    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))
    asked = new.select(F.col(by).cast("string").alias("file"), F.inline(pairs)).where(finite("x")).distinct()
    both = points.select("file", "column", F.col("raw").alias("x"), F.struct("raw", "norm").alias("_point"), F.lit(False).alias("_asked"))
    both = both.unionByName(asked.withColumns({"_point": F.lit(None).cast("struct<raw:double,norm:double>"), "_asked": F.lit(True)}))
    both = both.withColumn("_s", stretch("file", "column", "x"))
    own = Window.partitionBy("file", "column", "_s.stretch")
    nearest = lambda order: F.last("_point", ignorenulls=True).over(own.orderBy(order))
    edge = F.when(finite("_s.raw"), F.struct(F.col("_s.raw").alias("raw"), F.col("_s.norm").alias("norm")))
    sides = both.withColumns({"_a": nearest(F.asc("x")), "_b": F.coalesce(nearest(F.desc("x")), edge)}).where("_asked")
    a, b, x = F.col("_a"), F.col("_b"), F.col("x")
    y = F.when(a.isNull(), b["norm"]).when(b.isNull() | (a["raw"] == x), a["norm"]).otherwise(a["norm"] + (x - a["raw"]) / (b["raw"] - a["raw"]) * (b["norm"] - a["norm"]))
    found = saved(sides.select("file", "column", "x", y.alias("y")), "placed")
    ends = {c: {f: (curve[0][0], curve[0][-1]) for (f, of), curve in known.value.items() if of == c} for c in columns}
    out, outside = new, F.lit(0)
    for i, c in enumerate(columns):
        own = found.where(F.col("column") == c).select(F.col("file").alias("_file"), F.col("x").alias("_x"), F.col("y").alias(f"_y{i}"))
        low = new.sparkSession.createDataFrame([(f, float(p), float(q)) for f, (p, q) in ends[c].items()], f"_of string, _low{i} double, _high{i} double")
        file, v = F.col(by).cast("string"), F.col(c).cast("double")
        out = out.join(own, (file == F.col("_file")) & (v == F.col("_x")), "left").drop("_file", "_x")
        out = out.join(F.broadcast(low), file == F.col("_of"), "left").drop("_of")  # a row a file
        outside = outside + F.coalesce((~F.isnan(v) & ((v < F.col(f"_low{i}")) | (v > F.col(f"_high{i}")))).cast("int"), F.lit(0))
    return out.select(*new.columns, *(F.col(f"_y{i}").alias(c + suffix) for i, c in enumerate(columns)), (outside / F.lit(float(max(len(columns), 1)))).alias("out_of_range"))


def distance_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, share): each column's part of the mean squared distance of two rows, which is that of its variance."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    return shares(row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("total")) for c in columns)))))


def shares(totals: DataFrame) -> DataFrame:
    """(feature, share) of (feature, total): the sum is taken once, over one row a column."""
    whole = totals.agg(F.sum("total").alias("whole"))
    return totals.crossJoin(whole).select("feature", F.when(F.col("whole") > 0, F.col("total") / F.col("whole")).alias("share"))


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """df with pc1..pck from the covariance of the columns, each rescaled to 0..1; signs are fixed by the largest loading."""
    n = len(columns)
    sums = df.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i in range(n) for j in range(i, n))).first()
    cov = np.zeros((n, n))
    for v, (i, j) in zip(sums[1 + n :], [(i, j) for i in range(n) for j in range(i, n)], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, np.argsort(-values)][:, :k]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    df = df.withColumns({f"pc{j + 1}": sum(((F.col(c) - float(sums[1 + i])) * float(vectors[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(k)})
    ends = df.agg(*(f(f"pc{j + 1}") for j in range(k) for f in (F.min, F.max))).first()
    return df.withColumns({f"pc{j + 1}": (F.col(f"pc{j + 1}") - ends[2 * j]) / max(ends[2 * j + 1] - ends[2 * j], EPS) for j in range(k)})
