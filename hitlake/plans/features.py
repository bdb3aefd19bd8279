"""Queries of the array features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import registry as R
from ..sources.adapters import HITS_SQL, SPECTRA_SQL, cubes, hits, spectra
from .catalogue import query

C, DF = 64, 1.5
r6 = lambda c: F.round(c, 6)

MOMENTS = f"""{SPECTRA_SQL}, means as (select *, list_avg(v) as m, len(v)::double as n from spectra),
mom as (select id, v, m, list_sum(list_transform(v, lambda x: (x - m) ** 2)) / n as m2, list_sum(list_transform(v, lambda x: (x - m) ** 3)) / n as m3, list_sum(list_transform(v, lambda x: (x - m) ** 4)) / n as m4 from means)"""
CUBE = f"{SPECTRA_SQL}, cube as (select id, list_transform(range(8), lambda t: v[t * 8 + 1 : t * 8 + 8]) as img from spectra)"


@query("spectral_moments", f"with {MOMENTS} select id, round(m3 / m2 ** 1.5, 6) as skew, round(m4 / m2 ** 2, 6) as kurt, round(((m3 / m2 ** 1.5) ** 2 + 1) / (m4 / m2 ** 2), 6) as bimodality from mom")
def _(spark, sf_dir):
    m = F.col("m")
    got = spectra(spark, sf_dir).select("id", A.moments(F.col("v")).alias("m")).select("id", A.skewness(m).alias("s"), A.kurtosis(m).alias("k"))
    return got.select("id", r6("s").alias("skew"), r6("k").alias("kurt"), r6(A.bimodality(F.col("s"), F.col("k"))).alias("bimodality"))


@query("temporal_skew", f"""with {CUBE}, ts as (select id, list_transform(img, lambda r: list_avg(r)) as s from cube), c as (select id, list_transform(s, lambda x: x - list_avg(s)) as d from ts)
select id, round(list_avg(list_transform(d, lambda x: x ** 3)) / list_avg(list_transform(d, lambda x: x ** 2)) ** 1.5, 6) as f09_temporal_skew from c""")
def _(spark, sf_dir):
    return cubes(spark, sf_dir).select("id", r6(A.let(A.moments(A.time_series(F.col("img"))), A.skewness)).alias("f09_temporal_skew"))


@query("relative_std", f"with {MOMENTS} select id, round(sqrt(m2) / abs(m), 4) as relative_std from mom where abs(m) > 0.001")
def _(spark, sf_dir):
    got = spectra(spark, sf_dir).select("id", A.moments(F.col("v")).alias("m")).where(F.abs("m.mean") > 0.001)
    return got.select("id", F.round(A.relative_std(F.col("m")), 4).alias("relative_std"))


@query("bandwidth_1pct", f"""with {SPECTRA_SQL}, z as (select id, list_transform(v, lambda x: x - list_median(v)) as z from spectra),
p as (select *, list_max(z) as peak, list_position(z, list_max(z)) as j, list_filter(range(1, len(z) + 1), lambda i: z[i] < 0.01 * list_max(z)) as below from z),
e as (select id, z, coalesce(list_max(list_filter(below, lambda i: i < j)), 0) as lo, coalesce(list_min(list_filter(below, lambda i: i > j)), len(z) + 1) as hi from p)
select id, (hi - lo - 1)::double * {DF} as f12_bandwidth_hz, (lo = 0 or hi = len(z) + 1) as saturated from e""")
def _(spark, sf_dir):
    got = spectra(spark, sf_dir).select("id", A.peak_run(F.col("v")).alias("r"))
    return got.select("id", (F.col("r.width") * DF).alias("f12_bandwidth_hz"), F.col("r.saturated").alias("saturated"))


SWEEP = A.widths(C)
LOGS = "[" + ", ".join(f"{math.log10(w * DF)!r}::double" for w in SWEEP) + "]"
KURTS = "[" + ", ".join(f"v[{max(0, C // 2 - w // 2) + 1} : {max(0, C // 2 - w // 2) + w}]" for w in SWEEP) + "]"


@query("kurtosis_sweep", f"""with {SPECTRA_SQL}, parts as (select id, {KURTS} as p, {LOGS} as g from spectra),
d as (select id, g, list_transform(p, lambda s: list_transform(s, lambda x: x - list_avg(s))) as d from parts),
k as (select id, g, list_transform(d, lambda s: list_avg(list_transform(s, lambda x: x ** 4)) / list_avg(list_transform(s, lambda x: x ** 2)) ** 2) as k from d),
m as (select *, list_avg(k) as mk, list_avg(g) as mg, list_position(k, list_max(k)) as j, len(k) as n from k),
c as (select *, least(greatest(j, 2), n - 1) as c from m),
v as (select *, k[c - 1] - 2 * k[c] + k[c + 1] as bend from c),
x as (select *, case when j = 1 or j = n then g[j] else least(greatest(g[c] + case when abs(bend) > 1e-30 then 0.5 * (k[c - 1] - k[c + 1]) / bend else 0 end * (g[c + 1] - g[c]), g[1]), g[n]) end as vertex from v)
select id, round(list_sum(list_transform(range(1, n + 1), lambda i: (k[i] - mk) * (g[i] - mg))) / sqrt(list_sum(list_transform(k, lambda y: (y - mk) ** 2)) * list_sum(list_transform(g, lambda y: (y - mg) ** 2))), 6) as corr,
  round(10 ** vertex, 5) as turning_hz, j >= n as saturated from x""")
def _(spark, sf_dir):
    got = spectra(spark, sf_dir).select("id", A.kurtosis_sweep(F.col("v"), C, DF).alias("s"))
    return got.select("id", r6("s.corr").alias("corr"), F.round("s.turning_hz", 5).alias("turning_hz"), F.col("s.saturated").alias("saturated"))


POWERS = "[" + ", ".join(
    "list_sum(list_transform(range(64), lambda t: v[t + 1] * cos(2 * pi() * {k} * t / 64))) ** 2 + list_sum(list_transform(range(64), lambda t: v[t + 1] * sin(2 * pi() * {k} * t / 64))) ** 2".format(k=k) for k in range(1, 7)
) + "]"


@query("redness", f"with {SPECTRA_SQL}, p as (select id, {POWERS} as p from spectra) select id, round((p[1] + p[2] + p[3]) / (p[4] + p[5] + p[6]), 5) as f13_redness from p")
def _(spark, sf_dir):
    return spectra(spark, sf_dir).select("id", F.round(A.redness(F.col("v"), C), 5).alias("f13_redness"))


@query("drift_residual", f"""with {CUBE}, pk as (select id, list_transform(img, lambda r: (list_position(r, list_max(r)) - 1)::double) as pk from cube),
b as (select id, pk, list_avg(pk) as m, list_sum(list_transform(range(8), lambda t: (pk[t + 1] - list_avg(pk)) * (t - 3.5))) / 42.0 as b from pk)
select id, round(sqrt(list_avg(list_transform(range(8), lambda t: (pk[t + 1] - m - b * (t - 3.5)) ** 2))), 6) as x01_drift_residual from b""")
def _(spark, sf_dir):
    return cubes(spark, sf_dir).select("id", r6(A.drift_residual(F.col("img"))).alias("x01_drift_residual"))


@query("time_occupancy", f"with {CUBE}, mx as (select id, list_transform(img, lambda r: list_max(r)) as mx from cube) select id, len(list_filter(mx, lambda x: x >= 0.5 * list_max(mx)))::double / len(mx) as x02_time_occupancy from mx")
def _(spark, sf_dir):
    return cubes(spark, sf_dir).select("id", A.time_occupancy(F.col("img")).alias("x02_time_occupancy"))


@query("channel_offset", f'with {HITS_SQL} select id, least(greatest(("index" - "startChannel")::double / "numChannels", 0), 1) as x03_channel_offset from hits')
def _(spark, sf_dir):
    return R.with_catalogue_features(hits(spark, sf_dir)).select("id", "x03_channel_offset")


PADDED = f"{SPECTRA_SQL}, padded as (select id, (8 + id % 8)::int as n, list_transform(range(8), lambda t: list_concat(list_transform(range(16 - 8 - (id % 8)::int), lambda i: -1.0::double), list_concat(v[t * 8 + 1 : t * 8 + 8], list_transform(range((id % 8)::int), lambda i: v[i + 1])))) as img from spectra)"


@query("crop_fill", f"""with {PADDED}, s as (select id, img, greatest(16 - n, least(16 - n + n // 2 - 5, 6)) as a from padded),
w as (select id, list_transform(img, lambda r: r[a + 1 : a + 10]) as w from s), m as (select id, w, list_median(list_filter(flatten(w), lambda x: x <> -1)) as m from w)
select id, round(list_sum(list_transform(flatten(w), lambda x: case when x = -1 then m else x end)), 6) as total, len(flatten(w))::int as n, round(m, 9) as fill from m""")
def _(spark, sf_dir):
    extra = (F.col("id") % 8).cast("int")
    pad = F.array_repeat(F.lit(-1.0), 8 - extra)
    img = F.transform("img", lambda r: F.concat(pad, r, F.slice(F.flatten("img"), F.lit(1), extra)))
    got = cubes(spark, sf_dir).select("id", "img", A.crop_fill(img, 8 + extra, 10).alias("w"))
    flat = F.flatten("w")
    clean = F.filter(F.flatten(F.transform(img, lambda r: F.slice(r, F.greatest(8 - extra, F.least(8 - extra + F.floor((8 + extra) / 2).cast("int") - 5, F.lit(6))) + 1, 10))), lambda x: x != -1)
    return got.select("id", r6(A.total(flat)).alias("total"), F.size(flat).alias("n"), F.round(A.median(clean), 9).alias("fill"))


@query("noise_sigma", f"with {SPECTRA_SQL} select id, round(1.4826 * list_median(list_transform(v, lambda x: abs(x - list_median(v)))), 9) as sigma from spectra")
def _(spark, sf_dir):
    return cubes(spark, sf_dir).select("id", F.round(A.noise_sigma(F.col("img")), 9).alias("sigma"))


@query("all_features")
def _(spark, sf_dir):
    return R.with_cutout_features(cubes(spark, sf_dir), 8, DF).drop("img")
