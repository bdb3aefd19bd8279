"""Queries of injection, of streams and of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.registry import with_cutout_features
from ..operators import flags as O
from ..operators import injection as I
from ..operators import transforms as T
from ..operators.scoring import fold_models
from ..sources.adapters import HITS_SQL, SPECTRA_SQL, cubes, hits
from ..sources.files import health_of_ids
from ..shared import shared_dir
from ..streaming import flags as S
from .catalogue import query
from .flagging import FIRST

STEPS, DF, DT = 8, 1.5, 18.0
CUBE = f"{SPECTRA_SQL}, base as (select id, v, 1.4826 * list_median(list_transform(v, lambda x: abs(x - list_median(v)))) as sigma from spectra)"


def injected(spark, sf_dir, drift=0.1, snr=20.0, **options):
    return I.inject(cubes(spark, sf_dir).withColumn("numChannels", F.lit(8)), STEPS, DF, DT, snr=F.lit(snr), drift_hz_s=F.lit(drift), **options)


PROFILE = "list_transform(range(64), lambda i: exp(-0.5 * (((i % 8) - (3.5 + 0.1 * ((i // 8) - 3.5) * 18.0 / 1.5)) / 2.0) ** 2))"


@query("inject_amplitude", f"""with {CUBE}, p as (select {PROFILE} as g), a as (select id, v, sigma, g, 20.0 * sigma / sqrt(list_sum(list_transform(g, lambda x: x ** 2))) as amplitude from base, p)
select id, round(amplitude, 8) as amplitude, round(amplitude * list_sum(list_transform(range(8), lambda t: list_max(g[t * 8 + 1 : t * 8 + 8]))) / (sigma * sqrt(8)), 6) as dedoppler_snr,
  round(list_sum(list_transform(range(64), lambda i: v[i + 1] + amplitude * g[i + 1])), 6) as total from a""")
def _(spark, sf_dir):
    got = injected(spark, sf_dir)
    return got.select("id", F.round("amplitude", 8).alias("amplitude"), F.round("dedoppler_snr", 6).alias("dedoppler_snr"), F.round(A.total(F.flatten("img")), 6).alias("total"))


@query("inject_fluctuating")
def _(spark, sf_dir):
    return injected(spark, sf_dir, fluctuate=True).select("id", "amplitude", A.total(F.flatten("img")).alias("total"))


@query("inject_grid")
def _(spark, sf_dir):
    df = I.grid(cubes(spark, sf_dir).withColumn("numChannels", F.lit(8)), (5, 20), (0.0, 0.1))
    df = I.inject(df, STEPS, DF, DT, snr=F.col("inj_snr"), drift_hz_s=F.col("inj_drift"))
    return with_cutout_features(df, 8, DF).drop("img")


@query("normalise_like", f"""with {HITS_SQL}, k as (select file, snr as x, min((log10(snr) - lo) / (hi - lo)) as y from hits join (select file, log10(min(snr)) as lo, log10(max(snr)) as hi from hits group by 1) using (file) group by 1, 2),
n as (select id, file, snr * 1.1::double as x from hits), a as (select n.*, k.x as x0, k.y as y0 from n asof left join k on n.file = k.file and n.x >= k.x), b as (select a.*, k.x as x1, k.y as y1 from a asof left join k on a.file = k.file and a.x <= k.x)
select id, round(case when x0 is null then y1 when x1 is null or x1 = x0 then y0 else y0 + (x - x0) / (x1 - x0) * (y1 - y0) end, 6) as snr_n, (x0 is null or x1 is null)::int::double as out_of_range from b""")
def _(spark, sf_dir):
    known, _ = T.normalise(hits(spark, sf_dir).select("id", "file", "snr"), {"snr": "log-unit"})
    new = hits(spark, sf_dir).select("id", "file", (F.col("snr") * 1.1).alias("snr"))
    return T.normalise_like(known, new, ["snr"]).select("id", F.round("snr_n", 6).alias("snr_n"), "out_of_range")


@query("retention", f"""with {HITS_SQL}, c as (select h.id, s, d from hits h, (values (5.0::double, 0.0::double), (5, 0.1), (20, 0), (20, 0.1), (0, 0)) g(s, d)), r as (select s as inj_snr, d as inj_drift, ((id * 31 + s::bigint) % 1000) / 1000.0::double as x from c)
select inj_snr, inj_drift, count(*) as n, round(avg((x < 0.1)::int), 9) as frac_shortlist, round(avg((x > 0.9)::int), 9) as frac_pruned from r group by 1, 2""")
def _(spark, sf_dir):
    df = I.grid(hits(spark, sf_dir).select("id"), (5, 20), (0.0, 0.1)).withColumn("rfi_score", ((F.col("id") * 31 + F.col("inj_snr").cast("long")) % 1000) / 1000.0)
    return I.retention(df).select("inj_snr", "inj_drift", "n", F.round("frac_shortlist", 9).alias("frac_shortlist"), F.round("frac_pruned", 9).alias("frac_pruned"))


@query("substrates", f"with {HITS_SQL} select count(*) as n, max(snr) <= 60 as quiet from (select snr from hits where snr <= 60 limit 100)")
def _(spark, sf_dir):
    got = I.select_substrates(O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1), 100, 60.0)
    return got.agg(F.count("*").alias("n"), (F.max("snr") <= 60).alias("quiet"))


@query("stream_flags", f'with {HITS_SQL} select id, {FIRST} as rfi_band_label, "driftRate" = 0 as flag_zero_drift, snr > 200 as flag_snr_high from hits')
def _(spark, sf_dir):
    return S.drain(S.stateless(_stream(spark, sf_dir), snr_max=200.0), shared_dir(spark)).select("id", "rfi_band_label", "flag_zero_drift", "flag_snr_high")


@query("stream_persistence", f"""with {HITS_SQL}, t as (select h.*, r.ts from hits h join raw r on r.event_id = h.id) select time_bucket(interval 7 days, ts, timestamp '1970-01-01') as start, round_even(frequency * 1e6 / 1e7, 0)::bigint as f_bin, count(*) as n_hits, count(distinct obsid)::int as n_obs from t group by 1, 2""")
def _(spark, sf_dir):
    return S.drain(S.persistence(_stream(spark, sf_dir), window="7 days", tol_hz=1e7), shared_dir(spark), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: As above, but only the windows that the watermark has closed, each once: state doesn't outlive them.
@query("stream_persistence_closed", f"""with {HITS_SQL}, t as (select h.*, r.ts from hits h join raw r on r.event_id = h.id), w as (select time_bucket(interval 7 days, ts, timestamp '1970-01-01') as start, round_even(frequency * 1e6 / 1e7, 0)::bigint as f_bin, count(*) as n_hits, count(distinct obsid)::int as n_obs from t group by 1, 2)
select * from w where start + interval 7 days <= (select max(ts) from t) - interval 1 hour""")
def _(spark, sf_dir):
    return S.drain(S.persistence(_stream(spark, sf_dir), window="7 days", tol_hz=1e7), shared_dir(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _stream(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A path that names the one table lets a stream of files read it.
    raw = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("obsid"), (700.0 + F.col("value") * 5.0).alias("frequency"), (F.col("k") % 9 - 4).alias("driftSteps"), ((F.col("k") % 9 - 4) * F.lit(0.01)).alias("driftRate"), (F.col("value") + 6.0).alias("snr"), (14 + F.col("k") % 46).alias("numTimesteps"))


@query("id_surplus", "select count(*) as n_rows, count(distinct l_orderkey) as n_ids, count(*) - count(distinct l_orderkey) as n_surplus from lineitem")
def _(spark, sf_dir):
    return health_of_ids(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("id", F.col("l_orderkey")))


@query("injection_run")
def _(spark, sf_dir):
    """Vectors as cutouts of the hits of the same number; two features, five folds."""
    raw = ["f04_spectral_skew", "x02_time_occupancy"]
    cut = cubes(spark, sf_dir).select("id", "img")
    df = O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1).join(cut, "id").withColumns({"numChannels": F.lit(8), "group_id": F.col("obsid"), "weak_label": F.when(F.col("n_beams") >= 4, 1).when(F.col("n_beams") <= 2, 0).otherwise(-1)})
    stored = T.normalise(with_cutout_features(df, 8, DF).drop("img"), {c: "unit" for c in raw})[0]
    models, folds = fold_models(stored, [f"{c}_n" for c in raw], n_splits=5, n_seeds=3, max_iter=300)
    got = I.run(df, stored, models, folds, raw, steps=STEPS, channels=8, df_hz=DF, dt_s=DT, n_per_class=40, classes={"single": (1, 2), "more": (3, 64)}, snrs=(10, 100), drifts=(0.0, 0.1), max_snr=1e3)
    return got.select("id", "substrate_class", "kind", "inj_snr", "inj_drift", "rfi_score", "stored_score", "frac_out_of_range", "fold_used")
