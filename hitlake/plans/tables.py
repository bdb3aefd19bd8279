"""Queries of transforms, duplicates and catalogue summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe as D
from ..operators import flags as O
from ..operators import transforms as T
from ..operators.transforms import distance_share
from ..operators.weights import equalise
from ..sources.adapters import HITS_SQL, SPECTRA_SQL, hits, spectra
from .catalogue import query
from .flagging import NEAR

COLS = ["frequency", "snr", "driftRate", "incoherentPower"]


@query("robust_scale", f"""with {HITS_SQL}, s as (select quantile_cont(snr, 0.5) as ms, quantile_cont(snr, 0.75) - quantile_cont(snr, 0.25) as qs, quantile_cont(frequency, 0.5) as mf, quantile_cont(frequency, 0.75) - quantile_cont(frequency, 0.25) as qf from hits)
select id, round(least(5, greatest(-5, (snr - ms) / qs)), 8) as snr_s, round(least(5, greatest(-5, (frequency - mf) / qf)), 8) as frequency_s from hits, s""")
def _(spark, sf_dir):
    got = T.scale(hits(spark, sf_dir), ["snr", "frequency"])
    return got.select("id", F.round("snr_s", 8).alias("snr_s"), F.round("frequency_s", 8).alias("frequency_s"))


@query("minmax_norm", f"with {HITS_SQL} select id, round((frequency - min(frequency) over (partition by file)) / (max(frequency) over (partition by file) - min(frequency) over (partition by file)), 9) as frequency_n from hits")
def _(spark, sf_dir):
    return T.normalise(hits(spark, sf_dir), {"frequency": "unit"})[0].select("id", F.round("frequency_n", 9).alias("frequency_n"))


@query("log_minmax", f"""with {HITS_SQL}, l as (select id, file, case when "incoherentPower" > 0 then log10("incoherentPower") end as p from hits)
select id, round((p - min(p) over (partition by file)) / (max(p) over (partition by file) - min(p) over (partition by file)), 9) as p_n from l""")
def _(spark, sf_dir):
    return T.normalise(hits(spark, sf_dir), {"incoherentPower": "log-unit"})[0].select("id", F.round("incoherentPower_n", 9).alias("p_n"))


@query("unit_max", f'with {HITS_SQL} select id, round("driftRate" / max(abs("driftRate")) over (partition by file), 9) as d_n from hits')
def _(spark, sf_dir):
    return T.normalise(hits(spark, sf_dir), {"driftRate": "unit-max"})[0].select("id", F.round("driftRate_n", 9).alias("d_n"))


@query("quantile_uniform", f"""with {HITS_SQL}, e as (select * from hits where id < 1000), r as (select id, (rank() over (order by snr) + count(*) over (order by snr) - 2) / 2.0 / (count(*) over () - 1) as p from e)
select id, round(p, 9) as snr_n from r""")
def _(spark, sf_dir):
    few = hits(spark, sf_dir).where("id < 1000")  # as many rows as quantiles, for which the place is a tie-averaged rank
    return T.normalise(few, {"snr": "quantile-uniform"}, by=[])[0].select("id", F.round("snr_n", 9).alias("snr_n"))


@query("quantile_normal")
def _(spark, sf_dir):
    return T.normalise(O.derived(hits(spark, sf_dir)), {"abs_drift": "quantile-normal"})[0].select("id", "abs_drift_n")


@query("equalising_weights", f"""with {HITS_SQL}, s as (select 1 / stddev_pop(frequency) as f, 1 / stddev_pop(snr) as s, 1 / stddev_pop("driftRate") as d from hits), w as (select *, (f + s + d) / 3 as m from s)
select 'frequency' as feature, round(least(5, f / m), 9) as weight from w union all select 'snr', round(least(5, s / m), 9) from w union all select 'driftRate', round(least(5, d / m), 9) from w""")
def _(spark, sf_dir):
    w = T.equalising_weights(hits(spark, sf_dir), COLS[:3], {})
    return spark.createDataFrame(list(w.items()), "feature string, weight double").select("feature", F.round("weight", 9).alias("weight"))


#: A capped and a free column, a boolean and a constant one, which stay at 1; and how far parts of distances are from equal ones.
@query("equalising_weights_capped", f"""with {HITS_SQL}, s as (select unnest([{{'feature': 'frequency', 'd': stddev_pop(frequency), 'free': true}}, {{'feature': 'snr', 'd': stddev_pop(snr), 'free': true}}, {{'feature': 'driftRate', 'd': stddev_pop("driftRate"), 'free': true}},
  {{'feature': 'even', 'd': stddev_pop((id % 2 = 0)::int), 'free': false}}, {{'feature': 'one', 'd': 0.0, 'free': false}}], recursive := true) from hits),
w as (select feature, d, case when free then greatest(0.5, least(2.0, 1 / d / avg(1 / d) filter (free) over ())) else 1.0 end as w from s),
p as (select *, (w * d) ** 2 / sum((w * d) ** 2) over () as share from w)
select feature, round(w, 9) as weight, round(max(abs(case when share > 1e-9 then share * 5 - 1 else 0 end)) over (), 6) as max_dev_global from p""")
def _(spark, sf_dir):
    df = hits(spark, sf_dir).select("id", *COLS[:3], (F.col("id") % 2 == 0).cast("double").alias("even"), F.lit(1.0).alias("one"))
    got = equalise(df, [*COLS[:3], "even", "one"], {"even": "boolean"}, cap=2.0)
    off = distance_share(df.select(*((F.col(c) * w).alias(c) for c, w in got.by_column.items())), list(got.by_column)).agg(F.max(F.when(F.col("share") > 1e-9, F.abs(F.col("share") * 5 - 1)).otherwise(0.0)).alias("off"))
    return spark.createDataFrame(list(got.by_column.items()), "feature string, weight double").crossJoin(off).select("feature", F.round("weight", 9).alias("weight"), F.round("off", 6).alias("max_dev_global"))


@query("distance_share", f"""with {HITS_SQL}, s as (select var_pop(frequency) as f, var_pop(snr) as s, var_pop("driftRate") as d from hits)
select 'frequency' as feature, round(f / (f + s + d), 9) as share from s union all select 'snr', round(s / (f + s + d), 9) from s union all select 'driftRate', round(d / (f + s + d), 9) from s""")
def _(spark, sf_dir):
    return T.distance_share(hits(spark, sf_dir), COLS[:3]).select("feature", F.round("share", 9).alias("share"))


@query("principal_components")
def _(spark, sf_dir):
    got = spectra(spark, sf_dir).select("id", *(F.col("v")[k].alias(f"c{k}") for k in range(64)))
    return T.principal_components(got, [f"c{k}" for k in range(64)]).select("id", "pc1", "pc2")


@query("dedupe_by_id", """with s as (select l_returnflag, count(*) as n from lineitem group by 1), r as (select l.*, row_number() over (partition by l_orderkey, l_linenumber order by n desc, l.l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as k from lineitem l join s using (l_returnflag))
select l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_quantity from r where k = 1""")
def _(spark, sf_dir):
    got = D.deduplicate(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], "l_returnflag", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return got.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity")


TWINS = HITS_SQL + """, twins as (select id, case when beam % 2 = 0 then 'f' || id % 3 else 'f' || id % 3 || '_clean' end as file, snr > 50 as feature_ok from hits)"""


@query("drop_superseded", f"""with {TWINS}, g as (select file, count(*) filter (feature_ok) as good from twins group by 1), l as (select case when b.good > a.good then a.file else b.file end as file from g a join g b on b.file = a.file || '_clean')
select id, file, feature_ok from twins where file not in (select file from l)""")
def _(spark, sf_dir):
    name = F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.when(F.col("beam") % 2 == 0, "").otherwise("_clean"))
    return D.drop_superseded(hits(spark, sf_dir).select("id", name.alias("file"), (F.col("snr") > 50).alias("feature_ok")))


@query("feature_health", "with " + HITS_SQL + " " + " union all ".join(f"""select '{c}' as feature, 100.0::double * count("{c}") / count(*) as pct_finite, round(quantile_cont("{c}", 0.01), 6) as p1, round(quantile_cont("{c}", 0.5), 6) as p50, round(quantile_cont("{c}", 0.99), 6) as p99 from hits""" for c in COLS[:3]))
def _(spark, sf_dir):
    return D.feature_health(hits(spark, sf_dir), COLS[:3]).select("feature", "pct_finite", *(F.round(p, 6).alias(p) for p in ("p1", "p50", "p99")))


@query("file_info", f"""with {HITS_SQL} select file, count(*) as n, min("numTimesteps") as min_timesteps, max("numTimesteps") as max_timesteps, min(snr) as min_snr, max(snr) as max_snr, median(snr) as median_snr, max(abs("driftRate")) as max_abs_drift,
  100.0::double * count(*) filter ("driftRate" = 0) / count(*) as pct_zero_drift, count(distinct obsid) as n_obs, count(distinct "sourceName") as n_sources, count(distinct beam) as n_beams, count(*) filter ("incoherentPower" <> 0) = 0 as incoherent_all_zero from hits group by file""")
def _(spark, sf_dir):
    return D.file_info(hits(spark, sf_dir))


@query("coincidence_table", f"with {HITS_SQL}, {NEAR} " + " union all ".join(f'select {k}::int as max_beams, count(*) filter (n_beams <= {k}) as n_hits, count(*) filter (n_beams <= 2 and "driftRate" <> 0) as drifting from beams join hits using (id)' for k in (1, 2, 4, 8, 16, 32)))
def _(spark, sf_dir):
    return D.coincidence_table(O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1, "nb"), max_beams=2)


@query("beams_formed", f"""with {HITS_SQL}, b as (select obsid, beam, count(distinct "sourceName") as s, sum(ra) as ra, sum(dec) as dec, count(*) as n from hits group by 1, 2)
select obsid, (max(beam) + 1)::int as n_formed, count(*) as n_seen, max(s) <= 1 as one_source_a_beam, max(beam) - min(beam) + 1 = count(*) as contiguous, sum(ra)::double / sum(n)::double as mean_ra, sum(dec)::double / sum(n)::double as mean_dec from b group by 1""")
def _(spark, sf_dir):
    return D.beams_formed(hits(spark, sf_dir))


@query("beam_occupancy", f"""with {HITS_SQL}, c as (select obsid, beam, count(*) as n from hits group by 1, 2) select obsid, beam::int as beam, n from c""")
def _(spark, sf_dir):
    return D.occupancy(hits(spark, sf_dir)).select("obsid", F.posexplode("hits").alias("beam", "n")).where("n > 0")


@query("snr_histogram", f"with {HITS_SQL} select (case when snr = 300 then 119 else floor((snr - 0) / 2.5) end)::int as bin, count(*) as n from hits where snr between 0 and 300 group by 1")
def _(spark, sf_dir):
    return D.histogram(hits(spark, sf_dir), "snr", 0.0, 300.0, 120)
