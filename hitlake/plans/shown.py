"""Queries of what is shown: selections, cutouts for display, summaries of clustering runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import clusters as C
from ..operators import explore as E
from ..operators import flags as O
from ..sources.adapters import GIVEN_SQL, HITS_SQL, SPECTRA_SQL, cubes, given_clusters, hits
from .catalogue import query
from .flagging import NEAR

LISTS = {"snr": ("snr", "true"), "drift": ('abs("driftRate")', "true"), "nonzero-drift": ("snr", '"driftRate" <> 0')}


@query("explore_selections", f"with {HITS_SQL} " + " union all ".join(f"select * from (select '{name}' as list, id from hits where {kept} order by {by} desc, id limit 20)" for name, (by, kept) in LISTS.items()))
def _(spark, sf_dir):
    out = None
    for name in LISTS:
        part = E.selection(hits(spark, sf_dir), 20, name).select(F.lit(name).alias("list"), "id")
        out = part if out is None else out.union(part)
    return out


@query("explore_rows", f"with {HITS_SQL} select h.id from hits h where \"row\" in (select distinct \"row\" from hits where id % 7 = 3 order by 1 limit 50)")
def _(spark, sf_dir):
    df = hits(spark, sf_dir)
    return E.chosen(df, df.where("id % 7 = 3").select("row"), 50).select("id")


#: The first channels of a vector are made padding, as many as its label modulo 4 says.
@query("stamps_shown", f"""with {SPECTRA_SQL}, p as (select id, label % 4 as pad, list_transform(v, lambda x, i: case when (i - 1) % 8 < label % 4 then -1.0::double else abs(x) end) as v from spectra),
c as (select id, pad, list_filter(v, lambda x, i: (i - 1) % 8 >= pad) as v from p), m as (select *, list_median(v) as m from c)
select id, (8 - pad)::int as n_valid, round(list_sum(list_transform(v, lambda x: greatest(x / m, 1e-3))), 6) as total from m""")
def _(spark, sf_dir):
    padded = F.transform("img", lambda r: F.transform(r, lambda x, i: F.when(i < F.col("label") % 4, -1.0).otherwise(F.abs(x))))
    got = cubes(spark, sf_dir).withColumn("img", padded).withColumn("c", E.clean_stamp(F.col("img")))
    return got.select("id", F.col("c.n_valid").alias("n_valid"), F.round(A.total(F.flatten(E.norm_stamp(F.col("c.img")))), 6).alias("total"))


@query("run_summary", f"""with {GIVEN_SQL}, {NEAR}, s as (select cluster, count(*) as n, (1 + cluster % 3)::int as epoch, (cluster % 2)::int as batch, 100 * avg((n_beams >= 4)::int) as rfi_pct, median(frequency) as freq, max(frequency) - min(frequency) as span, median(snr) as snr, median(n_beams)::double as beams, count(distinct obsid) as obs
  from given join beams using (id) group by cluster)
select cluster, n, epoch, batch, round(rfi_pct, 6) as rfi_pct, freq, span, snr, beams, obs, row_number() over (order by n desc, cluster) - 1 as rank, row_number() over (order by n desc, cluster) <= 4 as coloured from s""")
def _(spark, sf_dir):
    near = O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1).select("id", "n_beams")
    df = given_clusters(spark, sf_dir).join(near, "id").withColumns({"epoch": 1 + F.col("cluster") % 3, "batch": F.col("cluster") % 2, "weak_label": F.when(F.col("n_beams") >= 4, 1).otherwise(0)})
    return C.size_rank(C.run_summary(df), 4).withColumn("rfi_pct", F.round("rfi_pct", 6))
