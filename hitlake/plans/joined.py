"""Queries of stored tables, the feature matrix, summaries and whole catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as O
from ..operators import scoring as S
from ..operators.tables import combined_summary, feature_matrix, stored, with_flags
from ..sources.adapters import HITS_SQL, SCORES_SQL, hits, scores
from .catalogue import query
from .flagging import NEAR


@query("features_with_flags", f"""with {HITS_SQL}, c as (select file, row, "driftRate" = 0 as flag_zero_drift, snr < 10 as flag_low_snr, "driftRate" <> 0 and snr >= 10 as pass_all from hits)
select id, file, row, abs("driftRate") as abs_drift, flag_zero_drift, flag_low_snr, pass_all from hits join c using (file, row)""")
def _(spark, sf_dir):
    """Both tables are stored in buckets by (file, row), so the join has no exchange beneath it."""
    df = hits(spark, sf_dir)
    made = stored(df.select("id", "file", "row", F.abs("driftRate").alias("abs_drift")), ["file", "row"], buckets=8)
    flags = {"flag_zero_drift": F.col("driftRate") == 0, "flag_low_snr": F.col("snr") < 10}
    marked = df.withColumns(flags).withColumn("pass_all", ~F.col("flag_zero_drift") & ~F.col("flag_low_snr"))
    return with_flags(made, stored(marked.select("file", "row", *flags, "pass_all"), ["file", "row"], buckets=8))


def _wide(spark, sf_dir):
    value = F.when(F.col("id") % 50 != 0, F.col("snr"))
    return hits(spark, sf_dir).select("id", "file", F.col("frequency").alias("f_n"), value.alias("s_n"), F.abs("driftRate").alias("d_n"), "frequency", F.col("snr").alias("s"))


@query("feature_matrix", f"""with {HITS_SQL}, w as (select id, frequency as f_n, case when id % 50 <> 0 then snr end as s_n, abs("driftRate") as d_n from hits), good as (select * from w where s_n is not null),
q as (select quantile_cont(f_n, [0.25, 0.5, 0.75]) as f, quantile_cont(s_n, [0.25, 0.5, 0.75]) as s, quantile_cont(d_n, [0.25, 0.5, 0.75]) as d from good)
select id, s_n is not null as usable, {", ".join(f"case when s_n is not null then round(greatest(-5, least(5, ({c}_n - {c}[2]) / ({c}[3] - {c}[1]))), 6) end as {c}_s" for c in "fsd")} from w, q""")
def _(spark, sf_dir):
    got = feature_matrix(_wide(spark, sf_dir), ["f", "s", "d"])
    return got.rows.select("id", "usable", *(F.round(c, 6).alias(c) for c in got.space))


@query("combined_summary", f"""with {HITS_SQL}, w as (select case when id % 50 <> 0 then snr end as snr, frequency, case when id % 7 = 0 then -1 else id % 2 end as weak_label, obsid from hits),
f as (select 'feature' as part, 'snr' as name, count(snr) as n, 100.0 * count(snr) / count(*) as pct, quantile_cont(snr, [0.01, 0.5, 0.99]) as p from w union all select 'feature', 'frequency', count(frequency), 100.0 * count(frequency) / count(*), quantile_cont(frequency, [0.01, 0.5, 0.99]) from w)
select part, name, n, round(pct, 6)::double as pct, round(p[1], 6) as p1, round(p[2], 6) as p50, round(p[3], 6) as p99 from f
union all select 'label', case weak_label when 1 then 'rfi' when 0 then 'confined' else 'ambiguous' end, count(*), round(100.0 * count(*) / (select count(*) from w), 6)::double, null, null, null from w group by weak_label
union all select 'groups', 'obsid', count(distinct obsid), null, null, null, null from w union all select 'rows', 'all', count(*), null, null, null, null from w""")
def _(spark, sf_dir):
    df = hits(spark, sf_dir).select(F.when(F.col("id") % 50 != 0, F.col("snr")).alias("snr"), "frequency", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("id") % 2).alias("weak_label"), "obsid")
    return combined_summary(df, ["snr", "frequency"], "obsid").select("part", "name", "n", *(F.round(c, 6).alias(c) for c in ("pct", "p1", "p50", "p99")))


#: Every row of the three lists; beam counts are stretched, so that some hits contradict their label.
@query("catalogue_rows", f"""with {HITS_SQL}, {NEAR}, q as (select id, (id * 31 % 1000) / 1000.0::double as rfi_score, n_beams * 8 as n_beams, snr > 20 as pass_all from hits join beams using (id)),
v as (select id, n_beams, rfi_score, pass_all, case when rfi_score < 0.1 then 'shortlist' when rfi_score > 0.9 then 'pruned' else 'uncertain' end as verdict from q)
select 'candidates' as list, id, verdict, rfi_score from v where pass_all union all select 'contrarian', id, verdict, rfi_score from v where n_beams >= 32 and rfi_score < 0.1 union all select 'ambiguous', id, verdict, rfi_score from v where n_beams > 2 and n_beams < 32""")
def _(spark, sf_dir):
    df = O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1).select("id", (F.col("n_beams") * 8).alias("n_beams"), ((F.col("id") * 31 % 1000) / 1000.0).alias("rfi_score"), (F.col("snr") > 20).alias("pass_all"))
    lists = [rows.select(F.lit(name).alias("list"), "id", "verdict", "rfi_score") for name, rows in S.catalogues(df).items()]
    return lists[0].union(lists[1]).union(lists[2])


@query("decile_auc", f"""with {SCORES_SQL}, d as (select id, y, s, (id * 31 % 1000) / 1000.0::double as t from scored), e as (select [{", ".join(f"quantile_cont(s, {k / 10})" for k in range(11))}] as e from d),
b as (select d.*, case when s <= e[1] then 0 else len(list_filter(list_distinct(e), lambda x: x < s)) - 1 end::int as bin from d, e), r as (select *, rank() over (partition by bin order by t) + count(*) over (partition by bin, t) / 2.0 - 0.5 as k from b)
select bin, count(*) as n, min(s) as low, max(s) as high, round(avg(y), 9) as base_rate, round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 9)::double as auc from r group by 1""")
def _(spark, sf_dir):
    df = scores(spark, sf_dir).withColumn("t", (F.col("id") * 31 % 1000) / 1000.0)
    return S.deciles(df, "s", "y", "t").select("bin", "n", "low", "high", F.round("base_rate", 9).alias("base_rate"), F.round("auc", 9).alias("auc"))
