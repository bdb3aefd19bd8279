"""Queries of labelling quality and of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import flags as O
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import transforms as T
from ..operators.neighbours import nearest, vectors
from ..shared import saved
from ..sources.adapters import GIVEN_SQL, HITS_SQL, SCORES_SQL, given_clusters, hits, scores
from .catalogue import query
from .flagging import NEAR, flagged


@query("adjusted_rand", f"""with {GIVEN_SQL}, c as (select cluster, family, count(*) as n from given group by 1, 2), s as (select sum(n * (n - 1) / 2.0) as s, sum(n) as n from c),
a as (select sum(n * (n - 1) / 2.0) as s from (select sum(n) as n from c group by cluster)), b as (select sum(n * (n - 1) / 2.0) as s from (select sum(n) as n from c group by family))
select round((s.s - a.s * b.s / (s.n * (s.n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (s.n * (s.n - 1) / 2.0)), 9)::double as ari from s, a, b""")
def _(spark, sf_dir):
    return Q.adjusted_rand(given_clusters(spark, sf_dir), "cluster", "family").select(F.round("ari", 9).alias("ari"))


@query("bh_step_up", f"""with {SCORES_SQL}, p as (select id, (id * 7919 % 1000 + 1) / 20000.0 as p, row_number() over (order by (id * 7919 % 1000 + 1) / 20000.0, id) as i, count(*) over () as m from scored)
select id, i <= coalesce((select max(i) from p where p <= i / m::double * 0.05), 0) as significant from p""")
def _(spark, sf_dir):
    tests = scores(spark, sf_dir).select("id", ((F.col("id") * 7919 % 1000 + 1) / 20000.0).alias("p"))
    return Q.step_up(tests, "p").select("id", "significant")


#: Every component of the vectors.
DEEP = 64
KNN_SQL = """d as (select a.id, b.id as o, list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2) as d from zz a join zz b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by list_sum(d), o) as k from d), s as (select unnest(d) as d, unnest(range(1, len(d) + 1)) as j from r where k <= 8), near as (select j, sum(d) as s from s group by j)"""


def components(spark, sf_dir, *more):
    """(id, c0 to c63) of the vectors, each component cast by itself."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(f"c{k}") for k in range(DEEP)), *more)


@query("knn_share", f"""with zz as (select vec_id as id, embedding::double[] as z from embeddings), {KNN_SQL} select 'c' || (j - 1) as feature, round(s / (select sum(s) from near), 6) as share from near""")
def _(spark, sf_dir):
    return Q.knn_share(components(spark, sf_dir), [f"c{k}" for k in range(DEEP)]).select("feature", F.round("share", 6).alias("share"))


#: Rows whose id is divisible by 20 ask; all rows answer. Cells are small, so that the index has many.
@query("nearest_rows", f"""with zz as (select vec_id as id, embedding::double[] as z from embeddings), d as (select a.id, b.id as o, list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2)) as far from zz a join zz b on a.id <> b.id where a.id % 20 = 0),
r as (select *, row_number() over (partition by id order by far, o) as k from d) select id as query, o as other, round(far, 6) as far, k::int as rank from r where k <= 8""")
def _(spark, sf_dir):
    rows = saved(vectors(components(spark, sf_dir), [f"c{k}" for k in range(DEEP)], "id"), "vectors")
    asked = rows.where("key % 20 = 0").toPandas()
    return nearest(rows, (asked.key.to_numpy(), np.array(asked.v.tolist())), 8, cell=64).select("query", "other", F.round("far", 6).alias("far"), "rank")


#: All components and the label, as an ordinal column, robustly scaled.
@query("column_audit", f"""with v as (select vec_id as id, list_append(embedding::double[], label::double) as v from embeddings), l as (select id, unnest(v) as x, unnest(range(1, {DEEP + 2})) as j from v),
q as (select j, quantile_cont(x, 0.5) as m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from l group by j), z as (select id, j, x, iqr, (x - m) / iqr as raw, least(5, greatest(-5, (x - m) / iqr)) as z from l join q using (j)),
zz as (select id, list(z order by j) as z from z group by id), {KNN_SQL},
far as (select j, var_pop(z) as s from z group by j), t as (select j, x, count(*) as k from l group by 1, 2), ties as (select j, count(*) as n_distinct, max(k)::double as most, arg_min(x, struct_pack(a := -k, b := x)) as tie_value from t group by j),
f as (select j, count(*) as n, avg((abs(raw) >= 5)::int) as clip_frac, max(iqr) as iqr, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) as iqr_scaled from z group by j),
a as (select case when j = {DEEP + 1} then 'label' else 'c' || (j - 1) end as feature, case when j = {DEEP + 1} then 'ordinal' else 'continuous' end as kind, n_distinct, most / n as tie_frac, tie_value, iqr, iqr_scaled, clip_frac,
  far.s / (select sum(s) from far) as share_global, near.s / (select sum(s) from near) as share_knn, 1 / {DEEP + 1}.0::double as equal_share from ties join f using (j) join far using (j) join near using (j))
select feature, kind, n_distinct, tie_frac, round(tie_value, 6) as tie_value, round(iqr, 6) as iqr, round(iqr_scaled, 6) as iqr_scaled, round(clip_frac, 9) as clip_frac, 1.0::double as weight, round(share_global, 6) as share_global, round(share_knn, 6) as share_knn, equal_share,
  concat_ws(',', case when tie_frac > 0.10 then 'tie' end, case when clip_frac > 0.01 then 'clip' end, case when share_knn > 2 * equal_share then 'share-high' when share_knn < 0.5 * equal_share then 'share-low' end,
    case when share_global / share_knn >= 2.5 or share_global / share_knn <= 1 / 2.5 then 'share-disagree' end) as flags from a""")
def _(spark, sf_dir):
    columns = [f"c{k}" for k in range(DEEP)]
    df = components(spark, sf_dir, F.col("label").cast("double").alias("label"))
    got = Q.column_audit(df, [*columns, "label"], {"label": "ordinal"})
    return got.select("feature", "kind", "n_distinct", "tie_frac", *(F.round(c, 6).alias(c) for c in ("tie_value", "iqr", "iqr_scaled")), F.round("clip_frac", 9).alias("clip_frac"), "weight", *(F.round(c, 6).alias(c) for c in ("share_global", "share_knn")), "equal_share", "flags")


@query("cluster_quality")
def _(spark, sf_dir):
    df = O.weak_labels(O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1, asked=given_clusters(spark, sf_dir)), 4, 1)
    got = Q.quality(df, (1000.0, 2400.0), n_perm=5)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items() if not isinstance(v, dict)], "measure string, value double")


#: Given clusters with a label by frequency, so that some clusters have more clean hits than others.
LABELS_SQL = f"{GIVEN_SQL}, labelled as (select id, cluster, family, case when id % 5 = 0 then -1 when id % 3 = 0 or cluster in (2, 5) then 0 else 1 end as weak_label from given)"


def clean_and_not(spark, sf_dir):
    label = F.when(F.col("id") % 5 == 0, -1).when((F.col("id") % 3 == 0) | F.col("cluster").isin(2, 5), 0).otherwise(1)
    return given_clusters(spark, sf_dir).select("id", "cluster", "family", label.alias("weak_label"))


#: Binomial coefficients by logarithms; every term of each tail.
@query("enriched_clusters", f"""with {LABELS_SQL}, w as (select count(*) filter (weak_label <> -1) as pop, count(*) filter (weak_label = 0) as marked from labelled),
c as (select cluster, count(*) as n, count(*) filter (weak_label <> -1) as known, count(*) filter (weak_label = 0) as clean from labelled where cluster >= 0 group by 1),
t as (select c.*, pop, marked, unnest(range(greatest(clean, known - (pop - marked)), least(known, marked) + 1)) as i from c, w where known > 0),
p as (select cluster, n, known, clean, least(1, sum(exp(lgamma(marked + 1) - coalesce(lgamma(i + 1), 0) - lgamma(marked - i + 1) + lgamma(pop - marked + 1) - lgamma(known - i + 1) - lgamma(pop - marked - known + i + 1)
  - lgamma(pop + 1) + lgamma(known + 1) + lgamma(pop - known + 1)))) as p from t group by 1, 2, 3, 4),
r as (select *, row_number() over (order by p, cluster) as i, count(*) over () as m from p)
select cluster, n, known, clean, round(p, 9) as p, i <= coalesce((select max(i) from r where p <= i / m::double * 0.05), 0) as significant from r""")
def _(spark, sf_dir):
    return Q.enriched(clean_and_not(spark, sf_dir)).select("cluster", "n", "known", "clean", F.round("p", 9).alias("p"), "significant")


@query("adjusted_mutual_information", f"""with {LABELS_SQL}, c as (select cluster as a, weak_label as b, count(*) as n from labelled where weak_label <> -1 group by 1, 2), a as (select a, sum(n)::bigint as x from c group by 1), b as (select b, sum(n)::bigint as y from c group by 1), w as (select sum(n)::bigint as n from c),
mi as (select sum(c.n / w.n::double * ln(w.n::double * c.n / (x * y))) as v from c join a using (a) join b using (b), w), h as (select (select -sum(x / w.n::double * ln(x / w.n::double)) from a, w) as ha, (select -sum(y / w.n::double * ln(y / w.n::double)) from b, w) as hb),
k as (select x, y, w.n, unnest(range(greatest(1, x + y - w.n), least(x, y) + 1)) as k from a, b, w),
e as (select sum(k / n::double * ln(n::double * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) as v from k)
select round((mi.v - e.v) / ((ha + hb) / 2 - e.v), 7) as ami from mi, e, h""")
def _(spark, sf_dir):
    found = Q.adjusted_mutual_information(clean_and_not(spark, sf_dir).where("weak_label <> -1"), "cluster", "weak_label")
    return spark.createDataFrame([(found,)], "ami double").select(F.round("ami", 7).alias("ami"))


RANKED = f"{SCORES_SQL}, r as (select y, grp, (rank() over (order by s) + count(*) over (partition by s) / 2.0 - 0.5) as k from scored)"


@query("roc_auc", f"with {RANKED} select round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9)::double as auc from r")
def _(spark, sf_dir):
    return S.roc_auc(scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query("average_precision", f"""with {SCORES_SQL}, d as (select s, sum(y) as p, count(*) as k from scored group by 1), c as (select p, sum(p) over (order by s desc) as cp, sum(k) over (order by s desc) as ck from d)
select round(sum(p * cp::double / ck) / sum(p), 9) as ap from c""")
def _(spark, sf_dir):
    return S.average_precision(scores(spark, sf_dir)).select(F.round("ap", 9).alias("ap"))


@query("group_auc", f"""with {SCORES_SQL}, w as (select a.grp, avg(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0 end) as auc from scored a join scored b on a.grp = b.grp and a.y = 1 and b.y <> 1 group by 1)
select g.grp, round(w.auc, 9)::double as auc from (select distinct grp from scored) g left join w on w.grp = g.grp""")
def _(spark, sf_dir):
    return S.roc_auc(scores(spark, sf_dir), by=["grp"]).select("grp", F.round("auc", 9).alias("auc"))


@query("snr_deciles", f"""with {SCORES_SQL}, e as (select [{", ".join(f"quantile_cont(s, {k / 10})" for k in range(11))}] as e from scored),
b as (select s, y, case when s <= e[1] then 0 else len(list_filter(list_distinct(e), lambda x: x < s)) - 1 end::int as bin from scored, e)
select bin, count(*) as n, min(s) as low, max(s) as high, round(avg(y), 9) as base_rate from b group by 1""")
def _(spark, sf_dir):
    df = scores(spark, sf_dir)
    return S.deciles(df.withColumn("t", F.col("s")), "t").select("bin", "n", "low", "high", F.round("base_rate", 9).alias("base_rate"))


@query("nbeam_bins", f"""with {HITS_SQL}, {NEAR}, e(bin, low, high) as (values {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(S.BEAM_EDGES, S.BEAM_EDGES[1:])))}), g as (select e.bin, low, high, count(*) as n, avg(snr) as mean, median(snr) as median from hits join beams using (id) join e on n_beams > low and n_beams <= high group by 1, 2, 3)
select bin::int as bin, low::int as low, high::int as high, n, round(mean, 6) as mean, round(median, 6) as median, mean > lag(mean) over (order by bin) as grows from g""")
def _(spark, sf_dir):
    got = S.beam_bins(O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1), "snr")
    return got.select("bin", "low", "high", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "grows")


@query("signal_level", f"""with {HITS_SQL} select obsid as group_id, "coarseChannel", round_even(frequency * 1e6, 0)::bigint as f_hz, round_even("driftRate" * 1e4, 0) / 1e4 as drift, max(beam % 2)::int as y, median(snr) as s, count(*) as n_hits from hits group by 1, 2, 3, 4""")
def _(spark, sf_dir):
    return S.signal_level(hits(spark, sf_dir).select("*", F.col("obsid").alias("group_id"), (F.col("beam") % 2).alias("y"), F.col("snr").alias("s")))


@query("catalogues", f"""with {HITS_SQL}, {NEAR}, q as (select id, (id * 31 % 1000) / 1000.0::double as score, n_beams, snr > 20 as pass_all from hits join beams using (id)), v as (select *, case when score < 0.1 then 'shortlist' when score > 0.9 then 'pruned' else 'uncertain' end as verdict from q)
select 'candidates' as list, verdict, count(*) as n from v where pass_all group by 2 union all select 'ambiguous', verdict, count(*) from v where n_beams > 2 and n_beams < 32 group by 2""")
def _(spark, sf_dir):
    df = O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1).select("id", "n_beams", ((F.col("id") * 31 % 1000) / 1000.0).alias("rfi_score"), (F.col("snr") > 20).alias("pass_all"))
    lists = S.catalogues(df)
    return lists["candidates"].select(F.lit("candidates").alias("list"), "verdict").union(lists["ambiguous"].select(F.lit("ambiguous"), "verdict")).groupBy("list", "verdict").agg(F.count("*").alias("n"))


@query("threshold_sweep", f"""with {HITS_SQL}, r as (select (id * 31 % 1000) / 1000.0::double as a, (id * 17 % 1000) / 1000.0::double as b from hits), t(t) as (values {", ".join(f"({x}::double)" for x in S.THRESHOLDS)})
select t as threshold, round(avg((a < t)::int), 9) as retained, count(*) filter (b < t) as n_shortlist, round(count(*) filter (b < t)::double / count(*), 9) as shortlist_frac, round(avg((a < t)::int) / greatest(count(*) filter (b < t)::double / count(*), 1e-9), 6) as retained_per_admitted from r, t group by t""")
def _(spark, sf_dir):
    df = hits(spark, sf_dir)
    got = S.threshold_sweep(df.select(((F.col("id") * 31 % 1000) / 1000.0).alias("rfi_score")), df.select(((F.col("id") * 17 % 1000) / 1000.0).alias("rfi_score")))
    return got.select("threshold", F.round("retained", 9).alias("retained"), "n_shortlist", F.round("shortlist_frac", 9).alias("shortlist_frac"), F.round("retained_per_admitted", 6).alias("retained_per_admitted"))


@query("group_folds", f"""with recursive {HITS_SQL}, g as (select obsid, count(*) as n, row_number() over (order by count(*) desc, obsid) as k from hits group by 1),
f(k, fold, w) as (select 0::bigint, -1::bigint, [0::bigint, 0, 0, 0, 0] union all select f.k + 1, (list_position(w, list_min(w)) - 1)::bigint, list_transform(w, lambda x, i: case when i = list_position(w, list_min(w)) then x + g.n else x end) from f join g on g.k = f.k + 1)
select obsid as group_id, fold::int as fold from f join g using (k)""")
def _(spark, sf_dir):
    folds = S.group_folds(hits(spark, sf_dir).withColumn("group_id", F.col("obsid")))
    return spark.createDataFrame(list(folds.items()), "group_id string, fold int")


BOTH = f"{SCORES_SQL}, two as (select 'length' as features, y, s from scored union all select 'number', y, (id * 31 % 1000) / 1000.0::double from scored)"


@query("ablation", f"""with {BOTH}, r as (select features, y, (rank() over (partition by features order by s) + count(*) over (partition by features, s) / 2.0 - 0.5) as k from two),
d as (select features, s, sum(y) as p, count(*) as k from two group by 1, 2), c as (select features, p, sum(p) over (partition by features order by s desc) as cp, sum(k) over (partition by features order by s desc) as ck from d),
auc as (select features, count(*) as n, (sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as a from r group by 1), ap as (select features, sum(p * cp::double / ck) / sum(p) as a from c group by 1)
select features, n, round(auc.a, 9)::double as roc_auc, round(ap.a, 9) as pr_auc from auc join ap using (features)""")
def _(spark, sf_dir):
    got = S.ablation(scores(spark, sf_dir).withColumn("t", (F.col("id") * 31 % 1000) / 1000.0), {"length": "s", "number": "t"})
    return got.select("features", "n", F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


@query("group_metrics", f"""with {SCORES_SQL}, w as (select a.grp, avg(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0 end) as auc from scored a join scored b on a.grp = b.grp and a.y = 1 and b.y <> 1 group by 1)
select g.grp, n, round(base_rate, 9) as base_rate, round(w.auc, 9)::double as auc from (select grp, count(*) as n, avg(y) as base_rate from scored group by 1) g left join w on w.grp = g.grp""")
def _(spark, sf_dir):
    return S.group_metrics(scores(spark, sf_dir), ["grp"]).select("grp", "n", F.round("base_rate", 9).alias("base_rate"), F.round("auc", 9).alias("auc"))


#: Two sources stand for files that were selected beforehand.
APART = ("src1", "src2")
LABELLED_SQL = f"{SCORES_SQL}, df as (select id, grp as file, case when id % 11 = 0 then -1 else y end as weak_label, s / 20000 as rfi_score from scored)"


def _labelled_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("id", F.col("grp").alias("file"), F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("y")).alias("weak_label"), (F.col("s") / 20000).alias("rfi_score"))


@query("evaluation_rows", f"with {LABELLED_SQL} select id from df where weak_label >= 0 and file not in {APART}")
def _(spark, sf_dir):
    return S.evaluation_rows(_labelled_scores(spark, sf_dir), APART).select("id")


@query("ood_block", f"""with {LABELLED_SQL}, known as (select * from df where weak_label >= 0), r as (select weak_label as y, (rank() over (order by rfi_score) + count(*) over (partition by rfi_score) / 2.0 - 0.5) as k from known),
o as (select count(*) as n, count(*) filter (weak_label = 1) as n_positive, round(avg(rfi_score), 9) as mean_score, round(avg((rfi_score > 0.5)::int), 9) as frac_scored_rfi from known where file in {APART})
select o.*, (select round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9)::double from r) as auc_including_it from o""")
def _(spark, sf_dir):
    got = S.ood_block(_labelled_scores(spark, sf_dir), prefiltered=APART)
    return got.select("n", "n_positive", *(F.round(c, 9).alias(c) for c in ("mean_score", "frac_scored_rfi", "auc_including_it")))


def labelled(spark, sf_dir):
    df = O.weak_labels(flagged(spark, sf_dir), 3, 1)
    return T.normalise(O.derived(df), {"frequency": "unit", "log_snr": "unit", "abs_drift": "unit"})[0]


@query("fit_score")
def _(spark, sf_dir):
    got = S.fit_score(labelled(spark, sf_dir), ["frequency_n", "log_snr_n", "abs_drift_n"], n_splits=5, n_seeds=3, max_iter=300)
    return got.select("id", "weak_label", "rfi_score")


@query("band_holdout")
def _(spark, sf_dir):
    got = S.band_holdout(labelled(spark, sf_dir), ["frequency_n", "log_snr_n", "abs_drift_n"], F.col("file"), max_iter=300)
    return S.group_metrics(got.withColumn("y", F.col("weak_label").cast("int")), ["band"], "y", "rfi_score")
