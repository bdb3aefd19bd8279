"""Queries of the flagging operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions.scalars import galactic_latitude, half_even_at
from ..operators import flags as O
from ..sources.adapters import HITS_SQL, hits
from .catalogue import query

#: Thresholds at which the flags of the provided tables are neither all false nor all true.
SET = {"tol_hz": 5e6, "max_beams": 2, "snr_max": 200.0, "repeat_tol_hz": 1e7, "max_drift_coeff": 2e-5, "min_obs": 5}


def case(masks, label, none="''") -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "case " + " ".join(f"when frequency between {lo!r}::double and {hi!r}::double then {quoted(label((lo, hi, name, source)))}" for lo, hi, name, source in masks) + f" else {none} end"


FIRST = case(M.mask_table(), lambda m: f"{m[2]} [{m[3]}]")
BAND = case(M.BANDS, lambda m: m[2], "null")

NEAR = """beams as (select a.id, count(distinct b.beam) as n_beams from hits a join hits b on a.obsid = b.obsid
  and b.frequency * 1e6 between a.frequency * 1e6 - 5e6 and a.frequency * 1e6 + 5e6 and abs(a."driftSteps" - b."driftSteps") <= 1 group by a.id),
formed as (select obsid, max(beam) + 1 as n_beams_formed from hits group by obsid)"""

REPEATS = """f1 as (select round_even(frequency * 1e6 / 1e7, 0)::bigint as b, count(distinct obsid) as n_obs_at_freq from hits group by 1),
f2 as (select round_even(frequency * 1e6 / 1e7, 0)::bigint as b, round_even("driftSteps" / 1.0, 0)::bigint as d, count(distinct obsid) as n_obs_at_freq_drift from hits group by 1, 2)"""

FLAGGED_SQL = f"""{HITS_SQL}, {NEAR}, {REPEATS},
flagged as (select h.*, {FIRST} as rfi_band_label, {FIRST} <> '' as flag_rfi_band, "driftRate" = 0 as flag_zero_drift, abs("driftRate") > 2e-5 * frequency as flag_drift_high,
  snr < case when "numTimesteps" < 16 then 15.0 else 10.0 end as flag_snr_low, snr > 200 as flag_snr_high, n.n_beams, m.n_beams_formed, n.n_beams::double / m.n_beams_formed as beam_frac, n.n_beams > 2 as flag_multibeam,
  case when "incoherentPower" > 0 then power / "incoherentPower" end as coh_ratio,
  coalesce("incoherentPower" > 0 and (power / "incoherentPower" > sqrt(62::double) * 2 or power / "incoherentPower" < sqrt(62::double) / 2), false) as flag_incoherent,
  f1.n_obs_at_freq, f2.n_obs_at_freq_drift, f2.n_obs_at_freq_drift >= 5 as flag_repeat
  from hits h join beams n using (id) join formed m on m.obsid = h.obsid join f1 on f1.b = round_even(frequency * 1e6 / 1e7, 0)::bigint
  join f2 on f2.b = f1.b and f2.d = round_even("driftSteps" / 1.0, 0)::bigint),
passed as (select *, not (flag_rfi_band or flag_zero_drift or flag_drift_high or flag_snr_low or flag_snr_high or flag_multibeam or flag_incoherent or flag_repeat) as pass_all from flagged)"""


def flagged(spark, sf_dir):
    return O.flag_all(hits(spark, sf_dir), **SET)


@query("rfi_band_flag", f"with {HITS_SQL} select id, {FIRST} as rfi_band_label, {FIRST} <> '' as flag_rfi_band from hits")
def _(spark, sf_dir):
    return O.rfi_bands(hits(spark, sf_dir)).select("id", "rfi_band_label", "flag_rfi_band")


@query("mask_range_join", f"with {HITS_SQL} select id, case when {FIRST} = '' then null else {FIRST} end as mask_label from hits")
def _(spark, sf_dir):
    masks = spark.createDataFrame([(lo, hi, f"{label} [{source}]", k) for k, (lo, hi, label, source) in enumerate(M.mask_table())], "f_lo double, f_hi double, label string, position int")
    return M.contained(hits(spark, sf_dir), masks).select("id", "mask_label")


@query("documented_band", f"with {HITS_SQL} select id, {BAND} as band from hits")
def _(spark, sf_dir):
    return hits(spark, sf_dir).select("id", M.band_of(F.col("frequency")).alias("band"))


@query("zero_drift", f'with {HITS_SQL} select id, "driftRate" = 0 as flag_zero_drift from hits')
def _(spark, sf_dir):
    return O.zero_drift(hits(spark, sf_dir)).select("id", "flag_zero_drift")


@query("max_drift", f'with {HITS_SQL} select id, 2e-5 * frequency as max_drift_hz_s, abs("driftRate") > 2e-5 * frequency as flag_drift_high from hits')
def _(spark, sf_dir):
    return O.max_drift(hits(spark, sf_dir), 2e-5).select("id", "max_drift_hz_s", "flag_drift_high")


@query("snr_window", f'with {HITS_SQL} select id, case when "numTimesteps" < 16 then 15.0::double else 10.0 end as snr_floor, snr < case when "numTimesteps" < 16 then 15.0 else 10.0 end as flag_snr_low, snr > 200 as flag_snr_high from hits')
def _(spark, sf_dir):
    return O.snr_window(hits(spark, sf_dir), snr_max=200.0).select("id", "snr_floor", "flag_snr_low", "flag_snr_high")


@query("beam_multiplicity", f"with {HITS_SQL}, {NEAR} select id, n_beams::int as n_beams from beams")
def _(spark, sf_dir):
    return O.beam_multiplicity(hits(spark, sf_dir), 5e6, 1).select("id", "n_beams")


@query("beam_multiplicity_window", f"with {HITS_SQL}, {NEAR} select id, n_beams::int as n_beams from beams")
def _(spark, sf_dir):
    return O.beam_multiplicity_window(hits(spark, sf_dir), 5e6, 1).select("id", "n_beams")


@query("beams_per_frequency", f"with {HITS_SQL} select a.id, count(distinct b.beam)::int as nb from hits a join hits b on a.obsid = b.obsid and b.frequency * 1e6 between a.frequency * 1e6 - 5e6 and a.frequency * 1e6 + 5e6 group by a.id")
def _(spark, sf_dir):
    return O.beam_multiplicity(hits(spark, sf_dir), 5e6, None, "nb").select("id", "nb")


@query("multibeam_flag", f"with {FLAGGED_SQL} select id, n_beams::int as n_beams, n_beams_formed, beam_frac, flag_multibeam from flagged")
def _(spark, sf_dir):
    return O.multibeam(hits(spark, sf_dir), 5e6, 1, 2).select("id", "n_beams", "n_beams_formed", "beam_frac", "flag_multibeam")


@query("coherence_ratio", f"with {FLAGGED_SQL} select id, round(coh_ratio, 6) as coh_ratio, flag_incoherent from flagged")
def _(spark, sf_dir):
    return O.coherence(hits(spark, sf_dir)).select("id", F.round("coh_ratio", 6).alias("coh_ratio"), "flag_incoherent")


@query("external_merge", f'with {HITS_SQL} select h.id, coalesce(e.p, 0.0)::double as "incoherentPower" from hits h left join (select event_id as id, value * 2 as p from raw where k % 3 = 0) e using (id)')
def _(spark, sf_dir):
    ext = spark.read.parquet(f"{sf_dir}/events.parquet").where("cast(get_json_object(props, '$.k') as int) % 3 = 0").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("incoherentPower"))
    return O.external_incoherent(hits(spark, sf_dir), ext).select("id", "incoherentPower")


@query("repeat_counts", f"with {FLAGGED_SQL} select id, n_obs_at_freq, n_obs_at_freq_drift, flag_repeat from flagged")
def _(spark, sf_dir):
    return O.repeat(hits(spark, sf_dir), 1e7, 5).select("id", "n_obs_at_freq", "n_obs_at_freq_drift", "flag_repeat")


@query("max_beam_per_observation", f"with {HITS_SQL} select obsid, max(beam)::int as max_beam, count(distinct beam) as n_distinct from hits group by 1")
def _(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("obsid").agg(F.max("beam").alias("max_beam"), F.countDistinct("beam").alias("n_distinct"))


@query("derive_mask", f"""with {HITS_SQL}, b as (select round_even(frequency * 1e6 / 1e7, 0)::bigint as bin, count(distinct beam) as n_beams, count(distinct obsid) as n_obs, count(*) as n_hits from hits group by 1)
select (bin * 1e7 - 1e7 / 2) / 1e6 as f_lo_mhz, (bin * 1e7 + 1e7 / 2) / 1e6 as f_hi_mhz, 'empirical: ' || n_beams || ' beams, ' || n_obs || ' obs' as label, n_beams, n_obs, n_hits from b where n_beams >= 16 and n_obs >= 3""")
def _(spark, sf_dir):
    return O.derive_mask(hits(spark, sf_dir), 1e7, 16, 3)


STEPS = list(O.MEANINGS.items())
CUT_SQL = f"with {FLAGGED_SQL}, n as (select count(*) as n from flagged) " + " union all ".join(
    f"select {k}::int as step, '{text.replace("'", "''")}' as cut, count(*) filter ({f}) as flagged_alone, 100.0::double * count(*) filter ({f}) / max(n.n) as pct_alone, "
    f"count(*) filter ({f} and not ({before})) as removed_here, count(*) filter (not ({before} or {f})) as remaining, 100.0::double * count(*) filter (not ({before} or {f})) / max(n.n) as pct_remaining from flagged, n"
    for k, (f, text) in enumerate(STEPS)
    for before in [" or ".join([x for x, _ in STEPS[:k]] or ["false"])]
)


@query("cutflow", CUT_SQL)
def _(spark, sf_dir):
    return O.cutflow(flagged(spark, sf_dir))


@query("survivors", f'with {FLAGGED_SQL} select "row", id, file, "sourceName", obsid, beam, frequency, "driftRate", snr, n_beams::int as n_beams, beam_frac, n_obs_at_freq, n_obs_at_freq_drift, coh_ratio from passed where pass_all')
def _(spark, sf_dir):
    return O.survivors(flagged(spark, sf_dir))


@query("derived_logs", f'with {HITS_SQL} select id, round(log10(greatest(snr, 1e-12)), 9) as log_snr, round(log10(greatest(power, 1e-12)), 9) as log_power, abs("driftRate") as abs_drift from hits')
def _(spark, sf_dir):
    return O.derived(hits(spark, sf_dir)).select("id", F.round("log_snr", 9).alias("log_snr"), F.round("log_power", 9).alias("log_power"), "abs_drift")


@query("weak_labels", f"""with {FLAGGED_SQL} select id, case when n_beams >= 4 or beam_frac >= 4.0 / 64 then 1 when n_beams <= 1 then 0 else -1 end::tinyint as weak_label,
  case when n_beams >= 4 then 'n_beams >= 4' when beam_frac >= 4.0 / 64 then 'beam_frac >= 0.0625' when n_beams <= 1 then 'n_beams <= 1' else 'between' end as weak_label_reason, obsid as group_id from flagged""")
def _(spark, sf_dir):
    return O.weak_labels(O.multibeam(hits(spark, sf_dir), 5e6, 1, 2), 4, 1).select("id", "weak_label", "weak_label_reason", "group_id")


@query("galactic_latitude", f"""with {HITS_SQL} select id, round_even(degrees(asin(least(1, greatest(-1, sin(radians(dec)) * sin(radians(27.1284::double)) + cos(radians(dec)) * cos(radians(27.1284::double)) * cos(radians(ra * 15 - 192.8595::double)))))) * 1e6, 0) / 1e6 as b from hits""")
def _(spark, sf_dir):
    return hits(spark, sf_dir).select("id", half_even_at(galactic_latitude(F.col("ra") * 15, F.col("dec")), 6).alias("b"))
