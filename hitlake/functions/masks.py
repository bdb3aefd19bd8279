"""Documented interference bands, as predicates and labels of a frequency in MHz."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (from MHz, to MHz, label, source), in order of declaration.
BANDS = [
    (768.0, 778.0, "Vodacom downlink", "SARAO"),
    (801.0, 811.0, "MTN downlink", "SARAO"),
    (811.0, 821.0, "Telkom downlink", "SARAO"),
    (880.0, 915.0, "GSM uplink", "SARAO"),
    (925.0, 960.0, "GSM downlink", "SARAO"),
    (962.0, 1213.0, "aircraft transponders / DME", "SARAO"),
    (1565.0, 1585.0, "GPS L1", "SARAO"),
    (1217.0, 1237.0, "GPS L2", "SARAO"),
    (1375.0, 1387.0, "GPS L3", "SARAO"),
    (1166.0, 1186.0, "GPS L5", "SARAO"),
    (1592.0, 1610.0, "GLONASS L1", "SARAO"),
    (1242.0, 1249.0, "GLONASS L2", "SARAO"),
    (1616.0, 1626.0, "Iridium", "SARAO"),
    (1526.0, 1554.0, "Inmarsat", "SARAO"),
    (2483.5, 2495.0, "Globalstar", "SARAO"),
    (2400.0, 2495.0, "Wi-Fi", "SARAO"),
    (2400.0, 2483.5, "Bluetooth", "SARAO"),
    (2200.0, 2290.0, "space ops/research downlink", "ITU"),
    (1920.0, 1980.0, "IMT-2000 uplink", "ITU"),
    (2110.0, 2170.0, "IMT-2000 downlink", "ITU"),
    (2300.0, 2400.0, "LTE band 40 (TD)", "ITU"),
    (2500.0, 2570.0, "LTE band 7 uplink", "ITU"),
    (2620.0, 2690.0, "LTE band 7 downlink", "ITU"),
]
#: A carrier given as one frequency, the half width around it, and the television comb.
CARRIER, CARRIER_HALF = (1278.75, "Galileo E6", "SARAO"), 5.0
TV_CHANNELS, TV_FIRST, TV_STEP, TV_HALF = range(21, 69), 306.0, 8.0, 4.0

Mask = tuple[float, float, str, str]


def _around(middle: float, half: float, label: str, source: str) -> Mask:
    return middle - half, middle + half, label, source


def mask_table(itu: bool = True, tv: bool = False, extra: list[Mask] = ()) -> list[Mask]:
    """All masks in flagging order, which is that of the tuples; extra ones are sorted in."""
    comb = (_around(TV_FIRST + TV_STEP * c, TV_HALF, f"digital TV ch{c}", "SARAO") for c in TV_CHANNELS)
    parts = {"band": BANDS, "carrier": [_around(CARRIER[0], CARRIER_HALF, *CARRIER[1:])], "comb": comb if tv else (), "extra": extra}
    return sorted(mask for kind, masks in parts.items() for mask in masks if itu or kind != "band" or mask[3] != "ITU")


def read_masks(spark: SparkSession, path: str) -> list[Mask]:
    """Masks from a CSV file that derive_mask() has written; a mask table is small by nature and goes into the plan."""
    rows = spark.read.csv(path, header=True, schema="f_lo_mhz double, f_hi_mhz double, label string, n_beams long, n_obs long, n_hits long")
    return [(r.f_lo_mhz, r.f_hi_mhz, r.label or "empirical", "empirical") for r in rows.orderBy("f_lo_mhz").collect()]


def _within(f: Column, mask: Mask) -> Column:
    return f.between(F.lit(mask[0]), F.lit(mask[1]))


def in_any(f: Column, masks: list[Mask]) -> Column:
    return F.coalesce(reduce(or_, (_within(f, m) for m in masks), F.lit(False)), F.lit(False))


def first_label(f: Column, masks: list[Mask], label=lambda m: f"{m[2]} [{m[3]}]", none: str | None = "") -> Column:
    """The label of the first mask that holds the frequency."""
    out = F.lit(none).cast("string")
    for m in reversed(masks):
        out = F.when(_within(f, m), F.lit(label(m))).otherwise(out)
    return out


def band_of(f: Column, itu: bool = True) -> Column:
    """The documented band of a frequency in order of declaration (not that of flagging), or null."""
    return first_label(f, [m for m in BANDS if itu or m[3] == "SARAO"], lambda m: m[2], None)


def contained(hits: DataFrame, masks: DataFrame, frequency: str = "frequency") -> DataFrame:
    """hits with their first mask, for tables too long for a CASE chain: (f_lo, f_hi, label, position).

    Masks and hits meet in bins of 1 MHz, an equi join, so a long empirical table needs no nested loop.
    Adds mask_label and mask_position; null where no mask holds the frequency.
    """
    spread = masks.withColumn("mhz", F.explode(F.sequence(F.floor("f_lo"), F.floor("f_hi"))))
    keyed = hits.withColumn("mhz", F.floor(frequency))
    met = keyed.join(spread, "mhz").where(F.col(frequency).between(F.col("f_lo"), F.col("f_hi")))
    first = met.groupBy("mhz", frequency).agg(F.min(F.struct("position", "label")).alias("m"))
    return keyed.join(first, ["mhz", frequency], "left").select(*hits.columns, F.col("m.label").alias("mask_label"), F.col("m.position").alias("mask_position"))
