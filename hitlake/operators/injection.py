"""Synthetic drifting carriers in cutouts, and what a score makes of them.

Profiles depend on the cutout's shape and the signal alone and are column expressions; only the
fluctuating form needs a kernel, whose draws depend on the row's key and the seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.registry import with_cutout_features
from ..shared import saved
from . import boosting, scoring
from .dedupe import sample
from .transforms import normalise_like

DEFAULT_BANDWIDTH_HZ = 3.0
PAD = -1.0
#: Populations of substrates by beam count, both ends included.
CLASSES = {"single": (1, 2), "mid": (3, 31), "multibeam": (32, 64)}
#: Signal strengths and drifts of a run.
SNRS, DRIFTS = (5, 8, 12, 20, 35, 60, 100), (0.0, 0.1, 0.3)


def drift_track(steps: int, channels: int | Column, df_hz: float, dt_s: float, drift_hz_s: Column, centre: Column | None = None) -> Column:
    """Channel of the signal at each time step, anchored at the middle one."""
    middle = (channels - F.lit(1.0)) / 2 if centre is None else centre
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: middle + drift_hz_s * (t - (steps - 1) / 2.0) * dt_s / df_hz)


def signal_profile(steps: int, channels: Column, df_hz: float, dt_s: float, drift_hz_s: Column, bandwidth_hz: float = DEFAULT_BANDWIDTH_HZ) -> Column:
    """Time steps of channels, 1 at the peak: a Gaussian in frequency, of half a channel at least."""
    sigma = max(bandwidth_hz / df_hz, 0.5)
    track = drift_track(steps, channels, df_hz, dt_s, drift_hz_s)
    return F.transform(track, lambda at: F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.exp(-0.5 * F.pow((c - at) / sigma, F.lit(2.0)))))


def matched_norm(profile: Column) -> Column:
    return F.sqrt(A.total(F.transform(F.flatten(profile), lambda g: g * g)))


def amplitude_for_snr(profile: Column, sigma: Column, snr: Column) -> Column:
    """Amplitude at which the matched filter sees the SNR; 0 for an empty profile."""
    return A.let(matched_norm(profile), lambda s: F.when(s > 0, snr * sigma / s).otherwise(0.0))


def dedoppler_snr(profile: Column, amplitude: Column, sigma: Column) -> Column:
    """What a search along the track in one channel a step would report."""
    peaks = F.transform(profile, lambda r: F.array_max(r))
    return amplitude * A.total(peaks) / (sigma * F.sqrt(F.size(peaks).cast("double")))


def effective_dof(img: Column) -> Column:
    """Squared mean over variance of what isn't padding."""
    good = F.filter(F.flatten(img), lambda x: x.isNotNull() & ~F.isnan(x) & (x != PAD))
    return A.let(A.moments(good), lambda m: F.when(m["m2"] > 0, m["mean"] * m["mean"] / m["m2"]))


def inject(df: DataFrame, steps: int, df_hz: float, dt_s: float, *, snr: Column, drift_hz_s: Column, bandwidth_hz: float = DEFAULT_BANDWIDTH_HZ, fluctuate: bool = False, seed: int = 0, img: str = "img", channels: str = "numChannels") -> DataFrame:
    """The cutouts with a carrier added to their real window; padding, which leads, stays as it is.

    Adds amplitude and dedoppler_snr. A cutout without noise to measure is left alone.
    """
    n = F.least(F.col(channels), F.size(F.element_at(img, 1)))
    df = df.withColumns({"_sigma": A.noise_sigma(F.col(img)), "_profile": signal_profile(steps, n, df_hz, dt_s, drift_hz_s, bandwidth_hz)})
    usable = F.coalesce(F.col("_sigma") > 0, F.lit(False))
    df = df.withColumn("amplitude", F.when(usable, amplitude_for_snr(F.col("_profile"), F.col("_sigma"), snr)).otherwise(0.0))
    df = df.withColumn("dedoppler_snr", F.when(usable, dedoppler_snr(F.col("_profile"), F.col("amplitude"), F.col("_sigma"))))
    added = F.transform("_profile", lambda r: F.transform(r, lambda g: g * F.col("amplitude")))
    if fluctuate:
        df = _fluctuating(df.withColumns({"_drawn": added, "_dof": effective_dof(F.col(img)), "_key": F.xxhash64(F.lit(seed), "id")})).drop("_dof", "_key")
        added = F.col("_drawn")
    whole = F.zip_with(img, added, lambda r, g: F.transform(r, lambda x, c: F.when(c < F.size(r) - F.size(g), x).otherwise(x + F.element_at(g, c - (F.size(r) - F.size(g)) + 1))))
    return df.withColumn(img, whole).drop("_sigma", "_profile", "_drawn")


def _fluctuating(df: DataFrame) -> DataFrame:
    """_drawn times Gamma draws of mean 1 and _dof degrees of freedom, seeded by _key."""

    def draw(batches):
        for rows in batches:
            out = []
            for x, k, key in zip(rows["_drawn"], rows["_dof"], rows["_key"], strict=True):
                x = np.stack([np.asarray(r, float) for r in x])
                if k is not None and k > 0:
                    x = x * np.random.default_rng(int(key) & (1 << 63) - 1).gamma(k, 1 / k, x.shape)
                out.append([r.tolist() for r in x])
            yield rows.assign(_drawn=out)

    return df.mapInPandas(draw, df.schema)


def substrate_class(n_beams: Column) -> Column:
    return F.when(n_beams >= 32, "multibeam").when(n_beams <= 2, "single").otherwise("mid")


def select_substrates(df: DataFrame, n: int, max_snr: float = 8.0, beams: tuple[int, int] | None = None, seed: int = 0) -> DataFrame:
    """n quiet hits in a range of beam counts, both ends included; the same for any partitioning."""
    quiet = df.where(F.col("snr") <= max_snr)
    return sample(quiet.where(F.col("n_beams").between(*beams)) if beams else quiet, n, "id", seed)


def grid(df: DataFrame, snrs: tuple[float, ...] = (5, 8, 12, 20, 35, 60, 100), drifts: tuple[float, ...] = (0.0, 0.1, 0.3), control: bool = True) -> DataFrame:
    """Every row once for each (inj_snr, inj_drift), and once as it is (0, 0)."""
    cells = [(float(s), float(d)) for s in snrs for d in drifts] + [(0.0, 0.0)] * control
    return df.withColumn("_cell", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")) for s, d in cells)))).select(*df.columns, F.col("_cell.s").alias("inj_snr"), F.col("_cell.d").alias("inj_drift"))


def retention(df: DataFrame, score: str = "rfi_score") -> DataFrame:
    """(inj_snr, inj_drift, n, frac_shortlist, frac_pruned): how scores treat each kind of signal."""
    return df.groupBy("inj_snr", "inj_drift").agg(F.count("*").alias("n"), F.avg((F.col(score) < 0.1).cast("double")).alias("frac_shortlist"), F.avg((F.col(score) > 0.9).cast("double")).alias("frac_pruned"))


def matched_in_brightness(df: DataFrame, real_snr: Column, injected_snr: Column, within: float = 0.35) -> DataFrame:
    """Rows whose two SNRs agree in their logarithm."""
    return df.where(F.abs(F.log(F.greatest(real_snr, F.lit(1e-9))) - F.log(injected_snr)) < within)


def run(hits: DataFrame, table: DataFrame, models: dict[int, list], folds: dict, raw: list[str], *, steps: int, channels: int, df_hz: float, dt_s: float, group: str = "group_id", n_per_class: int = 150, classes: dict[str, tuple[int, int]] = CLASSES,
        snrs: tuple[float, ...] = SNRS, drifts: tuple[float, ...] = DRIFTS, max_snr: float = 8.0, bandwidth_hz: float = DEFAULT_BANDWIDTH_HZ, fluctuate: bool = False, seed: int = 0) -> DataFrame:
    """One row a substrate and signal, with controls at SNR 0: what the score makes of signals that are known to be there.

    hits: id, file, the group, snr, n_beams, numChannels and img (`steps` of `channels`). table: the stored features, raw and
    normalised (`_n`), one row an id. Substrates are drawn for each class on its own. Injected cutouts go through the same
    features as real ones, onto the curves of their file, and are scored by models that haven't seen their group.
    stored_score is the score of the untouched hit's stored features, null where it has none. Cutouts that are
    null can't be read and take no part.
    """
    repeated = table.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"id {repeated[0]['id']} stands on several rows of the feature table")
    chosen, features = None, [f"{c}_n" for c in raw]
    for name, beams in classes.items():
        part = select_substrates(hits.where("img is not null"), n_per_class, max_snr, beams, seed).withColumn("substrate_class", F.lit(name))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = saved(chosen.withColumns({"substrate_snr": F.col("snr"), "noise_sigma": A.noise_sigma(F.col("img"))}), "substrates")
    made = inject(grid(chosen, snrs, drifts), steps, df_hz, dt_s, snr=F.col("inj_snr"), drift_hz_s=F.col("inj_drift"), bandwidth_hz=bandwidth_hz, fluctuate=fluctuate, seed=seed)
    made = saved(with_cutout_features(made, channels, df_hz).drop("img"), "injected")
    scored = scoring.predict_held_out(models, folds, normalise_like(table, made, raw), features, group)
    stored = table.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")  # n_per_class a class
    stored = scoring.predict_held_out(models, folds, stored, features, group).select("id", F.col("rfi_score").alias("stored_score"))
    facts = {
        "kind": F.when(F.col("inj_snr") == 0, "control").otherwise("injected"), "injected_ok": F.coalesce(F.col("noise_sigma") > 0, F.lit(False)), "fold_was_fallback": F.col("fold_used") < 0,
        "fluctuate": F.lit(fluctuate), "bandwidth_hz": F.lit(float(bandwidth_hz)),
    }
    return scored.withColumns(facts).withColumnRenamed("out_of_range", "frac_out_of_range").join(stored, "id", "left")


def report(injections: DataFrame) -> list[dict]:
    """Of each class and signal: how many, how they score, and how far features lie outside what was trained on."""
    per = injections.groupBy("substrate_class", "kind", "inj_snr", "inj_drift").agg(
        F.count("*").alias("n"), F.avg("rfi_score").alias("mean_score"), F.avg("stored_score").alias("mean_stored_score"), F.avg((F.col("rfi_score") < 0.1).cast("double")).alias("frac_shortlist"),
        F.avg((F.col("rfi_score") > 0.9).cast("double")).alias("frac_pruned"), F.avg("frac_out_of_range").alias("frac_out_of_range"), F.count_if("fold_was_fallback").alias("n_fallback"), F.avg("dedoppler_snr").alias("dedoppler_snr"),
    )
    return [r.asDict() for r in per.orderBy("substrate_class", "kind", "inj_snr", "inj_drift").collect()]


def injected_vs_real(injected: DataFrame, real: DataFrame, features: list[str], *, within: float = 0.35, n_real: int = 4000, min_n: int = 200, seed: int = 0, max_iter: int = 300) -> dict:
    """AUC of a classifier that tells injections from real hits of the same brightness, on two fifths that it hasn't seen.

    Near a half, injections look like hits; near 1 the score's verdict on them means little. Real hits are a bounded sample of
    those whose SNR is, in its logarithm, within reach of the injections' median one.
    """
    none = {"auc": float("nan"), "n_real": 0, "n_injected": injected.count()}
    middle = injected.agg(F.percentile_approx("dedoppler_snr", 0.5, 10_000)).first()[0]
    if not middle or middle <= 0:
        return none
    near = matched_in_brightness(real, F.col("snr"), F.lit(float(middle)), within)
    n = near.count()
    if n < min_n:
        return none | {"n_real": n, "dedoppler": middle}
    both = sample(near, n_real, "id", seed).select(*features, F.lit(0.0).alias("label"), F.xxhash64(F.lit(seed), "id").alias("_h"))
    both = both.unionByName(injected.select(*features, F.lit(1.0).alias("label"), F.xxhash64(F.lit(seed), "id", "inj_snr", "inj_drift").alias("_h")))
    both = saved(both.withColumn("fold", F.when(F.pmod("_h", F.lit(5)) < 2, 0).otherwise(1)), "discriminator")
    held = both.where("fold = 0")
    got = held.withColumn("s", boosting.score(held, boosting.fit(both, features, 1, [seed], max_iter), features, F.col("fold")))
    return {"auc": scoring.roc_auc(got, "label", "s").first()[0], "n_real": min(n, n_real), "n_injected": none["n_injected"], "dedoppler": middle}
