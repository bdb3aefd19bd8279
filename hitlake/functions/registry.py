"""The extension point for features: named functions that give one or more columns.

A catalogue feature is a function of no data that returns {column: Column}. A cutout feature gets
a Cutout, whose members are Columns, and returns the same. kernel() registers a NumPy function of a
batch of cutouts for what Spark's functions can't express; it runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import finite
from . import arrays as A
from .scalars import channel_offset


@dataclass(frozen=True)
class Cutout:
    img: Column
    spectrum: Column
    series: Column
    channels: int
    df_hz: float


@dataclass(frozen=True)
class Feature:
    name: str
    columns: tuple[str, ...]
    kind: str
    text: str
    make: Callable


FEATURES: dict[str, Feature] = {}


def feature(kind: str, *columns: str):
    """kind: "catalogue", "cutout" or "kernel". A name can be registered once."""

    def add(make: Callable) -> Callable:
        if make.__name__ in FEATURES:
            raise ValueError(f"feature {make.__name__} is registered already")
        FEATURES[make.__name__] = Feature(make.__name__, columns, kind, (make.__doc__ or "").strip(), make)
        return make

    return add


def all_columns(kind: str | None = None) -> list[str]:
    return [c for f in FEATURES.values() if kind in (None, f.kind) for c in f.columns]


#: Columns that diagnostics must not treat as continuous.
ORDINAL = {"f02_abs_drift", "f12_bandwidth_hz", "x02_time_occupancy"}


def column_kinds() -> dict[str, str]:
    return {c: "flag" if c.endswith("_saturated") else "ordinal" if c in ORDINAL else "continuous" for c in all_columns()}


def describe() -> list[tuple[str, str, str, str]]:
    """(name, kind, columns, text) of each feature."""
    return [(f.name, f.kind, ", ".join(f.columns), f.text) for f in FEATURES.values()]


@feature("catalogue", "f01_frequency", "f02_abs_drift", "f03_snr")
def catalogue_values():
    """Frequency, absolute drift and signal-to-noise as the search gives them."""
    return {"f01_frequency": F.col("frequency"), "f02_abs_drift": F.abs("driftRate"), "f03_snr": F.col("snr")}


@feature("catalogue", "x03_channel_offset")
def place_in_channel():
    """Place within the coarse channel."""
    return {"x03_channel_offset": channel_offset(F.col("index"), F.col("startChannel"), F.col("numChannels"))}


@feature("cutout", "f04_spectral_skew", "f05_spectral_kurtosis", "f06_bimodality", "f11_spectrum_std")
def spectral_shape(c: Cutout):
    """Moments of the spectrum, once for all four."""
    m = A.moments(c.spectrum)
    both = lambda f: A.let(m, f)
    return {
        "f04_spectral_skew": both(A.skewness), "f05_spectral_kurtosis": both(A.kurtosis),
        "f06_bimodality": both(lambda x: A.bimodality(A.skewness(x), A.kurtosis(x))), "f11_spectrum_std": both(A.relative_std),
    }


@feature("cutout", "f07_kurt_bw_corr", "f08_turning_bw_hz", "f08_turning_bw_saturated")
def bandwidth_sweep(c: Cutout):
    """Kurtosis against bandwidth."""
    s = A.kurtosis_sweep(c.spectrum, c.channels, c.df_hz)
    return {"f07_kurt_bw_corr": s["corr"], "f08_turning_bw_hz": s["turning_hz"], "f08_turning_bw_saturated": s["saturated"].cast("double")}


@feature("cutout", "f09_temporal_skew", "f10_timeseries_std")
def temporal_shape(c: Cutout):
    """Moments of the time series."""
    m = A.moments(c.series)
    return {"f09_temporal_skew": A.let(m, A.skewness), "f10_timeseries_std": A.let(m, A.relative_std)}


@feature("cutout", "f12_bandwidth_hz", "f12_bandwidth_saturated")
def bandwidth(c: Cutout):
    """Width of the run around the peak above one hundredth of it."""
    r = A.peak_run(c.spectrum)
    return {"f12_bandwidth_hz": r["width"] * c.df_hz, "f12_bandwidth_saturated": r["saturated"].cast("double")}


@feature("cutout", "f13_redness")
def slow_structure(c: Cutout):
    """Power of the slowest structure of the spectrum over the next."""
    return {"f13_redness": A.redness(c.spectrum, c.channels)}


@feature("cutout", "x01_drift_residual", "x02_time_occupancy")
def coherence_in_time(c: Cutout):
    """Scatter about a straight drift, and the share of time above half the peak."""
    return {"x01_drift_residual": A.drift_residual(c.img), "x02_time_occupancy": A.time_occupancy(c.img)}


def with_catalogue_features(df: DataFrame) -> DataFrame:
    return df.withColumns({c: x for f in FEATURES.values() if f.kind == "catalogue" for c, x in f.make().items()})


def with_cutout_features(df: DataFrame, channels: int, df_hz: float, img: str = "img") -> DataFrame:
    """df has img, cropped to `channels`. Adds every cutout and kernel feature, and feature_ok: all of them are finite."""
    df = df.withColumns({"spectrum": A.spectrum(F.col(img)), "series": A.time_series(F.col(img))})
    cut = Cutout(F.col(img), F.col("spectrum"), F.col("series"), channels, df_hz)
    df = df.withColumns({c: x for f in FEATURES.values() if f.kind == "cutout" for c, x in f.make(cut).items()})
    for f in (f for f in FEATURES.values() if f.kind == "kernel"):
        df = _kernel(df, f, img)
    ok = F.lit(True)
    for c in all_columns("cutout") + all_columns("kernel"):
        ok = ok & finite(c)
    return df.withColumn("feature_ok", ok).drop("spectrum", "series")


def _kernel(df: DataFrame, f: Feature, img: str) -> DataFrame:
    @F.pandas_udf(", ".join(f"{c} double" for c in f.columns))
    def run(cubes: pd.Series) -> pd.DataFrame:
        out = f.make([np.stack([np.asarray(r, float) for r in x]) for x in cubes])
        return pd.DataFrame({c: out[c] for c in f.columns})

    return df.withColumn("_k", run(img)).select(*df.columns, *(F.col(f"_k.{c}").alias(c) for c in f.columns))
