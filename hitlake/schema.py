"""Column contracts of hits, stamps and features, and the rule for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of hits, as files of them have them.
HITS = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("id", "row")),
    *(T.StructField(n, T.IntegerType()) for n in ("index", "beam", "coarseChannel", "startChannel", "numChannels", "numTimesteps", "driftSteps")),
    *(T.StructField(n, T.DoubleType()) for n in ("frequency", "driftRate", "snr", "power", "incoherentPower", "ra", "dec", "fch1", "foff", "tsamp", "tstart")),
    *(T.StructField(n, T.StringType()) for n in ("sourceName", "obsid", "file")),
])

#: Flags in the order in which a survivor must pass them.
FLAGS = ["flag_rfi_band", "flag_zero_drift", "flag_drift_high", "flag_snr_low", "flag_snr_high", "flag_multibeam", "flag_incoherent", "flag_repeat"]


def finite(column: str):
    """True for a number that is there and is neither NaN nor infinite."""
    c = F.col(column).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null everywhere inside; sources that write NaN are brought in through this."""
    kinds = {"double", "float"}
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))
