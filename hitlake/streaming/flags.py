"""Flags of a stream of hits: the stateless ones as they come, persistence over event time with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import flags as O


def stateless(stream: DataFrame, masks=None, *, snr_min: float = 10.0, snr_max: float = 1e6, max_drift_coeff: float = 0.0) -> DataFrame:
    """Flags that need one hit alone; the same operators as for tables."""
    return O.snr_window(O.max_drift(O.zero_drift(O.rfi_bands(stream, masks)), max_drift_coeff), snr_min, snr_max)


def persistence(stream: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour", tol_hz: float = 10.0) -> DataFrame:
    """(start, f_bin, n_hits, n_obs): observations of each frequency bin in each window; state goes with the watermark."""
    bins = half_even(F.col("frequency") * 1e6 / tol_hz)
    # Distinct observations need a set as state; it is bounded by the observations of a window.
    per = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), bins.alias("f_bin"))
    return per.agg(F.count("*").alias("n_hits"), F.size(F.collect_set("obsid")).alias("n_obs")).select(F.col("w.start").alias("start"), "f_bin", "n_hits", "n_obs")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet under the folder, and reads it.

    append: files as they come, exactly once. complete: the whole result, replaced by each batch.
    """
    to = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{to}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{to}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{to}/out")
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{to}/out")
