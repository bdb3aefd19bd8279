"""Looking at single hits: which to show, what a picture of them is called, and cutouts made ready for display."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .dedupe import sample
from .injection import PAD

#: Selections by name: what is left out, and the order.
SORTS = ("snr", "drift", "nonzero-drift", "random")


def selection(df: DataFrame, n: int, sort: str = "snr", seed: int = 0, key: str = "id") -> DataFrame:
    """n hits: the loudest, the fastest drifting, the loudest that drift at all, or a seeded sample. Ties go to the smaller id."""
    if sort not in SORTS:
        raise ValueError(f"unknown selection {sort!r}; one of {SORTS}")
    if sort == "random":
        return sample(df, n, key, seed)
    rows = df.where("driftRate != 0") if sort == "nonzero-drift" else df
    by = F.abs("driftRate") if sort == "drift" else F.col("snr")
    return rows.where(by.isNotNull()).orderBy(by.desc(), key).limit(n)


def chosen(df: DataFrame, rows: DataFrame, n: int, file: str | None = None, family: int | None = None) -> DataFrame:
    """The first n hits, by row, that a table of rows names; of one file and of one family where these are given.

    A table without a column row, without rows of the file or of the family, or with a row that the
    hits don't have, is an error.
    """
    if "row" not in rows.columns:
        raise ValueError("a selection needs a row column")
    keys = ["row"] + ["file"] * ("file" in rows.columns and "file" in df.columns)
    for name, value in (("file", file), ("family", family)):
        if value is not None and name in rows.columns:
            rows = rows.where(F.col(name).cast("string") == str(value))
            if rows.isEmpty():
                raise ValueError(f"no rows of {name} {value}")
    wanted = rows.select(*keys).distinct().orderBy("row").limit(n)
    missing = wanted.join(df, keys, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"row {missing[0]['row']} isn't there")
    return df.join(F.broadcast(wanted), keys, "left_semi")  # n rows


def stamp_tag(dataset: str, sort: str = "random", rows: str | None = None, family: int | None = None) -> str:
    """What a picture of a selection is called: by its order, or by the table of rows (less the data set's name) and family."""
    if not rows:
        return sort
    tag = os.path.splitext(os.path.basename(rows))[0].removeprefix(f"{dataset}_")
    return tag if family is None else f"{tag}_fam{family}"


def clean_stamp(img: Column) -> Column:
    """(img, n_valid): the cutout without the channels that are padding at every time step; as it is where all are."""
    channels = F.sequence(F.lit(0), F.size(img[0]) - 1)
    valid = F.filter(channels, lambda c: F.exists(img, lambda r: F.get(r, c) != PAD))
    return A.let(valid, lambda v: F.struct(F.when(F.size(v) > 0, F.transform(img, lambda r: F.transform(v, lambda c: F.get(r, c)))).otherwise(img).alias("img"), F.size(v).alias("n_valid")))


def norm_stamp(img: Column) -> Column:
    """The cutout over its median, 0.001 at least; over its largest magnitude where the median isn't positive, or over 1."""
    flat = F.flatten(img)
    largest = F.array_max(F.transform(flat, lambda x: F.abs(x)))
    whole = F.when(A.median(flat) > 0, A.median(flat)).otherwise(F.when(largest > 0, largest).otherwise(1.0))
    return A.let(whole, lambda m: F.transform(img, lambda r: F.transform(r, lambda x: F.greatest(x / m, F.lit(1e-3)))))
