"""Feature tables on any file system that Spark reads: names, discovery, checked writes, and reports."""

from __future__ import annotations

import json
import math
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("globular",)
#: Columns that tell a feature table from any other Parquet file.
MARKERS = {"feature_ok", "weak_label", "stamp_ok"}


def filename(dataset: str, method: str = "globular") -> str:
    return f"{dataset}_{method}.parquet"


def legacy_filename(dataset: str) -> str:
    return f"{dataset}_features.parquet"


def split_filename(name: str) -> tuple[str, str | None]:
    """(dataset, method): a known method is taken off the right; underscores within a dataset's name stay."""
    stem = PurePosixPath(name).name.removesuffix(".parquet")
    for method in METHODS:
        if stem.endswith(f"_{method}") and len(stem) > len(method) + 1:
            return stem.removesuffix(f"_{method}"), method
    return (stem.removesuffix("_features"), None) if stem.endswith("_features") else (stem, None)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []


def is_ours(spark: SparkSession, path: str) -> bool:
    return set(spark.read.parquet(path).columns) >= MARKERS


def is_legacy(spark: SparkSession, path: str) -> bool:
    """A feature table of ours from before names told the method; a look at its columns tells, the name alone can't."""
    return path.endswith("_features.parquet") and split_filename(path)[1] is None and is_ours(spark, path)


def legacy_files(spark: SparkSession, folder: str) -> list[str]:
    """Legacy tables of a folder, whether or not they have been migrated."""
    return [p for p in _listed(spark, folder) if is_legacy(spark, p)]


def discover(spark: SparkSession, folder: str, method: str = "globular", include_combined: bool = True) -> dict[str, str]:
    """{dataset: path}; other methods are ignored, and a conforming name beats a legacy one."""
    found: dict[str, str] = {}
    for legacy in (True, False):
        for path in _listed(spark, folder):
            if not path.endswith(".parquet"):
                continue
            dataset, own = split_filename(path)
            if own == (None if legacy else method) and (not legacy or path.endswith("_features.parquet")) and (include_combined or dataset != "all") and is_ours(spark, path):
                found[dataset] = path
    return found


def find(spark: SparkSession, folder: str, dataset: str, method: str = "globular") -> str:
    got = discover(spark, folder, method).get(dataset)
    if not got:
        raise FileNotFoundError(f"no features of {dataset!r} in {folder}")
    return got


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature table; id comes along whatever columns are asked for, and must exist."""
    df = spark.read.parquet(path)
    if "id" not in df.columns:
        raise ValueError(f"{path} has no id")
    return df if columns is None else df.select(list(dict.fromkeys(["id", *columns])))


def write(df: DataFrame, path: str) -> None:
    """Refuses a table without ids or with repeated ones."""
    if "id" not in df.columns:
        raise ValueError("a feature table needs an id")
    repeated = df.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"id {repeated[0]['id']} occurs {repeated[0]['count']} times")
    df.write.mode("overwrite").parquet(path)


def migrate(spark: SparkSession, folder: str, method: str = "globular") -> tuple[list[str], list[str]]:
    """Writes legacy tables under conforming names; originals stay. (done, already there)."""
    done, already = [], []
    conforming = {split_filename(p)[0] for p in _listed(spark, folder) if split_filename(p)[1] == method}
    for path in _listed(spark, folder):
        dataset, own = split_filename(path)
        if own is None and path.endswith("_features.parquet") and is_ours(spark, path):
            if dataset in conforming:
                already.append(dataset)
            else:
                write(spark.read.parquet(path), f"{folder.rstrip('/')}/{filename(dataset, method)}")
                done.append(dataset)
    return done, already


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix, else CSV with a header."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def select_rows(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows named by a table with `row` and perhaps file and family."""
    if "row" not in chosen.columns:
        raise ValueError("a selection needs a row column")
    keys = [c for c in ("file", "row", "family") if c in chosen.columns and c in df.columns]
    return df.join(chosen.select(keys).distinct(), keys, "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    """A report of bounded size, as one file in a folder."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def strict(x):
    """Plain values for JSON: NaN and infinities become null, booleans stay booleans."""
    if isinstance(x, dict):
        return {str(k): strict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [strict(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(report: dict, path: str) -> None:
    with open(path, "w") as file:
        json.dump(strict(report), file, indent=2, allow_nan=False)


def read_report(path: str) -> dict:
    """A report of a score; one that was written without its validation is an error."""
    with open(path) as file:
        report = json.load(file)
    if "validation" not in report:
        raise ValueError(f"{path} has no validation block")
    return report


def health_of_ids(df: DataFrame) -> DataFrame:
    """(n_rows, n_ids, n_surplus)."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids")).withColumn("n_surplus", F.col("n_rows") - F.col("n_ids"))
