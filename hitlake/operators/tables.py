"""Feature, flag and score tables together: joins without a shuffle, the matrix that is clustered, and the summary of all files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import all_columns, column_kinds
from ..schema import finite
from ..shared import shared_dir
from .dedupe import feature_health
from .transforms import scale

#: Buckets of a stored table. Tables that are joined must have the same number.
BUCKETS = 64


def stored(df: DataFrame, keys: list[str], name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df as a table in buckets by its keys, sorted within them: joins and groupings by these keys read bucket by bucket, without an exchange.

    The rows lie in the shared folder, under the catalogue's name `name` (a new one if none is given). Files
    of one bucket come from one task, so there are as many files as buckets.
    """
    spark = df.sparkSession
    name = name or f"stored_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", where).format("parquet").saveAsTable(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.table(name)


def with_flags(features: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ("file", "row")) -> DataFrame:
    """The rows of a feature table with the flags of their hits: every flag_ column and pass_all of the catalogue's row of the same keys, null where it has none.

    Flags that the features carry already are replaced. Both tables hold a row once for each key; a key on
    several rows of the catalogue is an error. If both were stored() by these keys, nothing is shuffled.
    """
    repeated = catalogue.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{dict(zip(keys, repeated[0], strict=False))} stands on several rows of the catalogue")
    flags = [c for c in catalogue.columns if c.startswith("flag_") or c == "pass_all"]
    return features.drop(*flags).join(catalogue.select(*keys, *flags), list(keys), "left")


@dataclass
class Matrix:
    """What is clustered: `rows` has the key and, for each of `columns`, the raw value, the normalised one (`_n`) and the scaled one (`_s`); usable rows have all normalised ones."""

    columns: list[str]
    rows: DataFrame

    @property
    def space(self) -> list[str]:
        return [f"{c}_s" for c in self.columns]

    def usable(self) -> DataFrame:
        return self.rows.where("usable")


def feature_matrix(df: DataFrame, columns: list[str] | None = None, drop_saturated: bool = True, scaling: str = "robust", key: str = "id") -> Matrix:
    """The matrix of a feature table with normalised twins.

    Without `columns` all registered features are taken that the table has, but for marks of saturation and,
    with drop_saturated, the turning bandwidth, which is out of range for most hits. The scaling is fitted to
    usable rows alone; in other rows the scaled values are null.
    """
    if columns is None:
        columns = [c for c in all_columns() if f"{c}_n" in df.columns and not c.endswith("_saturated") and not (drop_saturated and c.startswith("f08_"))]
    if missing := [f"{c}_n" for c in columns if f"{c}_n" not in df.columns]:
        raise ValueError(f"no columns {missing}")
    usable = F.lit(bool(columns))
    for c in columns:
        usable = usable & finite(f"{c}_n")
    kept = [key, *(c for c in columns if c in df.columns), *(f"{c}_n" for c in columns)]
    rows = df.select(*kept).withColumn("usable", usable)
    kinds = {f"{c}_n": k for c, k in column_kinds().items()}
    good = scale(rows.where("usable"), [f"{c}_n" for c in columns], scaling, kinds=kinds).select(*kept, "usable", *(F.col(f"{c}_n_s").alias(f"{c}_s") for c in columns))
    return Matrix(columns, good.unionByName(rows.where("not usable"), allowMissingColumns=True))


LABELS = {1: "rfi", 0: "confined", -1: "ambiguous"}


def combined_summary(df: DataFrame, columns: list[str], group: str = "group_id") -> DataFrame:
    """(part, name, n, pct, p1, p50, p99) of a combined table, in two passes.

    Part `feature`: finite values, their share and percentiles; `label`: rows of each weak label and their share;
    `groups`: the number of observations; `rows`: that of hits.
    """
    none = [F.lit(None).cast("double").alias(c) for c in ("p1", "p50", "p99")]
    rows, share = F.col("rows"), lambda n: F.try_divide(100.0 * n, F.col("rows"))
    finite_ones = {f"_{c}": F.count_if(finite(c)) for c in columns}
    labels = {name: F.count_if(F.col("weak_label") == v) for v, name in LABELS.items()}
    facts = df.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), *(n.alias(c) for c, n in (finite_ones | labels).items()))
    told = [("feature", c, F.col(f"_{c}"), share(F.col(f"_{c}"))) for c in columns] + [("label", x, F.col(x), share(F.col(x))) for x in labels]
    told += [("groups", group, F.col("groups"), F.lit(None).cast("double")), ("rows", "all", rows, F.lit(None).cast("double"))]
    counted = facts.select(F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(x).alias("name"), n.alias("n"), pct.alias("pct")) for p, x, n, pct in told))))
    health = feature_health(df, columns).select(F.lit("feature").alias("part"), F.col("feature").alias("name"), "p1", "p50", "p99")
    return counted.where("part = 'feature'").join(F.broadcast(health), ["part", "name"]).unionByName(counted.where("part <> 'feature'").select("*", *none))  # a row a column


def drop_stored(spark: SparkSession, *tables: str) -> None:
    for name in tables:
        spark.sql(f"drop table if exists {name}")
