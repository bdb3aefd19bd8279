"""Running sums over a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def running_sums(df: DataFrame, order: str, values: list[str], by: list[str] = (), descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Adds before_<value>: the sum over the rows ahead in the order, which must have no ties within a group.

    Approximate quantiles of the order cut it into buckets. A bucket's own running sum is a window
    of the bucket; what lies before a bucket is a running sum over at most `buckets` totals.
    """
    edges = df.agg(F.percentile_approx(order, F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 10_000)).first()[0] or []
    edges = sorted(set(edges))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order))) if edges else F.lit(0)
    df = df.withColumn("_bucket", at)
    up = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_bucket").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    over = ahead(Window.partitionBy(*by).orderBy(up("_bucket")))
    totals = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_t_{v}").over(over), F.lit(0)).alias(f"_b_{v}") for v in values))
    own = ahead(Window.partitionBy(*by, "_bucket").orderBy(up(order)))
    local = df.withColumns({f"_o_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    keys = [*by, "_bucket"]
    joined = local.alias("l").join(totals.alias("t"), [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return joined.select(*(F.col(f"l.{c}").alias(c) for c in df.columns if c != "_bucket"), *((F.col(f"_o_{v}") + F.col(f"_b_{v}")).alias(f"before_{v}") for v in values))
