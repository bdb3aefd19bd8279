"""Connected components of an edge table by alternating large and small stars.

Nothing is gathered on the driver but one count and one checksum a round. A vertex with very
many edges costs no large group: its least neighbour comes from a partial aggregation, and the
join that hands it back can be split by adaptive execution.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its tree) for nodes that aren't roots themselves."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and x != top:
            up[x], x = top, y
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up)]


def _local(batch: pa.RecordBatch) -> dict | None:
    found = forest(list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)))
    return {"a": [x for x, _ in found], "b": [y for _, y in found]} if found else None


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """edges: (a long, b long), in any direction; loops, repeats and nulls do no harm.

    Returns (node, root): each node that has an edge to another, with the least node of its
    component. Nodes without edges are not returned.
    """
    edges = arrow_map(edges.where("a is not null and b is not null and a != b").select("a", "b"), _local, "a long, b long")
    now, before, k = scratch.save(edges, f"{name}0"), None, 0
    while True:
        k += 1
        now = scratch.save(_small(_large(now)), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == before or not seen[0]:
            break
        before = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
