"""Embedding near-dedup by collision-counting projections.

Vectors are compared within a label (and a length) by cosine. Equal vectors are one kind with a
count; only kinds are compared. Unit vectors with a cosine of at least `least` lie within
sqrt(2 - 2 least) of each other, so their projections on a Gaussian direction differ by a normal
variable of at most that deviation. All windows and counts follow from it and from LOSS, the share
of pairs at the threshold that each step may lose:

1. A few of the sorted one-dimensional projections are cut into cells. A kind is at home in the
   cell of its projections and is also sent to every cell that its window reaches, so near pairs
   meet once, at the home of the one with the smaller id. Cells are larger than the windows.
2. In a cell, MANY further projections are sorted; windows centred on the home kinds are looked up
   in each, and collisions are counted for each pair.
3. Pairs that reach the calibrated count are verified by exact cosine in double precision.

Cells with more than BLOCK kinds are dealt out as blocks against blocks, each a group of its own,
so no task gets an unbounded group. A group returns counts for its kinds and a spanning forest of
its links, never its pairs.
"""

from __future__ import annotations

from math import ceil, comb, log
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, memo
from .components import components, forest

MANY, LOSS, BLOCK, FEW = 24, 1e-4, 2048, 600
VERIFIED_AT_ONCE = 1 << 16
#: Numbers of cells are mixed from their places, for any number of cuts.
MIXER = 0x9E3779B97F4A7C15


def level(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def directions(seed: int, n: int, length: int) -> np.ndarray:
    """n Gaussian directions, as the columns."""
    return np.random.default_rng([seed, length]).standard_normal((length, n))


def reach(least: float, cuts: int) -> float:
    """Half the window in which a near pair falls for all cuts, but for the loss."""
    return NormalDist().inv_cdf(1 - LOSS / (2 * cuts)) * (2 - 2 * least) ** 0.5


def calibrated(least: float) -> tuple[float, int]:
    """Half the counting window, and the count that near pairs reach but for the loss."""
    wide = 2 * (2 - 2 * least) ** 0.5
    p = NormalDist().cdf(2) - NormalDist().cdf(-2)
    missed = 0.0
    for count in range(MANY + 1):
        missed += comb(MANY, count) * p**count * (1 - p) ** (MANY - count)
        if missed > LOSS:
            return wide, count
    return wide, MANY


def vector(table: DataFrame, column: str = "embedding") -> Column:
    """The vectors with the components they have: floats stay floats, all else becomes double."""
    return F.col(column).cast("array<float>" if table.schema[column].dataType.simpleString() == "array<float>" else "array<double>")


def usable(vector: Column) -> Column:
    """True unless the vector is null, empty, zero, or holds a null or a component that isn't finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sent(kinds: DataFrame, least: float, cuts: int, seed: int) -> DataFrame:
    """Every kind at its home cell and at those its window reaches."""
    half = reach(least, cuts)
    wide = 2.5 * half

    def kernel(batch: pa.RecordBatch) -> dict:
        vectors = batch.column("vector").to_pylist()
        row, cell, home = [], [], []
        for i, v in enumerate(vectors):
            x = level(np.array(v, np.float64))
            p = x / np.linalg.norm(x) @ directions_of(seed, cuts, len(x))
            keys, own = np.zeros(1, np.uint64), 0
            for at in p:
                places = np.arange(int(np.floor((at - half) / wide)), int(np.floor((at + half) / wide)) + 1) + 64
                keys = (keys[:, None] * np.uint64(MIXER) + places[None].astype(np.uint64)).ravel()
                own = (own * MIXER + int(np.floor(at / wide)) + 64) & (1 << 64) - 1
            keys = np.unique(keys)
            row += [i] * len(keys)
            cell += keys.view(np.int64).tolist()
            home += (keys == np.uint64(own)).tolist()
        row = pa.array(row, pa.int32())
        return {c: batch.column(c).take(row) for c in ("label", "length", "rep", "n", "vector")} | {"cell": cell, "home": home}

    return arrow_map(kinds, kernel, f"label string, length int, rep long, n long, vector {kinds.schema['vector'].dataType.simpleString()}, cell long, home boolean")


_drawn = memo()


def directions_of(seed: int, n: int, length: int) -> np.ndarray:
    if (seed, n, length) not in _drawn:
        _drawn[seed, n, length] = directions(seed, n, length)
    return _drawn[seed, n, length]


def collisions(home: np.ndarray, other: np.ndarray, half: float) -> np.ndarray:
    """For each pair of rows, in how many columns other lies within the window centred on home."""
    found = np.zeros((len(home), len(other)), np.uint8)
    for k in range(home.shape[1]):
        order = np.argsort(other[:, k], kind="stable")
        rank = np.empty(len(other), np.int32)
        rank[order] = np.arange(len(other), dtype=np.int32)
        low = np.searchsorted(other[order, k], home[:, k] - half, "left").astype(np.int32)
        high = np.searchsorted(other[order, k], home[:, k] + half, "right").astype(np.int32)
        found += (rank[None] >= low[:, None]) & (rank[None] < high[:, None])
    return found


def _compared(rows: pd.DataFrame, least: float, seed: int) -> pd.DataFrame:
    home, other = rows[rows.home], rows[~rows.home]
    if not len(home) or not len(other):
        return pd.DataFrame({"a": [], "b": [], "more": []})
    x, y = (level(np.stack(rows.vector.to_numpy()).astype(np.float64)) for rows in (home, other))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    g, (half, enough) = directions_of(seed + 1, MANY, x.shape[1]), calibrated(least)
    a, b, na, nb = home.rep.to_numpy(), other.rep.to_numpy(), home.n.to_numpy(), other.n.to_numpy()
    met = (collisions(x / nx[:, None] @ g, y / ny[:, None] @ g, half) >= enough) & (a[:, None] < b[None])
    i, j = np.nonzero(met)
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), VERIFIED_AT_ONCE):
        p, q = i[at : at + VERIFIED_AT_ONCE], j[at : at + VERIFIED_AT_ONCE]
        good[at : at + VERIFIED_AT_ONCE] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= least
    i, j = i[good], j[good]
    more_a, more_b = np.bincount(i, nb[j], len(a)), np.bincount(j, na[i], len(b))
    tied = forest(list(zip(a[i].tolist(), b[j].tolist(), strict=True)))
    own = [(int(r), None, int(m)) for r, m in [*zip(a, more_a, strict=True), *zip(b, more_b, strict=True)] if m]
    return pd.DataFrame([*own, *((p, q, 0) for p, q in tied)], columns=["a", "b", "more"]).astype({"a": "Int64", "b": "Int64", "more": "Int64"})


def near_duplicates(table: DataFrame, least: float = 0.98, seed: int = 3) -> DataFrame:
    """table: vec_id, embedding, label and others. One row for each row of table.

    n_links: other rows linked directly; component_id: the smallest vec_id reachable; kept: whether
    that is the row's own. Vectors that aren't usable, and rows without a label, link with nothing.
    Rows without a vec_id take no part: n_links 0, component_id null, kept false. Vectors of different
    lengths don't link. Repeated rows are vectors of their own, equal ones. An empty table gives an
    empty result.
    """
    scratch = Scratch(table.sparkSession, "projections")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector(table).alias("vector"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    kinds = rows.where(fine).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    kinds = scratch.save(kinds.select("label", F.size("vector").alias("length"), "rep", "n", "vector"), "kinds")
    largest = kinds.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 1
    cuts = max(1, ceil(log(max(largest, FEW) / FEW) / log(2.2)))
    sent = scratch.save(_sent(kinds, least, cuts, seed), "sent")

    cell = ["label", "length", "cell"]
    blocks = sent.groupBy(cell).agg(F.count_if("home").alias("at_home"), F.count("*").alias("all")).where("at_home > 0 and all > 1")
    blocks = scratch.save(blocks.select(*cell, F.ceil(F.col("at_home") / BLOCK).cast("int").alias("h"), F.ceil(F.col("all") / BLOCK).cast("int").alias("r")), "blocks")
    dealt = sent.join(blocks, cell)
    own = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("int")
    homes = dealt.where("home").select(*cell, (own % F.col("h")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("j"), "rep", "n", "vector", F.lit(True).alias("home"))
    others = dealt.select(*cell, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i"), (own % F.col("r")).alias("j"), "rep", "n", "vector", F.lit(False).alias("home"))
    found = homes.union(others).groupBy(*cell, "i", "j").applyInPandas(lambda rows: _compared(rows, least, seed), "a long, b long, more long")
    found = scratch.save(found, "found")

    linked = components(found.where("b is not null"), scratch)
    degrees = found.where("b is null").groupBy("a").agg(F.sum("more").alias("more"))
    facts = kinds.join(degrees, kinds.rep == degrees.a, "left").join(linked, kinds.rep == linked.node, "left")
    facts = facts.select("label", "vector", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    some = rows.where(fine).join(scratch.save(facts, "facts"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    none = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
