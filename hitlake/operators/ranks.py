"""Exact quantiles of many columns at once, by passes of counts over ever narrower ranges.

A double's bits, with the negative ones turned round, sort as the number does. The first pass counts values by their
first bits; the next ones count, by the bits that follow, only values in ranges that hold a wanted rank. As
soon as a column's ranges hold few values, these are counted themselves. Every pass is one job over
all columns. A task holds counts, never values, so neither the rows nor ties decide what it needs, and
what is shuffled grows with tasks, columns and ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import finite
from ..shipping import ship

#: Bits of the first pass (the sign, the exponent and two more), and of each later one.
FIRST, STEP = 14, 10
#: Values of a column that may be counted one by one.
FEW = 100_000
#: Ranges that are searched at once in a run of passes; columns beyond that take a run of their own.
RANGES = 4096


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the finite doubles; both zeros are one."""
    bits = (np.asarray(x, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_keys(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(float)


@dataclass
class _Search:
    """Where a column's wanted ranks lie: ranges by their first bits, and the values below each."""

    points: list[float]
    counted: bool = False  # the points are ranks from 0
    bits: int = 0
    whole: bool = False
    n: int = 0
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    below: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    values: np.ndarray | None = None

    def width(self) -> int:
        return min(STEP, 64 - self.bits) if self.bits else FIRST

    def places(self) -> np.ndarray:
        at = np.array(self.points, float)
        return np.clip(at, 0, max(self.n - 1, 0)) if self.counted else (self.n - 1) * at

    def start(self, n: int) -> None:
        self.n = n
        at = self.places()
        self.ranks = np.unique(np.concatenate([np.floor(at), np.ceil(at)]).astype(np.int64)) if n else np.zeros(0, np.int64)
        self.prefix, self.below = np.zeros(len(self.ranks), np.uint64), np.zeros(len(self.ranks), np.int64)

    def narrow(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """codes: the range's place among the distinct ones, then the bits that follow (or whole keys)."""
        if not self.bits:
            self.start(int(counts.sum()))
        if not self.n:
            self.values = np.zeros(0)
            return
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        ends = np.cumsum(counts)
        if self.whole:
            # The ranges follow each other, so ranks among their values are ranks less what lies between the ranges.
            first = np.searchsorted(codes >> np.uint64(64 - self.bits), self.prefix)
            base = np.concatenate([[0], ends])[first]
            self.values = from_keys(codes[np.searchsorted(ends, self.ranks - self.below + base, side="right")])
            return
        width = self.width()
        place = np.unique(self.prefix, return_inverse=True)[1].astype(np.uint64)
        base = np.concatenate([[0], ends])[np.searchsorted(codes >> np.uint64(width), place)]
        hit = np.searchsorted(ends, self.ranks - self.below + base, side="right")
        self.below += ends[hit] - counts[hit] - base
        self.prefix = (self.prefix << np.uint64(width)) | (codes[hit] & np.uint64((1 << width) - 1))
        self.bits += width
        if self.bits == 64:
            self.values = from_keys(self.prefix)
        elif counts[np.unique(hit)].sum() <= FEW:
            self.whole = True

    def result(self) -> list[float] | None:
        """Values at the points, between neighbouring ranks in proportion."""
        if not self.n:
            return None
        at = self.places()
        low, high = np.floor(at), np.ceil(at)
        a, b = (self.values[np.searchsorted(self.ranks, k.astype(np.int64))] for k in (low, high))
        with np.errstate(over="ignore"):
            return np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b).tolist()


def _counts(x: DataFrame, searches: list[_Search]) -> pd.DataFrame:
    """(j, code, n) of one pass."""
    sent = x.sparkSession.sparkContext.broadcast([(s.bits, s.width(), s.whole, np.unique(s.prefix)) if s.values is None else None for s in searches])

    def count(batches):
        asked = sent.value
        dense = [None if a is None or a[2] else np.zeros(len(a[3]) << a[1], np.int64) for a in asked]
        single: list[list] = [[] for _ in asked]
        for batch in batches:
            for j, a in enumerate(asked):
                if a is None:
                    continue
                bits, width, whole, ranges = a
                keys = batch[f"c{j}"].to_numpy(float)
                keys = sort_keys(keys[np.isfinite(keys)])
                if bits:
                    head = keys >> np.uint64(64 - bits)
                    place = np.minimum(np.searchsorted(ranges, head), len(ranges) - 1)
                    inside = ranges[place] == head
                    keys, place = keys[inside], place[inside]
                else:
                    place = np.zeros(len(keys), np.int64)
                if whole:
                    single[j].append(keys)  # FEW of a column at most, over all tasks
                else:
                    following = (keys >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)
                    dense[j] += np.bincount((place << width) + following.astype(np.int64), minlength=len(dense[j]))
        for j, d in enumerate(dense):
            if d is not None:
                codes = np.flatnonzero(d)
                yield pd.DataFrame({"j": np.int32(j), "code": codes, "n": d[codes]})
            elif single[j]:
                keys, n = np.unique(np.concatenate(single[j]), return_counts=True)
                yield pd.DataFrame({"j": np.int32(j), "code": keys.view(np.int64), "n": n})

    # At most the bins of the ranges, or FEW values, a column: bounded by RANGES, STEP and FEW.
    return x.mapInPandas(count, "j int, code long, n long").groupBy("j", "code").agg(F.sum("n").alias("n")).toPandas()


def at_ranks(df: DataFrame, column: Column | str, ranks: list[int]) -> list[float] | None:
    """The finite values of given ranks, from 0; ranks beyond the last take that."""
    return quantiles(df, {"x": column}, ranks, counted=True)["x"]


def quantiles(df: DataFrame, columns: dict[str, Column | str], points: list[float], counted: bool = False) -> dict[str, list[float] | None]:
    """The finite values' exact quantiles of each column, as `percentile` gives them; None where there is no value.

    columns: a name and what is measured. df is read once a pass: two of them for small tables, four or five for
    large ones (six at most, whatever the values are). counted: the points are ranks. Nulls, NaN and infinities count for nothing.
    """
    ship(df.sparkSession)
    names, out, most = list(columns), {}, max(1, RANGES // max(1, 2 * len(points)))
    for s in range(0, len(names), most):
        some = names[s : s + most]
        given = [F.col(c) if isinstance(c, str) else c for c in (columns[n] for n in some)]
        x = df.select(*(c.cast("double").alias(f"c{j}") for j, c in enumerate(given)))
        x = x.select(*(F.when(finite(c), F.col(c)).alias(c) for c in x.columns))
        searches = [_Search(list(points), counted) for _ in some]
        while any(t.values is None for t in searches):
            found = _counts(x, searches)
            for j, t in enumerate(searches):
                if t.values is None:
                    own = found[found.j == j]
                    t.narrow(own.code.to_numpy(np.int64).view(np.uint64), own.n.to_numpy(np.int64))
        out |= {n: t.result() for n, t in zip(some, searches, strict=True)}
    return out
