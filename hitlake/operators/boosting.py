"""Boosted trees of several folds and seeds, fitted side by side from one binned table.

Features are binned once: 254 edges a feature and seed, at exact quantiles of all rows; the seed moves the
quantiles that the edges stand at. A row is then one byte a feature; equal rows of a fold and label meet and are
counted, so what travels to the fits, (folds - 1) x seeds times, is blocks of different rows and how often each
stands. Each fit is one task over the rows of the other folds, all in parallel in one job, about 100 bytes a different row with its
working arrays. Where a fit would have more than MOST different rows, no task holds them: the blocks stay dealt, all fits grow
together, and each job adds up what tasks measure of the nodes that may be split next. All rows teach either way. Scoring is one pass
without a shuffle; equal rows of a batch are scored once.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees
from ..schema import finite
from ..shared import Tables, saved
from ..shipping import ship
from .ranks import quantiles

#: Different rows of a fit that is one task; edges of a feature; rows of a block; rounds after which fits that grow together store their scores.
MOST, EDGES, BLOCK, STORED = 4_000_000, 254, 8192, 10


@dataclass
class Model:
    """One fitted forest and the edges that its features are binned by."""

    edges: list[np.ndarray]
    forest: trees.Forest

    def probability(self, x: np.ndarray) -> np.ndarray:
        return trees.probability(self.forest, trees.binned(x, self.edges))


def _edges(df: DataFrame, features: list[str], seeds: list[int]) -> dict[int, list[np.ndarray]]:
    places = {s: (np.arange(EDGES) + np.random.default_rng(s).random()) / EDGES for s in seeds}
    row = quantiles(df, {c: c for c in features}, np.concatenate([places[s] for s in seeds]).tolist())
    out: dict[int, list[np.ndarray]] = {}
    for i, s in enumerate(seeds):
        out[s] = []
        for j in range(len(features)):
            v = np.unique(np.array((row[features[j]] or [])[i * EDGES : (i + 1) * EDGES], float))
            out[s].append((v[:-1] + v[1:]) / 2)  # between values, so that rounding of one doesn't move it
    return out


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash to n different partitions: jobs as long as these shouldn't share a task while others have none."""
    found = spark.range(64 * n).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
    return [r.id for r in sorted(found, key=lambda r: r.p)] if len(found) == n else list(range(n))


def fit(df: DataFrame, features: list[str], folds: int, seeds: list[int], rounds: int, most: int = MOST) -> dict[int, list[Model]]:
    """df: label (0 or 1), fold (from 0) and the features. For each fold a model a seed, learned from the rows of all other folds.

    Each needs rows of both labels in the other folds. Values that aren't finite are missing, and each
    split learns where they go.
    """
    ship(df.sparkSession)
    df = saved(df.select(F.col("label").cast("int").alias("label"), "fold", *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features))), "training")
    names = [f"x{j}" for j in range(len(features))]
    edges = _edges(df, names, seeds)
    sent = df.sparkSession.sparkContext.broadcast(edges)

    def pack(batches):
        for batch in batches:
            x = batch[names].to_numpy(float)
            for s, e in sent.value.items():
                bins = np.ascontiguousarray(trees.binned(x, e)).view(np.dtype((np.void, len(names)))).ravel()
                yield pd.DataFrame({"fold": batch.fold.to_numpy(np.int32), "seed": np.int32(s), "label": batch.label.to_numpy(np.int32), "bins": [b.tobytes() for b in bins]})

    def join(groups):
        """Rows that are equal once they are binned have met; they go to the fits in blocks."""
        for batch in groups:
            for (fold, s), own in batch.groupby(["fold", "seed"]):
                for a in range(0, len(own), BLOCK):
                    part = own.iloc[a : a + BLOCK]
                    yield pd.DataFrame({"fold": [int(fold)], "seed": [int(s)], "top": [max(map(max, part.bins))], "y": [part.label.to_numpy(np.uint8).tobytes()], "times": [part.times.to_numpy(np.int64).tobytes()], "bins": [b"".join(part.bins)]})

    def boost(blocks: pa.Table) -> pa.Table:
        y = np.frombuffer(b"".join(blocks["y"].to_pylist()), np.uint8).astype(float)
        times = np.frombuffer(b"".join(blocks["times"].to_pylist()), np.int64).astype(float)
        bins = np.frombuffer(b"".join(blocks["bins"].to_pylist()), np.uint8).reshape(len(y), -1)
        order = np.lexsort((y, *bins.T))  # the same sums, however the rows were dealt
        forest = trees.boost(np.asfortranarray(bins[order]), y[order], rounds, times=times[order])
        return pa.table({"model": pa.array([blocks["model"][0].as_py()], pa.int32()), "seed": pa.array([blocks["seed"][0].as_py()], pa.int32()), "forest": pa.array([pickle.dumps(forest)], pa.binary())})

    met = df.mapInPandas(pack, "fold int, seed int, label int, bins binary").groupBy("fold", "seed", "label", "bins").agg(F.count("*").alias("times"))
    met = saved(met, "binned")
    sizes = met.groupBy("fold", "seed").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()  # a row a fold and seed
    blocks = met.mapInPandas(join, "fold int, seed int, top int, y binary, times binary, bins binary")
    if max((sum(r.n for r in sizes if r.seed == s and r.fold != k) for k in range(folds) for s in seeds), default=0) > most:
        taught = {(k, r.seed) for k in range(folds) for r in sizes if r.fold != k}
        found = _together(blocks, folds, len(names), sorted(taught), rounds, sum(r.times for r in sizes) // len(seeds))
        return {k: [Model(edges[s], found[k, s]) for s in seeds if (k, s) in found] for k in range(folds)}
    dealt = blocks.withColumn("model", F.explode(F.array(*(F.lit(k) for k in range(folds))))).where("model <> fold")
    jobs = folds * len(seeds)
    places = {s: i for i, s in enumerate(seeds)}
    job = F.col("model") * len(seeds) + F.coalesce(*(F.when(F.col("seed") == s, i) for s, i in places.items()))
    slots = F.array(*map(F.lit, _apart(df.sparkSession, jobs)))
    made = dealt.withColumn("slot", slots[job]).repartition(jobs, "slot").groupBy("slot").applyInArrow(boost, "model int, seed int, forest binary").collect()  # a row a model
    found = {(r.model, r.seed): pickle.loads(r.forest) for r in made}
    return {k: [Model(edges[s], found[k, s]) for s in seeds if (k, s) in found] for k in range(folds)}


def _together(blocks: DataFrame, folds: int, features: int, models: list[tuple[int, int]], rounds: int, times: int) -> dict[tuple[int, int], trees.Forest]:
    """The forest of each model (fold, seed), grown from blocks that stay where they are.

    A job a set of nodes: tasks add up histograms of their blocks, groups add up the tasks', and the driver gets the best split of
    each node. Gradients are rounded to so few bits that their sums are exact, so it doesn't matter how the blocks were dealt.
    """
    kept, unit = Tables(blocks.sparkSession, "boosting"), 2.0 ** (51 - int(max(times, 1)).bit_length())
    shape = "fold int, seed int, top int, y binary, times binary, bins binary, raw binary"
    grown: dict[tuple[int, int], list] = {m: [] for m in models}

    def rows(batches, since):
        """Each block with the scores so far of the models that it teaches."""
        for batch in batches:
            for r in batch.itertuples(index=False):
                y, n = np.frombuffer(r.y, np.uint8), len(r.y)
                bins = np.asfortranarray(np.frombuffer(r.bins, np.uint8).reshape(n, features))
                raw = np.zeros((folds, n)) if r.raw is None else np.frombuffer(r.raw).reshape(folds, n).copy()
                own = [k for k in range(folds) if k != r.fold]
                for k in own:
                    raw[k] += trees.raw_scores(since[k, r.seed], bins)
                yield r, own, bins, y, np.frombuffer(r.times, np.int64).astype(float), raw

    def stored(state, since):
        def add(batches):
            for r, _, _, _, _, raw in rows(batches, since):
                yield pd.DataFrame([r._replace(raw=raw.tobytes())])

        return kept.save(state.mapInPandas(add, shape), "state")

    def best(parts: pd.DataFrame) -> pd.DataFrame:
        hist = sum(np.frombuffer(b).reshape(3, features, -1) for b in parts["hist"])
        gain, j, b, missing_left, value = trees.measured(hist)
        return pd.DataFrame({"model": parts.model[:1], "seed": parts.seed[:1], "node": parts.node[:1], "gain": gain, "feature": j, "bin": b, "missing_left": missing_left, "leaf": value})

    def measure(state, since, growing, asked):
        nodes = {m: t.nodes for m, t in growing.items()}

        def add(batches):
            total: dict = {}
            for r, own, bins, y, often, raw in rows(batches, since):
                for k in own:
                    if not asked[k, r.seed]:
                        continue
                    p = 1 / (1 + np.exp(-raw[k]))
                    g, h = np.rint((p - y) * unit) / unit * often, np.rint(p * (1 - p) * unit) / unit * often
                    at = trees.parts(nodes[k, r.seed], bins)
                    for node in asked[k, r.seed]:
                        hist = trees._histogram(bins, at[node], g, h, width[k, r.seed], often)
                        key = k, r.seed, node
                        total[key] = total[key] + hist if key in total else hist
            for (k, s, node), hist in total.items():
                yield pd.DataFrame({"model": np.int32(k), "seed": np.int32(s), "node": np.int32(node), "hist": [hist.tobytes()]})

        sums = state.mapInPandas(add, "model int, seed int, node int, hist binary").groupBy("model", "seed", "node")
        for r in sums.applyInPandas(best, "model int, seed int, node int, gain double, feature int, bin int, missing_left boolean, leaf double").collect():  # a row a node
            growing[r.model, r.seed].known[r.node] = (r.gain, r.feature, r.bin, r.missing_left, r.leaf)

    state = kept.save(blocks.withColumn("raw", F.lit(None).cast("binary")).repartition(blocks.sparkSession.sparkContext.defaultParallelism), "state")
    tops = state.groupBy("fold", "seed").agg(F.max("top").alias("top")).collect()  # a row a fold and seed
    width = {(k, s): max(3, 1 + max(r.top for r in tops if r.seed == s and r.fold != k)) for k, s in models}
    done = 0
    for k in range(rounds):
        growing = {m: trees.Growing() for m in models}
        since = {m: trees.stacked(0.0, t[done:]) for m, t in grown.items()}
        while any((asked := {m: t.asks() for m, t in growing.items()}).values()):
            measure(state, since, growing, asked)
        for m, t in growing.items():
            grown[m].append(t.tree())
        if (k + 1) % STORED == 0 and k + 1 < rounds:
            last, state, done = state, stored(state, {m: trees.stacked(0.0, t[done:]) for m, t in grown.items()}), k + 1
            kept.drop(last)
    kept.drop(state)
    return {m: trees.stacked(0.0, t) for m, t in grown.items()}


def score(df: DataFrame, models: dict[int, list[Model]], features: list[str], fold: Column) -> Column:
    """The mean probability of a fold's models, or of all models where fold is null."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def mean(folds: pd.Series, values: pd.Series) -> pd.Series:
        x, of = np.array(values.tolist(), float).reshape(len(values), -1), folds.to_numpy(float)
        out, n = np.zeros(len(x)), np.zeros(len(x))
        for k, own in sent.value.items():
            at = np.flatnonzero(np.isnan(of) | (of == k))
            for m in own if len(at) else ():
                out[at] += m.probability(x[at])
                n[at] += 1
        return pd.Series(out / np.maximum(n, 1))

    return mean(fold.cast("double"), F.array(*(F.when(finite(c), F.col(c).cast("double")) for c in features)))
