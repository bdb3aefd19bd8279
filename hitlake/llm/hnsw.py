"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which holds the `top` + 1 smallest of its ids: no result can need more.
Nodes are dealt to shards of about SHARD by a hash, and each shard becomes one row of flat arrays:
vectors, ids, and for each layer its nodes and a neighbour table of fixed width.

The largest inner product is the least distance once every vector is given one more coordinate that
brings it to the longest one's length, so graphs are built in that space, scaled to floats. Nodes have
layers by the usual geometric draw (from the id, so reruns agree). Layers are filled from the top;
nodes are inserted in small batches: they descend the layers above, search the layer as it is so
far with a beam of CANDIDATES, see the others of their batch, and take neighbours by the diversity rule;
the neighbours take them in turn, and choose anew where their table is full.

All queries of a block descend a graph together: greedy steps on the upper layers, then a beam of
BEAM on the lowest one, STEP nodes at a time. Where the last of the results has a cosine of 1 - CROWD or more
with the first, they are of a crowd of near copies, which a graph can't tell apart; such a query is
compared with the whole shard. Scores are inner products of the original vectors in double precision; results
of the shards are merged by score, ties to the smaller id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .projections import usable, vector

SHARD, BLOCK = 16384, 512
WIDTH, CANDIDATES, DIVERSE = 32, 64, 20
BEAM, STEP, TOP_LAYERS = 160, 4, 4
#: Nodes inserted together, and rows whose neighbours are chosen together.
BATCH, AT_ONCE = 512, 512
CROWD = 0.05


def _diverse(x: np.ndarray, own: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (places in x, -1: none) `keep`: nearest first those that no chosen one is nearer to, then the nearest of the rest."""
    out = np.full((len(own), keep), -1, np.int32)
    for at in range(0, len(own), AT_ONCE):
        c = near[at : at + AT_ONCE]
        v, to = x[c], np.einsum("nd,nkd->nk", x[own[at : at + AT_ONCE]], x[c])
        to[c < 0] = -np.inf
        order = np.argsort(-to, axis=1, kind="stable")
        c, to = np.take_along_axis(c, order, 1), np.take_along_axis(to, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = v @ v.transpose(0, 2, 1)
        picked, real = np.zeros(c.shape, bool), c >= 0
        for j in range(c.shape[1]):
            blocked = (picked & (between[:, j] > to[:, j, None])).any(1)
            picked[:, j] = real[:, j] & ~blocked & (picked.sum(1) < keep)
        first = np.argsort(~picked + 2 * ~real, axis=1, kind="stable")[:, :keep]
        got = np.where(np.take_along_axis(real, first, 1), np.take_along_axis(c, first, 1), -1)
        out[at : at + AT_ONCE, : got.shape[1]] = got
    return out


def _linked(x: np.ndarray, table: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Enters the neighbours of new nodes, and the nodes with their neighbours, who choose anew where their table is full."""
    table[new, : chosen.shape[1]] = chosen
    a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    if not len(b):
        return
    rank = np.lexsort((a, -np.einsum("nd,nd->n", x[a], x[b]), b))
    a, b = a[rank], b[rank]
    whose, start = np.unique(b, return_index=True)
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    fits = place < WIDTH  # of more new ones a node could keep WIDTH at most
    more = np.full((len(whose), min(WIDTH, int(place.max()) + 1)), -1, np.int32)
    more[np.searchsorted(whose, b[fits]), place[fits]] = a[fits]
    every = np.sort(np.concatenate([table[whose], more], axis=1), axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    table[whose] = _diverse(x, whose, every, WIDTH)


def build(x: np.ndarray, draw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """x: vectors; draw: a number from 0 to 1 for each. Layers from the top: nodes, and their neighbours as places in x."""
    x = x / max(float(np.abs(x).max()), 1e-300)
    longest = (x * x).sum(1)
    x = np.concatenate([x, np.sqrt(np.maximum(longest.max() - longest, 0))[:, None]], axis=1).astype(np.float32)
    level = np.minimum(TOP_LAYERS, np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(WIDTH / 2))).astype(int)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(level.max(), -1, -1):
        table = np.full((len(x), WIDTH), -1, np.int32)
        known = np.flatnonzero(level > k)
        if len(known):
            table[known] = layers[-1][1]
        fresh = np.flatnonzero(level == k)
        while len(fresh):
            some, fresh = np.split(fresh, [min(len(fresh), BATCH, max(16, len(known) // 2))])
            mates = x[some] @ x[some].T
            np.fill_diagonal(mates, -np.inf)
            most = min(CANDIDATES, len(some) - 1)
            near = some[np.argpartition(-mates, most - 1, axis=1)[:, :most]].astype(np.int32) if most else np.zeros((len(some), 0), np.int32)
            if len(known):
                at = _descended(x, layers, x[some]) if layers else np.full(len(some), known[0])
                found, _ = _beamed(x, table, x[some], at, CANDIDATES)
                near = np.concatenate([near, found], axis=1)
            _linked(x, table, some, _diverse(x, some, near, DIVERSE) if near.shape[1] else np.full((len(some), 1), -1, np.int32))
            known = np.concatenate([known, some])
        nodes = np.flatnonzero(level >= k)
        layers.append((nodes.astype(np.int32), table[nodes]))
    return layers


def _descended(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """Where greedy steps on these layers end for each query."""
    rows, at = np.arange(len(q)), np.full(len(q), layers[0][0][0])
    best = q @ x[at[0]]
    for nodes, table in layers:
        place = np.full(len(x), -1)
        place[nodes] = np.arange(len(nodes))
        while True:
            near = table[place[at]]
            score = np.where(near < 0, -np.inf, np.einsum("qd,qkd->qk", q, x[near]))
            k = score.argmax(1)
            better = score[rows, k] > best
            if not better.any():
                break
            at, best = np.where(better, near[rows, k], at), np.where(better, score[rows, k], best)
    return at


def _beamed(x: np.ndarray, table: np.ndarray, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A beam over one layer from a node for each query: nodes (-1: none) and scores, best first."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, at] = True
    ids, score = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -np.inf, np.float32)
    ids[:, 0], score[:, 0] = at, np.einsum("nd,nd->n", q, x[at])
    done = np.ones((len(q), beam), bool)
    done[:, 0] = False
    live = rows
    while len(live):
        own, sc, dn = ids[live], score[live], done[live]
        # Those of the beam that aren't expanded, best first.
        pick = np.argsort(dn, axis=1, kind="stable")[:, :STEP]
        fresh = ~np.take_along_axis(dn, pick, 1)
        np.put_along_axis(dn, pick, True, 1)
        near = np.where(fresh[:, :, None], table[np.take_along_axis(own, pick, 1)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[live[:, None], near]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("nd,nd->n", q[live[r]], x[near[r, c]])
        ids_all, sc_all = np.concatenate([own, np.where(new, near, -1)], 1), np.concatenate([sc, got], 1)
        dn_all = np.concatenate([dn, ~new], 1)
        order = np.argsort(-sc_all, axis=1, kind="stable")[:, :beam]
        ids[live], score[live], done[live] = (np.take_along_axis(z, order, 1) for z in (ids_all, sc_all, dn_all))
        live = live[~done[live].all(1)]
    return ids, score


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` nodes of largest inner product found for each query, best first (-1: none), and their scores (-inf)."""
    x = (x / max(float(np.abs(x).max()), 1e-300)).astype(np.float32)
    q = (q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)).astype(np.float32)
    beam = max(BEAM, 2 * top)
    ids, score = _beamed(x, layers[-1][1], q, _descended(x, layers[:-1], q) if layers[:-1] else np.full(len(q), layers[0][0][0]), beam)
    first, last = x[ids[:, 0]], x[ids[:, min(top, beam) - 1]]
    alike = np.einsum("nd,nd->n", first, last) >= (1 - CROWD) * np.linalg.norm(first, axis=1) * np.linalg.norm(last, axis=1)
    crowded = np.flatnonzero((ids[:, -1] >= 0) & alike)
    for at in range(0, len(crowded), 64):
        some = crowded[at : at + 64]
        every = q[some] @ x.T
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        found = np.take_along_axis(every, best, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        ids[some], score[some] = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
    return ids, score


def index(table: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    """One row a shard: length, shard, vectors (of the table's precision), ids and layers, as flat arrays."""
    own = Window.partitionBy("h", "vector").orderBy("vec_id")
    once = table.withColumn("h", F.xxhash64("vector")).groupBy("h", "vector", "vec_id").agg(F.count("*").alias("rows"))
    nodes = once.withColumn("k", F.row_number().over(own)).where(F.col("k") <= top + 1)
    nodes = nodes.groupBy("h", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.save(nodes.select("h", F.size("vector").alias("length"), "vector", "ids"), "nodes")
    shards = max(1, ceil(nodes.count() / SHARD))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h").reset_index(drop=True)
        x = np.stack(rows.vector.to_numpy())
        draw = (rows.h.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
        layers = build(x, draw)
        counts = rows.ids.map(len).to_numpy(np.int32)
        return pd.DataFrame({
            "length": [x.shape[1]], "shard": [rows.shard[0]], "vectors": [x.tobytes()], "counts": [counts.tobytes()],
            "ids": [np.concatenate(rows.ids.to_numpy()).astype(np.int64).tobytes()],
            "nodes": [[n.tobytes() for n, _ in layers]], "neighbours": [[t.tobytes() for _, t in layers]],
        })

    dealt = nodes.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    shape = "length int, shard int, vectors binary, counts binary, ids binary, nodes array<binary>, neighbours array<binary>"
    return scratch.save(dealt.groupBy("length", "shard").applyInPandas(shard, shape), "index")


def _asked(batch: pa.RecordBatch, top: int, kind: str) -> dict | None:
    """Each row: a shard and a block of queries."""
    out_q, out_v, out_s = [], [], []
    for r in batch.to_pylist():
        x = np.frombuffer(r["vectors"], kind).reshape(-1, r["length"])
        layers = [(np.frombuffer(n, np.int32), np.frombuffer(t, np.int32).reshape(-1, WIDTH)) for n, t in zip(r["nodes"], r["neighbours"], strict=True)]
        counts, ids = np.frombuffer(r["counts"], np.int32), np.frombuffer(r["ids"], np.int64)
        start = np.concatenate([[0], np.cumsum(counts)])
        names = np.array([q["vec_id"] for q in r["queries"]], np.int64)
        asked = np.array([q["vector"] for q in r["queries"]], np.float64)
        found, _ = search(x, layers, asked, top + 1)
        for name, q, own in zip(names.tolist(), asked, found, strict=True):
            own = own[own >= 0]
            exact = (x[own].astype(np.float64) * q).sum(1)
            who = np.concatenate([ids[start[k] : start[k + 1]] for k in own]) if len(own) else np.zeros(0, np.int64)
            what = np.repeat(exact, counts[own])
            what, who = what[who != name], who[who != name]
            order = np.lexsort((who, -what))[:top]
            out_q.append(np.full(len(order), name))
            out_v.append(who[order])
            out_s.append(what[order])
    return {"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)} if out_q else None


def nearest(table: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """table and queries: vec_id, embedding and others. (query_id, rank, vec_id, score): each query's `top` nearest found, never itself.

    Vectors that are null, zero or hold a null or a component that isn't finite take no part, nor do
    rows without an id; vectors of another length than the query's aren't candidates. Fewer
    candidates than `top` all return. Repeated rows are one candidate. An empty table gives an
    empty result.
    """
    scratch = Scratch(table.sparkSession, "hnsw")
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), vector(df).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    shards = index(clean(table), scratch, top)
    asked = clean(queries).distinct()
    blocks = max(1, ceil(asked.count() / BLOCK))
    asked = asked.groupBy(F.size("vector").alias("length"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    kind = "f4" if dict(table.dtypes)["embedding"] == "array<float>" else "f8"
    places = shards.select("length", F.col("shard").alias("to")).groupBy("length").agg(F.collect_set("to").alias("shards"))
    sent = asked.join(places, "length").select("length", F.explode("shards").alias("shard"), "queries")
    pairs = shards.join(sent, ["length", "shard"])
    found = arrow_map(pairs, lambda batch: _asked(batch, top, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
