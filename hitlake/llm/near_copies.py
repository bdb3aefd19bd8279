"""Near copies for the pipeline: shingles of five words, Jaccard similarity of 0.8 or more.

Fingerprints are SimHashes of WORDS * 64 bits over five-word shingles. At similarity 0.8 about 39 of
256 bits differ, so no one covering holds every such pair; many do, each of a few sampled bits.
In each table 23 bits are covered by the binary Golay code (simhash.py): every word lies within
radius 3 of exactly one codeword, its anchor there; free bits, which are their own anchors, make
anchors as many as the corpus needs. The threshold of a table is 0, so a fingerprint is replicated
to one anchor a table: a threshold of 1 costs 17 times the rows for 2.5 times the chance. The number
of tables follows from the chance that a pair meets, so recall() is the same at every size.

1. Rows that meet at an anchor are compared, all with all, and those within LIMIT bits are loosely
   linked. Not the pairs leave, but a forest of them: at most one link a row and table.
2. Components of loose links are families. Within a family exact Jaccard over whole texts decides
   all pairs, as products of a sparse matrix; again a forest leaves.
3. Components of these links are the groups.

Anchors of more than HELD rows and families of more than BLOCK texts are dealt in blocks, each met
by each in a cell of its own. Copies of one sequence are one row throughout. In anchors that large, rows
are first linked to the nearest of the first ones and these links decided exactly: rows that they
join need no comparison among themselves, so a huge group of near copies costs what stands out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, as_bytes, give_back, prepare
from .components import components, forest
from .simhash import fingerprint, nearest, shingle_hashes

SHINGLE, LEAST = 5, 0.8
WORDS, LIMIT, CODE, RADIUS = 4, 52, 23, 3
PRINT = [f"f{k}" for k in range(WORDS)]
#: Unrelated rows that an anchor may hold, and the share of pairs of similarity LEAST that must meet.
ROWS, WANTED = 64, 0.95
#: Rows of an anchor that one task compares; texts and shingles of a block; comparisons at once; columns at once.
HELD, BLOCK, HEAVY, AT_ONCE, COLUMNS = 1 << 13, 1 << 10, 1 << 19, 1 << 18, 1 << 11


def free_bits(kinds: int) -> int:
    """Beside the code: so many that kinds of unrelated texts are ROWS an anchor at most."""
    return min(30, max(0, ceil(log2(max(kinds, 1) / ROWS)) - 12))


@cache
def _stays(flips: int) -> float:
    """The chance that a word of CODE bits keeps its codeword when so many of its bits flip."""
    total = 0.0
    for w in range(RADIUS + 1):  # words by their distance from the codeword
        inside = sum(comb(w, j) * comb(CODE - w, flips - j) for j in range(min(w, flips) + 1) if w + flips - 2 * j <= RADIUS and flips - j <= CODE - w)
        total += comb(CODE, w) * inside / comb(CODE, flips)
    return total / 2048


@cache
def _meets(differ: int, free: int) -> float:
    """The chance that two fingerprints which differ in so many bits share the anchor of a table."""
    n, rest = WORDS * 64, WORDS * 64 - CODE - free
    return sum(comb(CODE, t) * comb(rest, differ - t) * _stays(t) for t in range(min(CODE, differ) + 1)) / comb(n, differ)


def recall(similarity: float, free: int = 0, tables: int | None = None) -> float:
    """The share of pairs of this Jaccard similarity that are within LIMIT bits and share an anchor."""
    tables = n_tables(free) if tables is None else tables
    p = float(np.arccos(2 * similarity / (1 + similarity))) / pi
    n = WORDS * 64
    return sum(comb(n, d) * p**d * (1 - p) ** (n - d) * (1 - (1 - _meets(d, free)) ** tables) for d in range(LIMIT + 1))


@cache
def n_tables(free: int) -> int:
    tables = 1
    while recall(LEAST, free, tables) < WANTED:
        tables += max(1, tables // 40)
    return tables


def samples(free: int, seed: int = 29) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(WORDS * 64)[: CODE + free] for _ in range(n_tables(free))])


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, f0..): a hash of the word sequence, A-Z lower-cased, and the fingerprint. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch, "text")
        found = [fingerprint(shingle_hashes(x, SHINGLE), WORDS) for x in texts]
        return {"doc_id": batch.column("doc_id"), "whole": [_whole(x) for x in texts]} | {c: [f[k] for f in found] for k, c in enumerate(PRINT)}

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, whole binary, " + ", ".join(f"{c} long" for c in PRINT))


def _whole(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def anchored(kinds: DataFrame, free: int) -> DataFrame:
    """kinds: (rep, f0..). (anchor, rep, f0..), one row a table."""
    taken = samples(free)

    def kernel(batch: pa.RecordBatch) -> dict:
        f = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PRINT], axis=1)
        bits = np.unpackbits(f.astype(">i8").view(np.uint8).reshape(len(f), -1), axis=1)
        keys = []
        for k, t in enumerate(taken):
            own = bits[:, t].astype(np.int64) @ (1 << np.arange(CODE + free))
            keys.append(nearest(own & (1 << CODE) - 1) | own >> CODE << CODE | k << CODE + free)
        rows = np.tile(np.arange(len(f)), len(taken))
        return {"anchor": np.concatenate(keys), "rep": batch.column("rep").take(pa.array(rows))} | {c: f[rows, k] for k, c in enumerate(PRINT)}

    return arrow_map(kinds.select("rep", *PRINT), kernel, ", ".join(f"{c} long" for c in ("anchor", "rep", *PRINT)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count((a[..., k] ^ b[..., k]).view(np.uint64)).astype(np.uint16) for k in range(WORDS))


def loose(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a forest whose trees are the components of pairs within LIMIT bits."""
    left, a, b = np.arange(len(f)), [], []
    if len(f) ** 2 <= AT_ONCE:
        left = np.flatnonzero((_distance(f[:, None], f[None]) <= LIMIT).sum(1) > 1)
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            many, found = max(1, AT_ONCE // len(left)), []
            for s in range(0, len(edge), many):
                near = _distance(f[edge[s : s + many], None], f[None, left]) <= LIMIT
                hit = near.any(0)
                a.append(edge[s + near.argmax(0)[hit]])
                b.append(left[hit])
                found.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
                many = max(1, AT_ONCE // len(left)) if s + many >= len(edge) else many
            edge = np.concatenate(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Runs of equal keys within each batch: (key, rows, whether it may go on in the next batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
        start = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for s, e in zip(start, start[1:]):
            yield tuple(k[s].tolist()), batch.slice(s, e - s), e == len(k)


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in PRINT], axis=1)


def met(rows: DataFrame) -> DataFrame:
    """rows: (anchor, rep, f0..). (a, b, anchor): a forest of loose links for each anchor.

    Of an anchor of more than HELD rows, each row's link to the nearest of the first HELD rows, if it is loose,
    with the anchor's name.
    """
    none, held = pa.nulls, HELD

    def table(a: np.ndarray, b: np.ndarray, anchor: int | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), none(len(a), pa.int64()) if anchor is None else pa.array(np.full(len(a), anchor))], ["a", "b", "anchor"])

    def ended(parts: list) -> Iterator[pa.RecordBatch]:
        rep, f = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(rep) > 1:
            a, b = loose(f)
            if len(a):
                yield table(rep[a], rep[b], None)

    def star(parts: list, rep: np.ndarray, f: np.ndarray, anchor: int) -> Iterator[pa.RecordBatch]:
        heads, prints = parts[0]
        for s in range(0, len(rep), max(1, AT_ONCE // len(heads))):
            far = _distance(f[s : s + max(1, AT_ONCE // len(heads)), None], prints[None])
            at = far.argmin(1)
            ok = np.take_along_axis(far, at[:, None], 1)[:, 0] <= LIMIT
            # Rows without a near head are linked to themselves: the anchor is named in any case.
            own = rep[s : s + len(far)]
            yield table(np.where(ok, heads[at], own), own, anchor)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """All pairs of anchors with two rows at once; the rest in turn."""
            nonlocal last, parts, many
            key, rep, f = batch.column("anchor").to_numpy(), batch.column("rep").to_numpy(), _prints(batch)
            start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            end = np.append(start[1:], len(key))
            two = (end - start == 2) & (end < len(key)) & (key[start] != last)
            s = start[two]
            near = _distance(f[s], f[s + 1]) <= LIMIT
            if near.any():
                yield table(rep[s][near], rep[s + 1][near], None)
            rest = ~two & ((end - start > 2) | (end == len(key)) | (key[start] == last))
            for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True):
                if key[s] != last:
                    if parts and not many:
                        yield from ended(parts)
                    last, parts, many = int(key[s]), [], False
                if many:
                    yield from star(parts, rep[s:e], f[s:e], last)
                    continue
                parts.append((rep[s:e], f[s:e]))
                if sum(len(p[0]) for p in parts) > held:
                    rep_all, f_all = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts, many = [(rep_all[:held], f_all[:held])], True
                    a, b = loose(parts[0][1])
                    yield table(np.append(parts[0][0][a], rep_all[:1]), np.append(parts[0][0][b], rep_all[:1]), last)
                    yield from star(parts, rep_all[held:], f_all[held:], last)

        last, parts, many = None, [], False
        for batch in batches:
            if batch.num_rows:
                yield from of_batch(batch)
        if parts and not many:
            yield from ended(parts)
        give_back()

    prepare(rows.sparkSession)
    return _dealt(rows, ["anchor"], ["rep"]).mapInArrow(stream, "a long, b long, anchor long")


def _dealt(rows: DataFrame, key: list[str], order: list[str] = ()) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *key).sortWithinPartitions(*key, *order)


CELL = ["family", "low", "high"]


def _per_cell(rows: DataFrame, links: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows: CELL, rep and others. (a, b): what links() finds in each cell."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(parts: list) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            if rows.num_rows > 1:
                a, b = links(rows)
                if len(a):
                    rep = rows.column("rep").to_numpy()
                    yield pa.record_batch({"a": pa.array(rep[a]), "b": pa.array(rep[b])})

        last, parts = None, []
        for key, some, _ in _groups(batches, CELL):
            if key != last:
                if parts:
                    yield from ended(parts)
                last, parts = key, []
            parts.append(some)
        if parts:
            yield from ended(parts)
        give_back()

    prepare(rows.sparkSession)
    return _dealt(rows, CELL).mapInArrow(stream, "a long, b long")


def _pieces(n: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(weight / F.lit(HEAVY))).cast("long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows: (family, rep, root, weight, others). Adds low and high: the cells of families that are dealt in blocks.

    A root of more than a block has blocks of its own, which needn't meet; all others meet each other and themselves.
    """
    sizes = rows.groupBy("family", "root").agg(_pieces(F.count("*"), F.sum("weight")).alias("alone"), F.count("*").alias("n"), F.sum("weight").alias("w"))
    pool = sizes.where("alone <= 1").groupBy("family").agg(_pieces(F.sum("n"), F.sum("w")).alias("pool"))
    sizes = sizes.join(pool, "family", "left").select("family", "root", "alone", "pool")
    many = F.col("alone") > 1
    block = F.when(many, F.xxhash64("root", F.pmod(F.xxhash64("rep"), F.col("alone")))).otherwise(F.xxhash64(F.lit(None).cast("long"), F.pmod(F.xxhash64("root"), F.col("pool"))))
    rows = rows.join(sizes, ["family", "root"]).withColumn("block", block).withColumn("single", F.when(many, F.col("root"))).drop("alone", "pool")
    blocks = rows.select("family", "block", "single").distinct()
    one, two = (blocks.select("family", F.col("block").alias(c), F.col("single").alias(f"{c}_single")) for c in ("low", "high"))
    cells = one.join(two, "family").where("low <= high and (low_single is null or high_single is null or low_single != high_single)").select(*CELL)
    sides = cells.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    return rows.drop("single").join(sides, ["family", "block"])


def decided(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """rows: (rep, root, block, low, high, own: distinct shingles). Places (a, b): a forest of the pairs of exact Jaccard LEAST or more."""
    own, block = rows.column("own").combine_chunks(), rows.column("block").to_numpy()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    size = np.diff(own.offsets.to_numpy())
    word = own.flatten().to_numpy()
    text = np.repeat(np.arange(len(size)), size)
    _, at, count = np.unique(word, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    text = text[shared]
    _, at = np.unique(at[shared], return_inverse=True)
    x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
    both = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(at, kind="stable")
    at, text = at[order], text[order]
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        s, e = np.searchsorted(at, [c, c + COLUMNS])
        part = np.zeros((len(size), min(COLUMNS, int(at[-1]) + 1 - c)), np.float32)
        part[text[s:e], at[s:e] - c] = 1
        both += part[x] @ part[y].T
    sizes = size.astype(np.float64)
    root = rows.column("root").to_numpy()
    near = (both >= LEAST * (sizes[x][:, None] + sizes[y][None] - both)) & (root[x][:, None] != root[y][None]) & (both > 0)
    a, b = np.nonzero(near)
    a, b = x[a], y[b]
    found = np.array(forest(list(zip(a.tolist(), b.tolist(), strict=True))), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _sets(docs: DataFrame, of: DataFrame) -> DataFrame:
    """of: (rep, whole, others). Adds own, the distinct shingles as 64-bit hashes, and weight, their number."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch, "text")
        own = [np.unique(shingle_hashes(x, SHINGLE)).view(np.int64) for x in texts]
        return {"rep": batch.column("doc_id"), "whole": [_whole(x) for x in texts], "own": own, "weight": [len(x) for x in own]}

    texts = docs.join(of.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return arrow_map(texts, kernel, "rep long, whole binary, own array<long>, weight long").dropDuplicates(["rep", "whole"]).join(of, ["rep", "whole"])


def _alike(docs: DataFrame, links: DataFrame, kinds: DataFrame) -> DataFrame:
    """The links (a, b) whose exact Jaccard similarity is LEAST or more."""
    some = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).distinct()
    sets = _sets(docs, kinds.select("rep", "whole").join(some, "rep"))
    first, second = (sets.select(F.col("rep").alias(c), F.col("own").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    return links.join(first, "a").join(second, "b").where((shared > 0) & (shared >= LEAST * (F.size("x") + F.size("y") - shared))).select("a", "b")


def _rooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Adds root to rows with rep: that of linked (node, root), or rep itself."""
    return rows.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def links(docs: DataFrame, kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """kinds: (rep, whole, f0..). (a, b): links of similarity LEAST or more, a spanning forest of each group and perhaps others."""
    free = free_bits(kinds.count())
    found = scratch.save(met(anchored(kinds, free)), "met")
    large = found.where("anchor is not null")
    exact, open_ = None, found.select("a", "b")
    if not large.isEmpty():
        exact = scratch.save(_alike(docs, large.where("a != b").select("a", "b").distinct(), kinds), "stars_alike")
        near = scratch.save(components(exact, scratch, "stars"), "stars_linked")
        rows = anchored(kinds, free).join(large.select("anchor").distinct(), "anchor").withColumnRenamed("anchor", "family").withColumn("weight", F.lit(1).cast("long"))
        more = scratch.save(_per_cell(in_blocks(_rooted(rows, near)), lambda t: loose(np.stack([t.column(c).to_numpy() for c in PRINT], axis=1))), "met_in_blocks")
        open_ = open_.union(more)
    else:
        near = found.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    families = components(open_, scratch, "loose").withColumnRenamed("node", "rep").withColumnRenamed("root", "family")
    texts = scratch.save(_rooted(_sets(docs, kinds.select("rep", "whole").join(families, "rep")), near).drop("whole"), "texts")
    sizes = scratch.save(texts.groupBy("family").agg(_pieces(F.count("*"), F.sum("weight")).alias("pieces")).where("pieces > 1").select("family"), "large")
    zero = F.lit(0).cast("long")
    cells = texts.join(sizes, "family", "left_anti").select("*", zero.alias("low"), zero.alias("high"), zero.alias("block"))
    if not sizes.isEmpty():
        cells = cells.unionByName(in_blocks(texts.join(sizes, "family", "left_semi")))
    alike = scratch.save(_per_cell(cells, decided), "alike")
    for part in ("met", "texts", "met_in_blocks"):
        scratch.drop(part)
    return alike if exact is None else alike.union(exact)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id): the ids of docs (doc_id, text) that are a copy or near copy of a smaller one of their group, each once.

    Groups are the components of links. Null and empty texts are copies of each other. Rows without
    an id are no part of this, and stay; rows of one id are one document, judged by any of its texts.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.save(prints(docs), "prints")
    kinds = scratch.save(found.groupBy("whole").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in PRINT)), "kinds")
    linked = components(links(docs, kinds, scratch), scratch)
    facts = _rooted(found.select("doc_id", "whole").join(kinds.select("whole", "rep"), "whole").select("doc_id", "rep"), linked)
    facts = scratch.save(facts.where("doc_id > root").select("doc_id").distinct(), "removed")
    for part in ("prints", "kinds", "alike"):
        scratch.drop(part)
    return facts
