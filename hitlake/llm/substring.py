"""Exact substring dedup: long word runs that also occur in a document with a smaller id go.

Every window of `window` words whose sequence also starts in a document with a smaller id is
removed, judged on the input. Finding them takes difference-cover anchors. A difference cover D of
the period v holds, for any two positions i and j, a shift s < v with both i + s and j + s in D
modulo v. So if two documents share a window, they share an aligned anchor: `window` - v + 1 words
that start at a cover position in both. Only |D| of v positions are hashed (6 of 31 for 50 words).

1. digests(): each row's word count and sequence hash. Copies of a whole sequence that have a
   window lose all their words to the first of them. Ids that stand on nothing else take no
   further part.
2. anchors, once a document; those in two documents or more are repeated (partial aggregation).
3. Documents with a repeated anchor are extended: only windows that hold one at a fitting place are
   hashed (96 bits), once a document, and compared with the least document of the same window.
4. The words under those windows go.

No stage forms pairs of documents, so a passage in a third of all documents costs one row for each
of its windows and documents; hot hashes meet only in partial aggregations and in joins that
adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, arrow_rows, as_bytes, memo

WINDOW = 50
#: Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MEMO, AT_ONCE = 1 << 16, 1 << 15
_memo = memo()
_powers = memo()


def period(window: int) -> int:
    """The largest period that leaves anchors of two fifths of the window at least."""
    return max(v for v in COVERS if 5 * (window - v + 1) >= 2 * window)


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    out = []
    for w in words:
        h = _memo.get(w)
        if h is None:
            h = _memo[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a block of rolling() needs."""
    if base not in _powers:
        back = pow(base, -1, 1 << 64)
        _powers[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * AT_ONCE - 1, b, np.uint64))]) for b in (base, back))
    return _powers[base]


def rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of `length` <= AT_ONCE words; the sums go in blocks, so that long texts take little beside."""
    up, down = _power(base)
    out = np.zeros(max(0, len(h) - length + 1), np.uint64)
    for at in range(0, len(out), AT_ONCE):
        own = h[at : at + AT_ONCE + length - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])
        x = (total[length:] - total[:-length]) * down[: len(own) - length + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[at : at + AT_ONCE] = x ^ (x >> np.uint64(29))
    return out


def windows(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, a 64-bit and a 32-bit hash."""
    second = rolling(h ^ (h >> np.uint64(31)), length, BASES[1])
    return rolling(h, length, BASES[0]).view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def digests(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Adds n_words, whole (hash of the word sequence) and whole_sha256. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> dict:
        seqs = [x.split() for x in as_bytes(batch, "text")]
        joined = [b" ".join(s) for s in seqs]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(s) for s in seqs], "whole": [xxhash.xxh3_128_digest(j) for j in joined], "whole_sha256": [hashlib.sha256(j).hexdigest() for j in joined]}

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, n_words long, whole binary, whole_sha256 string")


def with_sequence(docs: DataFrame, name: str) -> DataFrame:
    """docs, all columns, and the hash of the text's word sequence, as digests() has it. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(name, pa.array([xxhash.xxh3_128_digest(b" ".join(x.split())) for x in as_bytes(batch, "text")], pa.binary()))

    return arrow_rows(docs, kernel, f"`{name}` binary")


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, doc_id), each anchor once a row of docs. No shuffle."""
    v = period(window)
    cover, length = np.isin(np.arange(v), COVERS[v]), window - v + 1

    def kernel(batch: pa.RecordBatch) -> dict:
        found, ids = [], []
        for doc_id, x in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
            words = x.split()
            if len(words) >= window:
                own = rolling(word_hashes(words), length, BASES[0])
                found.append(np.unique(own[np.resize(cover, len(own))]))
                ids.append(np.full(len(found[-1]), doc_id, np.int64))
        return {"anchor": np.concatenate(found).view(np.int64), "doc_id": np.concatenate(ids)} if found else None

    return arrow_map(docs.where("doc_id is not null").select("doc_id", "text"), kernel, "anchor long, doc_id long")


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """docs: (doc_id, text, anchors). (w1, w2, doc_id) of the windows that hold a given anchor, once a row."""
    v = period(window)
    cover, length = np.isin(np.arange(v), COVERS[v]), window - v + 1

    def kernel(batch: pa.RecordBatch) -> dict:
        one, two, ids = [], [], []
        for doc_id, x, given in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), batch.column("anchors"), strict=True):
            h = word_hashes(x.split())
            if len(h) < window:
                continue
            own = rolling(h, length, BASES[0])
            hit = np.resize(cover, len(own)) & np.isin(own.view(np.int64), given.values.to_numpy())
            count = np.concatenate([[0], np.cumsum(hit)])
            at = np.flatnonzero(count[v:] - count[:-v])
            a, b = windows(h, window)
            _, first = np.unique(a[at], return_index=True)
            one.append(a[at][first])
            two.append(b[at][first])
            ids.append(np.full(len(first), doc_id, np.int64))
        return {"w1": np.concatenate(one), "w2": np.concatenate(two), "doc_id": np.concatenate(ids)} if one else None

    return arrow_map(docs, kernel, "w1 long, w2 int, doc_id long")


def _cleared(docs: DataFrame, window: int) -> DataFrame:
    """docs: (doc_id, text, gone: sorted windows to remove). (doc_id, whole, n_removed, kept)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "whole": [], "n_removed": [], "kept": []}
        for x, gone in zip(as_bytes(batch, "text"), batch.column("gone"), strict=True):
            words = x.split()
            a, _ = windows(word_hashes(words), window)
            step = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(np.isin(a, gone.values.to_numpy()))
            step[at] += 1
            step[at + window] -= 1
            kept = [w for w, n in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not n]
            out["whole"].append(xxhash.xxh3_128_digest(b" ".join(words)))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept))
        return out | {"kept": pa.array(out["kept"], pa.binary()).cast(pa.string())}

    return arrow_map(docs, kernel, "doc_id long, whole binary, n_removed long, kept string")


def changes(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The digests of docs (doc_id, text), and (doc_id, whole, n_removed, kept) of each sequence that loses words, once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    facts = scratch.save(digests(docs), "facts")
    long = facts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    firsts = long.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = scratch.save(long.join(firsts, "whole").where("doc_id > first").select("doc_id", "whole", "n_words").distinct(), "copies")

    found = scratch.save(anchors(docs, window), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    held = found.join(scratch.save(repeated, "repeated"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # An id may stand on other sequences too; only ids of nothing but copies take no further part.
    others = long.select("doc_id", "whole").distinct().join(copies, ["doc_id", "whole"], "left_anti").select("doc_id")
    done = copies.select("doc_id").distinct().join(others, "doc_id", "left_anti")
    held = scratch.save(held.join(done, "doc_id", "left_anti"), "held")
    scratch.drop("anchors")
    some = scratch.save(docs.join(held, "doc_id"), "some")

    own = scratch.save(_candidates(some, window), "windows")
    least = own.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    gone = own.join(least, ["w1", "w2"]).where("doc_id > first").groupBy("doc_id").agg(F.array_sort(F.collect_set("w1")).alias("gone"))
    gone = scratch.save(gone, "gone")
    scratch.drop("windows")
    cleared = _cleared(some.select("doc_id", "text").join(gone, "doc_id"), window).where("n_removed > 0")
    whole = copies.select("doc_id", "whole", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return facts, scratch.save(cleared.union(whole).dropDuplicates(["doc_id", "whole"]), "changed")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): one row for each row of docs.

    kept is the text of the words that stay, joined by one space, or null where no word goes and
    the text is as it was. A null text has no words. Rows without an id lose nothing and take
    nothing from others. Rows that share an id are one document to each other: neither takes words
    from the other. An empty table gives an empty result.
    """
    facts, changed = changes(docs, Scratch(docs.sparkSession, "substring"), window)
    return facts.join(changed, ["doc_id", "whole"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"), "kept"
    )
