"""SimHash near-duplicates by anchor-point covering.

Fingerprints. h is the XXH64 (UTF-8, seed 42) of a shingle; a bit is set where over half of the
document's h have it, repeats counted. A text with fewer words than a shingle is one shingle; a
text without words (or null) has fingerprint zero, which links like any other.

Covering. The 64 bits are two halves of 32. Fingerprints that differ in 3 bits or fewer differ in
at most one bit of some half. In each half, 23 bits are covered by the perfect binary Golay code:
every word lies within radius 3 of exactly one codeword; the other 9 bits are their own anchors
(radius 0). A fingerprint is at home at the one anchor nearest to it, and is replicated to every
anchor within covering radius plus threshold that can be the home of a neighbour: 14 to 16 anchors
a half, out of 2^21. Two fingerprints within the threshold then meet at the home of the smaller
one. Comparison per anchor is an equi join, whose hot keys adaptive execution can split.

Copies collapse first: only distinct fingerprints are replicated, compared and linked. Links go to
components.py; documents get their component by a join on the fingerprint.

near_copies() is the form for the pipeline: shingles of five words, and a similarity of 0.8 or more.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, as_bytes
from .components import components

SEED = 42
AT_ONCE = 1 << 16
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([one(joined, SEED)], np.uint64)
    return np.array([one(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])], np.uint64)


def _widened(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """`words` signed 64-bit integers; memory stays bounded for any length of text."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), AT_ONCE):
            part = _widened(hashes[at : at + AT_ONCE], k).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(hashes)) if len(hashes) else np.zeros(8, np.uint8)
        out.append(int(bits.view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long) of each row's whole text. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(key), "fp": [fingerprint(shingle_hashes(x, shingle))[0] for x in as_bytes(batch, "t")]}

    return arrow_map(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")), kernel, f"{key} long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the bits of a 23-bit word, and the error pattern that each of the 2048 remainders stands for."""
    rest = []
    for i in range(23):
        x = 1 << i
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        rest.append(x)
    rest, wrong = np.array(rest, np.int64), np.zeros(2048, np.int64)
    for a in range(23):
        wrong[rest[a]] = 1 << a
        for b in range(a):
            wrong[rest[a] ^ rest[b]] = 1 << a | 1 << b
            for c in range(b):
                wrong[rest[a] ^ rest[b] ^ rest[c]] = 1 << a | 1 << b | 1 << c
    return rest, wrong


def nearest(x: np.ndarray) -> np.ndarray:
    """The one codeword within 3 bits of each 23-bit word."""
    rest, wrong = golay()
    syndrome = np.zeros_like(x)
    for i in range(23):
        syndrome ^= np.where(x >> i & 1, rest[i], 0)
    return x ^ wrong[syndrome]


def anchors(fps: np.ndarray, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of a fingerprint, anchor), for its homes or for every anchor in reach."""
    rows, keys = [], []
    for half in (0, 1):
        part = (fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        code, free = part & 0x7FFFFF, part >> 23
        key = lambda code, free, half=half: code | free << 23 | half << 32
        own = nearest(code)
        found = [key(own, free)]
        if not home_only:
            found += [key(nearest(code ^ (1 << i)), free) for i in range(23)] + [key(own, free ^ (1 << i)) for i in range(9)]
        grid = np.sort(np.stack(found, axis=1), axis=1)
        new = np.ones(grid.shape, bool)
        new[:, 1:] = grid[:, 1:] != grid[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(grid[new])
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): all pairs of different fingerprints (column fp, distinct) within `most` <= 3 bits, perhaps twice."""
    if not 0 <= most <= 3:
        raise ValueError("two halves with one bit each cover 3 differing bits")

    def at(name: str, home_only: bool) -> DataFrame:
        def kernel(batch: pa.RecordBatch) -> dict:
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = anchors(own, home_only)
            return {"anchor": pa.array(key), name: pa.array(own[row])}

        return arrow_map(fps.select("fp"), kernel, f"anchor long, {name} long")

    # Spark takes either side to be as large as fps and would broadcast 16 or more rows for each; shuffled, it holds no side whole.
    return at("a", True).join(at("b", False).hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("a", "b")


def groups(prints: DataFrame, scratch: Scratch, most: int = 3, key: str = "doc_id") -> DataFrame:
    """prints: (key, fp). Adds component_id: the smallest key reachable through links of `most` bits or fewer, itself included."""
    kinds = scratch.save(prints.groupBy("fp").agg(F.min(key).alias("first")), "kinds")
    linked = components(links(kinds, most), scratch)
    kinds = kinds.join(linked, kinds.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = kinds.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(scratch.save(kinds.join(least, "root").select("fp", "component_id"), "of_kind"), "fp").select(*prints.columns, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id), one row for each row of docs.

    Null and empty texts share fingerprint zero. Rows with a null key take part and get the
    component of their fingerprint. Repeated rows are repeated in the result. An empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    return groups(scratch.save(fingerprints(docs, shingle, text, key), "prints"), scratch, most, key)
