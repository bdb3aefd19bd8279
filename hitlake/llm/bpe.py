"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

encode() adds ids, decode() turns them back into raw bytes. A null text is an empty one; a null
list of ids stays null. round_trip() does both in one worker, where only hashes of the bytes are wanted. Ids leave packed, as little-endian unsigned 32-bit integers: four bytes a
token, in the form that training jobs map into memory.

The rank file is read on the driver and broadcast: a vocabulary has a fixed size (under 1 MB for
50 thousand ranks, BOUND_BYTES at most), so executors need no copy of it.

Texts beyond `piece` characters are cut at safe boundaries before the library sees them, so its
working memory stays bounded. A cut is safe behind a letter or digit and before a space or line
feed: every alternative of the splitting pattern ends its match there, and none looks back, so the
parts have just the matches of the whole. A run without such a place is not cut.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, memo

BOUND_BYTES = 32 << 20
PIECE = 1 << 16
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])[ \n]")
_made = memo()


def encoding(ranks: bytes, pattern: str):
    """The library's encoder for a rank file's content; made once a partition."""
    import tiktoken

    key = hashlib.sha256(ranks).digest(), pattern
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def cut(text: str, piece: int) -> list[str]:
    """Parts of about `piece` characters, cut at safe boundaries only."""
    parts, at = [], 0
    while len(text) - at > piece:
        found = SAFE.search(text, at + piece)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def _ranks(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        ranks = file.read()
    if len(ranks) > BOUND_BYTES:
        raise ValueError(f"{path} is larger than {BOUND_BYTES} bytes, the bound for a broadcast")
    return docs.sparkSession.sparkContext.broadcast(ranks)


def _encoded(own, text: bytes, piece: int) -> np.ndarray:
    parts = [own.encode_to_numpy(p, disallowed_special=()) for p in cut(text.decode("utf-8", "replace"), piece)]
    return np.concatenate(parts).astype("<u4")


def _decoded(own, ids: np.ndarray) -> bytes:
    """The library makes a Python integer of each id, so long lists go in parts; bytes need no boundaries."""
    return b"".join(own.decode_bytes(ids[at : at + PIECE].tolist()) for at in range(0, len(ids), PIECE))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """(key, ids): the packed ids of each row's whole text, without special tokens. No shuffle."""
    ranks = _ranks(docs, path)

    def kernel(batch: pa.RecordBatch) -> dict:
        own = encoding(ranks.value, pattern)
        return {key: batch.column(key), "ids": [_encoded(own, x, piece).tobytes() for x in as_bytes(batch, "t")]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, F.col(text).alias("t")), kernel, f"{key} {kind}, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded: the raw bytes that the ids stand for, whether or not they are whole UTF-8."""
    ranks, names = _ranks(tokens, path), tokens.columns

    def kernel(batch: pa.RecordBatch) -> dict:
        own = encoding(ranks.value, pattern)
        raw = [None if x is None else _decoded(own, np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
        return {n: batch.column(n) for n in names} | {"decoded": raw}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    return arrow_map(tokens, kernel, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True, piece: int = PIECE) -> DataFrame:
    """(key, n_tokens, ids, ids_sha256, decoded_sha256): encode() and decode() in one worker, with the hashes of both results.

    Without `ids` the ids are left out.
    """
    ranks = _ranks(docs, path)

    def kernel(batch: pa.RecordBatch) -> dict:
        own = encoding(ranks.value, pattern)
        out: dict = {key: batch.column(key), "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for x in as_bytes(batch, "t"):
            found = _encoded(own, x, piece)
            out["n_tokens"].append(len(found))
            out["ids"].append(found.tobytes() if ids else None)
            out["ids_sha256"].append(hashlib.sha256(found).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(_decoded(own, found)).hexdigest())
        return out

    kind = docs.schema[key].dataType.simpleString()
    made = arrow_map(docs.select(key, F.col(text).alias("t")), kernel, f"{key} {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return made if ids else made.drop("ids")


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
