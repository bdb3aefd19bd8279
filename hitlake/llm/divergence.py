"""Source divergence audit: how the sources of a language differ in their terms.

Terms are runs of letters and of bytes beyond ASCII, A-Z lower-cased. A worker looks all bytes of a
batch up in one table, finds the boundaries of terms in the whole buffer at once, groups the slices
by XXH3 and compares each slice byte by byte with the first of its group; slices that differ (hash
collisions) are told apart by their bytes. What leaves is one row for each term of each (language,
source) in a batch, so documents don't meet.

Each language keeps the terms in at least `least` of its documents (rows count as documents). With
N occurrences of kept terms and V kept terms, a term's share of a group is
p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), in whole numbers throughout.

divergences() compares all sources of a language. Terms are dealt to blocks of about BLOCK terms,
sources to tiles of about TILE; a task has one block of two tiles as a CSR matrix and adds
|p - q| by row with reduceat, at a cost of sources x entries. Sums of blocks meet in a groupBy. So no
task holds all terms or all sources, and a frequent term or a large source is a few numbers by then.

Nulls in text, lang and source are ''. A language without kept terms has groups with sums of 0.
Memory of a worker is about 40 bytes a byte of its batch (4 MB, or one longer text).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, arrow_map

SCALE, SMOOTH, LEAST, TOP = 1_000_000_000, 5, 30, 50
BLOCK, TILE = 4096, 128
#: Byte -> its form in a term; 0 where it is in none.
LOOKUP = np.arange(256, dtype=np.uint8)
LOOKUP[65:91] += 32
LOOKUP[[*range(65), *range(91, 97), *range(123, 128)]] = 0
#: Slices compared at once.
COMPARED = 1 << 15


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all terms in looked-up bytes; documents lie between the offsets."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices and each slice's index in them."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    sizes = ends - starts
    same = sizes == sizes[first][group]
    for at in range(0, len(starts), COMPARED):
        own = np.arange(at, min(at + COMPARED, len(starts)))[same[at : at + COMPARED]]
        if len(own):
            n = sizes[own]
            begin = np.cumsum(n) - n
            within = np.arange(n.sum()) - np.repeat(begin, n)
            equal = data[np.repeat(starts[own], n) + within] == data[np.repeat(starts[first[group[own]]], n) + within]
            same[own] = np.logical_and.reduceat(equal, begin)
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # collisions
        word = raw[starts[i] : ends[i]]
        group[i] = more.setdefault(word, len(terms) + len(more))
    return terms + list(more), group


def _counted(batch: pa.RecordBatch) -> dict:
    """Rows (lang, source, term, n, docs); a row with a null term for each group."""
    text = batch.column("text").cast(pa.large_binary())
    text = text.fill_null(b"") if text.null_count else text
    _, offs, raw = text.buffers()
    offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1]
    data = LOOKUP[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts, ends, doc = boundaries(data, offsets - offsets[0])
    terms, term = grouped(data, starts, ends) if len(starts) else ([], np.zeros(0, np.int64))
    groups: dict[tuple[str, str], int] = {}
    own = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    k = max(len(terms), 1)
    pairs, n = np.unique(doc * k + term, return_counts=True)  # a document's terms
    found, at = np.unique(own[pairs // k] * k + pairs % k, return_inverse=True)
    names = list(groups)
    group = (found // k).tolist()
    rows = np.bincount(own, minlength=len(names))
    return {
        "lang": [names[g][0] for g in group] + [x[0] for x in names], "source": [names[g][1] for g in group] + [x[1] for x in names],
        "term": [terms[t].decode("utf-8", "replace") for t in (found % k).tolist()] + [None] * len(names),
        "n": np.concatenate([np.bincount(at, n, len(found)).astype(np.int64), np.zeros(len(names), np.int64)]),
        "docs": np.concatenate([np.bincount(at, minlength=len(found)), rows]),
    }


def counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang, source and others. (lang, source, term, n, docs); a null term stands for the group itself."""
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    parts = arrow_map(docs.select("text", none("lang"), none("source")), _counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p in whole numbers of any size."""
    wide = lambda x: x.cast("decimal(38,0)")
    return F.when(terms > 0, 1 + F.call_function("div", wide(F.lit(SCALE)) * wide(n + SMOOTH), wide(total + SMOOTH * terms))).otherwise(0).cast("long")


def pair_sums(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """CSR rows of sources, `starts` as long as rest: the sum of |p - q| over `width` terms, for all pairs. A row's absent terms have its value in `rest`."""
    sizes = np.diff(np.append(starts, len(terms)))
    some = sizes > 0
    gaps = np.repeat(rest, sizes)
    out = np.zeros((len(rest), len(rest)), np.int64)
    for i, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        own = np.full(width, rest[i])
        own[terms[a : a + n]] = values[a : a + n]
        # As if all other rows had none of their terms, then what their terms change.
        total = np.abs(rest[:, None] - values[None, a : a + n]).sum(axis=1) + (width - n) * np.abs(rest - rest[i])
        met = own[terms]
        change = np.abs(values - met) - np.abs(gaps - met)
        if len(change):
            total[some] += np.add.reduceat(change, starts[some])
        out[i] = total
    return out


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of terms of two tiles: (lang, source, item, value) for the pairs of sources that these tiles have."""
    lang, _, low, high = (x.item() if isinstance(x, np.generic) else x for x in key)
    heads = rows[rows.term.isna()].sort_values("source")
    names, rest, width = heads.source.to_numpy(), heads.rest.to_numpy(np.int64), int(heads.width.iloc[0])
    body = rows[rows.term.notna()]
    at = np.searchsorted(names, body.source.to_numpy())
    term = pd.factorize(body.term)[0]
    order = np.lexsort((term, at))
    starts = np.searchsorted(at[order], np.arange(len(names)))
    sums = pair_sums(starts, term[order], body.p.to_numpy(np.int64)[order], rest, width)
    tile = heads.tile.to_numpy()
    wanted = (tile[:, None] != tile[None, :]) | (low == high)
    np.fill_diagonal(wanted, False)
    a, b = np.nonzero(wanted)
    return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": sums[a, b]})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """docs: text, lang, source and others. (lang, source, part, item, value, rank).

    Part `pair`: the sum of |p - q| over a language's kept terms, for each other source. Part `term`:
    p - q against the whole language, for the `top` terms that a source has more of. No rows for an empty table.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    found = scratch.save(counts(docs), "counts")
    whole = W.partitionBy("lang", "term")
    kept = found.where("term is not null").withColumns({"in_docs": F.sum("docs").over(whole), "in_all": F.sum("n").over(whole), "one": F.row_number().over(whole.orderBy("source"))})
    kept = scratch.save(kept.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "in_all", (F.col("one") == 1).cast("long").alias("one")), "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("one").alias("terms"))
    groups = found.where("term is null").select("lang", "source")
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    groups = groups.withColumn("sources", F.count("*").over(W.partitionBy("lang")))
    groups = groups.withColumns({"rest": _share(F.lit(0), F.col("total"), F.col("terms")), "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / block)), "tiles": F.ceil(F.col("sources") / tile)})
    groups = scratch.save(groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("in_all"), F.col("lang_total"), F.col("terms")), "block": F.pmod(F.xxhash64("term"), "blocks")})
    every = ("lang", "block", "tile", "tiles", "source", "rest")
    # The number of terms in each block, a row for each lang and block.
    widths = kept.where("one = 1").join(langs.select("lang", F.ceil(F.col("terms") / block).alias("blocks")), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block")).agg(F.count("*").alias("width"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left")
    heads = heads.select(*every, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), F.coalesce("width", F.lit(0)).alias("width"))
    both = heads.unionByName(shares.select(*every, "term", "p", F.lit(0).cast("long").alias("width")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    both = both.withColumn("other", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    sums = both.groupBy("lang", "block", "low", "high").applyInPandas(_block, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
