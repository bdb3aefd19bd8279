"""License scans with a positional rare-token index.

Parts are word sequences that must stand whole: the phrases of the base, and the mandatory key phrases of
longer grants and notices. The index has each part under its rarest word (IDF over all documents),
with the places of its other words, rarest first.

A document's licence words are looked up from the rarest on. Every place of such a word says where
a part would start; the part's other postings are intersected with these starts by relative position,
rarest first, until none is left or all words agree. So no place of a part is missed, frequent words
cost nothing, and no text is cut short.

A grant counts where all its key phrases stand, in their places relative to each other or off by
DRIFT words at most, and enough of its words follow in order (longest common subsequence with the
text there): edited copies may leave words out, put some in or replace some.

Index and frequencies are bounded by the templates, not by the corpus.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, prepare
from .words import plain_words

DRIFT, ENOUGH = 8, 0.7

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: The opening words of public licences and notices, their labels, and the phrases that must stand in them.
GRANTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]


def _find(words: list[bytes], part: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def common(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of a template of n words, given the places of each as bits, and a text."""
    whole = left = (1 << n) - 1
    for w in words:
        if met := left & masks.get(w, 0):
            left = (left + met | left - met) & whole
    return n - left.bit_count()


class Index:
    """Postings of the parts, given how many of n documents have each template word."""

    def __init__(self, found: dict[bytes, int], n: int):
        self.idf = {w: log((1 + n) / (1 + k)) for w, k in found.items()}
        self.parts: list[tuple[list[bytes], list[int]]] = []
        self.postings: dict[bytes, list[int]] = defaultdict(list)
        self.phrases = [(label, self._part(text.encode().split())) for text, label in PHRASES.items()]
        self.grants = []
        for label, text, keys in GRANTS:
            words, masks = text.encode().split(), defaultdict(int)
            for i, w in enumerate(words):
                masks[w] |= 1 << i
            own = [key.encode().split() for key in keys]
            self.grants.append((label, dict(masks), len(words), [(_find(words, p), self._part(p)) for p in own]))

    def _part(self, words: list[bytes]) -> int:
        order = sorted(range(len(words)), key=lambda i: (-self.idf.get(words[i], 0.0), i))
        self.postings[words[order[0]]].append(len(self.parts))
        self.parts.append((words, order))
        return len(self.parts) - 1

    def _starts(self, part: int, places: list[int], words: list[bytes]) -> list[int]:
        """Where a part stands, given the places of its rarest word."""
        own, (first, *others) = self.parts[part]
        starts = [i - first for i in places if i >= first and i - first + len(own) <= len(words)]
        for at in others:
            if not starts:
                break
            starts = [s for s in starts if words[s + at] == own[at]]
        return starts

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        """n_base, first and last start, base labels, all labels, score."""
        where, postings = defaultdict(list), self.postings
        for i, w in enumerate(words):
            if w in postings:
                where[w].append(i)
        standing: dict[int, list[int]] = {}
        for w in sorted(where, key=lambda w: -self.idf.get(w, 0.0)):
            for part in postings[w]:
                if starts := self._starts(part, where[w], words):
                    standing[part] = starts
        base = {label: standing[part] for label, part in self.phrases if part in standing}
        every = [s for starts in base.values() for s in starts]
        labels, score = set(base), 1.0 if base else 0.0
        for label, masks, n, keys in self.grants:
            if all(part in standing for _, part in keys):
                share = self._share(words, masks, n, [(at, standing[part]) for at, part in keys])
                if share >= ENOUGH:
                    labels.add(label)
                    score = max(score, share)
        return len(every), min(every, default=None), max(every, default=None), sorted(base), sorted(labels), score

    @staticmethod
    def _share(words: list[bytes], masks: dict[bytes, int], n: int, keys: list[tuple[int, list[int]]]) -> float:
        """The largest share of a template's words that follow in order around its key phrases; 0 where these don't stand together."""
        (first, starts), others, best = keys[0], keys[1:], 0
        for start in starts:
            start -= first
            for at, found in others:
                k = bisect_left(found, start + at - DRIFT)
                if k == len(found) or found[k] > start + at + DRIFT:
                    break
            else:
                best = max(best, common(masks, n, words[max(0, start - DRIFT) : start + n + DRIFT]))
        return best / n


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Over all rows of docs (text): how many have each template word, and their number."""
    every = sorted({w for t in [*PHRASES, *(g[1] for g in GRANTS)] for w in t.encode().split()})
    place = {w: i for i, w in enumerate(every)}

    def count(batches):
        found = np.zeros(len(every) + 1, np.int64)
        for batch in batches:
            for text in as_bytes(batch, "text"):
                for w in place.keys() & set(plain_words(text)):
                    found[place[w]] += 1
            found[-1] += batch.num_rows
        yield pa.record_batch({"at": pa.array(np.arange(len(found), dtype=np.int32)), "n": pa.array(found)})

    prepare(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {r.at: r.n for r in rows}
    return {w: found.get(i, 0) for w, i in place.items()}, found.get(len(every), 0)


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and others. One row each: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is an empty one: no words, no labels, score 0. Labels are distinct, sorted and
    joined by commas; score is the best share of a template's words that agree. No shuffle but that
    of the frequencies.
    """
    found, n = frequencies(docs)

    def kernel(batch: pa.RecordBatch) -> dict:
        index = Index(found, n)
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in as_bytes(batch, "text"):
            words = plain_words(text)
            count, first, last, base, labels, score = index.scan(words)
            for c, v in zip(out, (len(words), count, first, last, ",".join(base), ",".join(labels), score), strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
