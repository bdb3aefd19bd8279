"""Token counts by trie-shared dynamic programming.

A text is split by the pattern of the vocabulary, and each pre-token is segmented into vocabulary
pieces at the least total cost; a piece costs minus the logarithm of its probability, which follows
Zipf's law in its rank (nothing is trained). Equal costs go to fewer pieces.

The distinct pre-tokens of a partition are inserted in a trie by their bytes. Every node holds the
forward score of its prefix, computed once from the nodes above it however many pre-tokens share
it; the node where a pre-token ends stores its count. The trie is emptied at NODES nodes, so memory
is bounded, also within one long pre-token, whose rest is scored by the same recurrence without new
nodes; that costs time, never a result. No shuffle.

Tokenizers are not trained here, so costs don't come from the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from math import log

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ranks
from .common import arrow_map, memo

NODES = 400_000
#: A total is its cost in millionths, shifted, plus the number of pieces.
SHIFT = 32


class Counts:
    """Least-cost piece counts over a vocabulary: bytes -> rank."""

    def __init__(self, ranks: dict[bytes, int], nodes: int = NODES):
        whole = log(sum(1 / (r + 1) for r in ranks.values()))
        self.cost = {w: (round(1e6 * (log(r + 1) + whole)) << SHIFT) + 1 for w, r in ranks.items()}
        self.longest, self.nodes = max(map(len, ranks)), nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0]
        self.ends: dict[str, int] = {}

    def _step(self, word: bytes, end: int, before: list[int]) -> int:
        """The least total of word[:end], given those of its prefixes."""
        cost, least = self.cost, None
        for at in range(max(0, end - self.longest), end):
            if (c := cost.get(word[at:end])) is not None:
                total = before[at] + c
                if least is None or total < least:
                    least = total
        return least

    def count(self, token: str) -> int:
        found = self.ends.get(token)
        if found is not None:
            return found
        if len(self.best) >= self.nodes:
            self.clear()
        word = token.encode("utf-8", "replace")
        totals, node = [0], 0
        for end in range(1, len(word) + 1):
            key = None if node is None else node << 8 | word[end - 1]
            after = self.child.get(key)
            if after is not None:
                totals.append(self.best[after])
            else:
                totals.append(self._step(word, end, totals))
                if key is not None and len(self.best) < self.nodes:
                    after = self.child[key] = len(self.best)
                    self.best.append(totals[-1])
            node = after
        found = totals[-1] & (1 << SHIFT) - 1
        if node is not None:
            self.ends[token] = found
        return found


_made = memo()


def counts(ranks: bytes) -> Counts:
    key = hashlib.sha256(ranks).digest()
    if key not in _made:
        _made[key] = Counts({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a})
    return _made[key]


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs: doc_id, text and others. (doc_id, n_pretokens, n_tokens) of each row's whole text; null and empty texts have none."""
    ranks = _ranks(docs, path)

    def kernel(batch: pa.RecordBatch) -> dict:
        own, split = counts(ranks.value), regex.compile(pattern)
        total, tokens = [], []
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            found = Counter(split.findall((raw or b"").decode("utf-8", "replace")))
            total.append(found.total())
            tokens.append(sum(own.count(t) * n for t, n in found.items()))
        return {"doc_id": batch.column("doc_id"), "n_pretokens": total, "n_tokens": tokens}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_pretokens long, n_tokens long")
