"""The divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hitlake.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=50):
    """rows: (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = WORD.findall(text.translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


def invented(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "漢字", "Hot", "HOT"]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0"] * 5 + [f"s{i}" for i in range(9)] + [None])
        text = rng.choice([" ", "1", "-"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(30)))
        rows.append((rng.choice([text, text, text, None, ""]) if rng.random() < 0.3 else text, rng.choice(["en", "en", "de", None]), source))
    return [*rows, ("rare words only", "xx", "lone"), (None, "xx", "none")]


def audited(spark, docs, rows, **how):
    frame = docs([(i, *r) for i, r in enumerate(rows)])
    got = [tuple(r) for r in divergence.audit(frame, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("how", [{}, {"block": 7, "tile": 3}])
def test_against_counting(spark, docs, how):
    rows = invented()
    assert audited(spark, docs, rows, least=10, **how) == plain(rows, 10)


def test_nothing_kept(spark, docs):
    rows = [("a b", "en", "x"), ("a c", "en", "y"), ("", "en", None)]
    assert audited(spark, docs, rows) == plain(rows, 30)
    assert {r[4] for r in plain(rows, 30)} == {0}


def test_edges(spark, edge, empty):
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    got = {tuple(r) for r in divergence.audit(edge, least=1).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(rows, 1)
    assert divergence.audit(empty).count() == 0


def test_boundaries_end_at_documents():
    data = divergence.LOOKUP[np.frombuffer(b"abCd e\xc3\xa9f", np.uint8)]
    starts, ends, doc = divergence.boundaries(data, np.array([0, 2, 2, 9]))
    assert [data.tobytes()[a:b] for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", "eéf".encode()] and doc.tolist() == [0, 2, 2]


@pytest.mark.parametrize("digest", [lambda w: 1, lambda w: len(w), lambda w: w[0] % 3])
def test_collisions_are_told_apart(digest):
    words = random.Random(4).choices([b"a", b"b", b"aa", b"ab", b"abc", b"abd"], k=300)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    terms, group = divergence.grouped(data, ends - [len(w) for w in words], ends, digest)
    assert [terms[g] for g in group] == words and len(set(terms)) == len(terms)


def test_sums_of_pairs():
    rng = np.random.default_rng(0)
    dense = rng.integers(0, 9, (6, 40)) * (rng.random((6, 40)) < 0.3)
    dense[2] = 0
    rest = rng.integers(0, 9, 6)
    at, term = np.nonzero(dense)
    full = np.where(dense > 0, dense, rest[:, None])
    got = divergence.pair_sums(np.searchsorted(at, np.arange(6)), term, dense[at, term], rest, 40)
    assert (got == np.abs(full[:, None] - full[None]).sum(axis=2)).all()
