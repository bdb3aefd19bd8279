import hashlib
import random

import pytest

from hitlake.llm import substring


def brute(rows, window):
    first = {}
    seqs = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in seqs:
        if k is not None:
            for p in range(len(w) - window + 1):
                s = tuple(w[p : p + window])
                first[s] = min(first.get(s, k), k)
    out = []
    for k, w in seqs:
        gone = set()
        for p in range(len(w) - window + 1):
            if k is not None and first[tuple(w[p : p + window])] < k:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(df, window).collect()), key=str)


@pytest.mark.parametrize("v", substring.COVERS)
def test_covers_hold_every_difference(v):
    d = substring.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("window", [50, 9])
def test_matches_brute_force(docs, window):
    random.seed(window)
    shared = [[f"s{random.randrange(30)}" for _ in range(window + random.randrange(-2, 40))] for _ in range(6)]
    rows = []
    for k in range(40):
        text = []
        for _ in range(random.randint(0, 3)):
            text += random.choice(shared)[random.randrange(3) :] + [f"u{k}{j}" for j in range(random.randrange(20))]
        rows.append((random.randrange(1000), " ".join(text)))
    rows = list({k: (k, t) for k, t in rows}.values())
    assert run(docs(rows), window) == brute(rows, window)


def test_repeats_within_one_document_stay(docs):
    rows = [(1, "a b c d e f g h i j " * 12), (2, "x " * 120)]
    assert run(docs(rows), 50) == brute(rows, 50)
    assert all(r[2] == 0 for r in run(docs(rows), 50))


def test_exact_copies_hot_group(docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(200)] + [(500, text + " more"), (501, "few words")]
    assert run(docs(rows), 50) == brute(rows, 50)


def test_an_id_on_a_copy_and_on_another_text(docs):
    run_of = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, run_of("a")), (2, "x " + run_of("p")), (5, run_of("a")), (5, run_of("p") + " y " + run_of("q")), (9, run_of("q") + " z"), (5, run_of("a"))]
    assert run(docs(rows), 50) == brute(rows, 50)
    removed = {(r[0], r[1]): r[2] for r in run(docs(rows), 50)}
    assert removed[5, 121] == 60 and removed[9, 61] == 60 and removed[5, 60] == 60


def test_edges(docs, edge, empty):
    got = run(edge, 50)
    assert len(got) == 10 and all(r[2] == 0 for r in got)
    assert substring.deduplicate(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(55))
    rows = [(None, text), (3, text), (3, text), (9, text)]
    assert run(docs(rows), 50) == brute(rows, 50)
