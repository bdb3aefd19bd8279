import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.llm import langid

WORDS = {"aa": ["banana", "panama", "sahara", "alabama"], "ee": ["tree", "seven", "express", "melee"], "oo": ["book", "moon", "proton", "colony"]}


def corpus(n):
    random.seed(4)
    return [(k, " ".join(random.choices(WORDS[lang], k=random.randint(3, 30))), lang) for k in range(n) for lang in [list(WORDS)[k % 3]]]


def test_held_out_languages_are_found(docs):
    df = docs(corpus(240))
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_rejection_by_distance(docs):
    model = langid.fit(docs(corpus(240)))
    got = langid.predict(docs([(1, "zzz qqq xxx kkk"), (2, "banana panama sahara alabama banana")]), model).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].rejected and by[1].lang_pred in WORDS
    assert not by[2].rejected and by[2].lang_pred == "aa"


def test_several_centroids_a_language(docs):
    assert len(langid.fit(docs(corpus(240)))["langs"]) == 3 * langid.CENTROIDS


def test_hot_copies_and_texts_without_letters_take_no_place(docs, monkeypatch):
    monkeypatch.setattr(langid, "document_frequencies", lambda _: (np.zeros(1 << langid.BITS), 0))
    distinct = list({t: (k, t, lang) for k, t, lang in corpus(240)}.values())
    hot = [(1000 + k, *distinct[at][1:]) for at in range(30) for k in range(20)]
    blank = [(5000 + k, t, lang) for k in range(100) for t in (None, "", f"{k} 1") for lang in WORDS]
    # The same texts are drawn, and so the same centroids learned.
    want, got = langid.fit(docs(distinct), most=40), langid.fit(docs(distinct + hot + blank), most=40)
    assert want["langs"] == got["langs"] and len(want["langs"]) == 3 * langid.CENTROIDS
    assert np.abs(want["centroids"] - got["centroids"]).max() < 1e-5


def test_edges(docs, edge):
    got = langid.predict(edge, langid.fit(docs(corpus(60)))).collect()
    assert len(got) == 10
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3, None}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_nothing_to_learn_from(docs, empty):
    model = langid.fit(empty)
    assert [r.lang_pred for r in langid.predict(docs([(1, "text")]), model).collect()] == ["und"]
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(docs([(1, "a", None), (2, None, None)]))["langs"] == []


def test_prediction_uses_text_alone(docs):
    model = langid.fit(docs(corpus(120)))
    a = langid.predict(docs([(1, "banana sahara", "aa", "s1")]), model).first()
    b = langid.predict(docs([(99, "banana sahara", None, None)]), model).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def plain_vector(text, idf):
    """A dict from place to weight, by loops over letters."""
    mask, out = (1 << 32) - 1, {}
    letters = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    line = [32]
    for c in [*letters, 32]:
        if c != 32 or line[-1] != 32:
            line.append(c)
    a, b, c = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    grams = [x * a for x in line if x != 32] + [x * b + y * c + 1 for x, y in zip(line, line[1:])] + [((x * a + y * b) & mask) * c + z * a + 2 for x, y, z in zip(line, line[1:], line[2:])]
    for g in grams:
        g &= mask
        at = ((g ^ g >> 15) * b & mask) >> 32 - langid.BITS
        out[at] = out.get(at, 0) + 1
    out = {k: (1 + math.log(n)) * idf[k] for k, n in out.items()}
    whole = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / whole for k, v in out.items()}


def test_prediction_matches_plain_centroids(docs):
    random.seed(5)
    own = {"aa": "the and with from this that", "bb": "der die und nicht mit das", "cc": "le la et avec dans pour"}
    rows = [(k, " ".join(random.choices(own[lang].split(), k=12)) + f" x{k}", lang) for k, lang in enumerate(sorted(own) * 40)]
    rows += rows[:7] * 3  # repeated learnable rows
    learnable = docs([(k, t, lang, "s") for k, t, lang in rows])
    model = langid.fit(learnable)
    n = len(rows)
    vectors = [plain_vector(t, [1.0] * (1 << langid.BITS)) for _, t, _ in rows]
    for at in random.sample(sorted({k for v in vectors for k in v}), 40):
        assert model["idf"][at] == pytest.approx(math.log((1 + n) / (1 + sum(at in v for v in vectors))) + 1)
    assert len(model["langs"]) == 3 * langid.CENTROIDS and np.allclose(np.linalg.norm(model["centroids"], axis=1), 1, atol=1e-5)
    asked = [(k, " ".join(random.choices(" ".join(own.values()).split(), k=9)), "en") for k in range(60)]
    got = {r.doc_id: r for r in langid.predict(docs(asked), model).collect()}
    for k, text, _ in asked:
        v = plain_vector(text, model["idf"])
        near = [sum(w * float(c[i]) for i, w in v.items()) for c in model["centroids"]]
        best = max(range(len(near)), key=lambda j: near[j])
        assert abs(got[k].score - near[best]) < 1e-5 and (got[k].lang_pred == model["langs"][best] or abs(near[best] - max(n for n, lang in zip(near, model["langs"]) if lang == got[k].lang_pred)) < 1e-5)
        assert got[k].rejected == bool(near[best] < model["least"][best]) or abs(near[best] - model["least"][best]) < 1e-5
