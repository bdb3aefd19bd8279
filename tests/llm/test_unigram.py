import random

import public_tokenizers as P
import regex

from hitlake.llm import unigram

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def brute(own, token):
    word = token.encode()
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for at in range(end):
            c = own.cost.get(word[at:end])
            if c is not None and best[at] is not None:
                total = (best[at][0] + (c >> unigram.SHIFT), best[at][1] + 1)
                best[end] = min(total, best[end] or total)
    return best[-1][1]


def counts(nodes=unigram.NODES):
    with open(PATH, "rb") as file:
        own = unigram.counts(file.read())
    own.clear()
    own.nodes = nodes
    return own


def test_trie_matches_plain_segmentation():
    random.seed(3)
    own = counts()
    tokens = ["".join(random.choices(" abcdeinorst", k=random.randint(1, 14))) for _ in range(400)] + ["é", "漢字", "😀😀", " information", " informational"]
    assert [own.count(t) for t in tokens] == [brute(own, t) for t in tokens]
    assert [own.count(t) for t in tokens] == [brute(own, t) for t in tokens], "terminal counts"


def test_prefixes_are_shared():
    own = counts()
    own.count("information")
    n = len(own.best)
    own.count("informed")
    assert len(own.best) == n + 2


def test_a_full_trie_changes_nothing():
    random.seed(4)
    tokens = ["".join(random.choices("abcdef", k=8)) for _ in range(300)]
    big = [counts().count(t) for t in tokens]
    small = counts(nodes=50)
    assert [small.count(t) for t in tokens] == big
    assert len(small.best) <= 50


def test_long_pre_tokens():
    own = counts()
    text = "ab" * 500
    assert own.count(text) == brute(own, text)
    assert len(own.best) == 1001
    few = counts(nodes=100)
    assert few.count(text) == brute(own, text) and len(few.best) == 100, "a full trie takes no more"
    assert few.count("abc" * 40) == brute(own, "abc" * 40)


def test_documents(edge, empty, docs):
    own, split = counts(), regex.compile(P.PATTERN)
    rows = edge.collect()
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in unigram.token_counts(edge, PATH, P.PATTERN).collect())
    want = sorted((str(r.doc_id), len(p), sum(own.count(t) for t in p)) for r in rows for p in [split.findall(r.text or "")])
    assert got == want
    assert unigram.token_counts(empty, PATH, P.PATTERN).count() == 0
