import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from hitlake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as file:
        return bpe.encoding(file.read(), P.PATTERN)


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_cuts_change_nothing(whole):
    random.seed(1)
    parts = ["a", "Z", "é", "漢", "1", "²", "'s", "'", " ", "  ", "\n", "\t", " ", "\x1c", "!", "--", "😀", "ing", "　"]
    for _ in range(400):
        text = "".join(random.choices(parts, k=random.randint(0, 300)))
        got = [t for p in bpe.cut(text, 7) for t in whole.encode_ordinary(p)]
        assert "".join(bpe.cut(text, 7)) == text
        assert got == whole.encode_ordinary(text)


def test_long_text_is_cut_and_long_run_is_not(whole):
    assert len(bpe.cut("word " * 50_000, bpe.PIECE)) > 3
    assert bpe.cut("a" * 200_000, bpe.PIECE) == ["a" * 200_000]


def test_round_trip_and_edges(spark, edge, whole):
    tokens = bpe.decode(bpe.encode(edge, PATH, P.PATTERN), PATH, P.PATTERN)
    got = sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in tokens.collect())
    want = sorted((r.doc_id or 0, r.text or "") for r in edge.select("doc_id", "text").collect())
    assert len(got) == 10
    assert sorted((k, hashlib.sha256(d).hexdigest()) for k, _, d in got) == sorted((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in want)
    for k, raw, d in got:
        assert ids(raw) == whole.encode_ordinary(d.decode())


def test_round_trip_in_one_worker(spark, edge, empty, whole):
    texts = {r.doc_id: (r.text or "").encode() for r in edge.where("doc_id is not null").collect()}
    for r in bpe.round_trip(edge, PATH, P.PATTERN, piece=1000).where("doc_id is not null").collect():
        want = whole.encode_ordinary(texts[r.doc_id].decode())
        assert ids(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()
    assert bpe.round_trip(edge, PATH, P.PATTERN, ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0


def test_raw_bytes_need_not_be_text(spark):
    lone = [k for k in range(256)]
    raw = struct.pack(f"<{len(lone)}I", *lone)
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH, P.PATTERN).collect()}
    assert len(got[1]) == 256 and got[2] is None


def test_empty_table(empty):
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_special_tokens_are_text(whole):
    assert isinstance(whole, tiktoken.Encoding)
    assert whole.decode(whole.encode_ordinary("<|endoftext|>")) == "<|endoftext|>"
