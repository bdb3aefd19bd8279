import numpy as np
import xxhash
from pyspark.sql import functions as F

from hitlake.llm import near_copies, simhash
from hitlake.llm.common import Scratch


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints):
    ids, up = list(prints), {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {k: root(k) for k in ids}


def test_fingerprint_is_that_of_spark_and_of_brute_force(spark, docs):
    texts = ["a b c", "A B C", "one", "one two", "x y z x y z x y z", "é à ü ö", "word " * 500]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs(list(enumerate(texts)))).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    h = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay_code_is_perfect():
    x = np.random.default_rng(0).integers(0, 1 << 23, 20_000)
    code = simhash.nearest(x)
    assert np.bitwise_count(x ^ code).max() <= 3
    assert (simhash.nearest(code) == code).all()


def test_every_link_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 150)
    rows = set(base.tolist())
    for b in base.tolist():
        for _ in range(3):
            for i in rng.choice(64, rng.integers(1, 6), replace=False):
                b ^= -(1 << 63) if i == 63 else 1 << int(i)
            rows.add(b)
    f = np.array(sorted(rows))
    near = np.bitwise_count((f[:, None] ^ f[None]).view(np.uint64)) <= 3
    want = {(int(f[i]), int(f[j])) for i, j in zip(*np.nonzero(near)) if f[i] < f[j]}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(int(v),) for v in f], "fp long")).collect()}
    assert got == want and len(want) > 100


def test_anchors_are_never_broadcast(spark, tmp_path):
    """A stored table of this size is under Spark's bound for a broadcast; the rows that it is replicated to aren't known to Spark."""
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_match_brute_force(docs):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        text = rng.choice(words, 120).tolist()
        for c in range(3):
            copy = list(text)
            if c:
                copy[rng.integers(120)] = "changed"
            rows.append((3 * k + c, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == groups_of({k: brute(t) for k, t in rows})


def test_edges(edge, empty):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(edge).collect()]
    assert len(got) == 10
    assert {c for k, f, c in got if f == 0} == {1}
    assert [c for k, _, c in got if k in (5, 6)] == [5, 5, 5]
    assert simhash.near_duplicates(empty).count() == 0


def test_hot_fingerprint(docs):
    got = simhash.near_duplicates(docs([(k, "the same words again") for k in range(500)])).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


def _copies(n, changed, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(n):
        text = rng.choice(words, 300).tolist()
        rows.append((2 * k, " ".join(text)))
        for at in rng.choice(300, changed, replace=False):
            text[at] = "other"
        rows.append((2 * k + 1, " ".join(text)))
    return rows


def test_near_copies_go_and_others_stay(docs):
    # 3 of 300 words changed leave a similarity of about 0.9, 30 about 0.45.
    gone = {r.doc_id for r in near_copies.removed(docs(_copies(60, 3))).collect()}
    assert all(k % 2 for k in gone) and len(gone) >= 57
    assert near_copies.removed(docs(_copies(60, 30))).count() == 0


def _family(n, changed, seed=2):
    """n texts of similarity 0.7 to each other, by a common passage; each of the last third has a near copy."""
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(210)]
    texts = [common + [f"u{k}x{j}" for j in range(38)] for k in range(n)]
    for text in texts[-(n // 3) :]:
        copy = list(text)
        for at in rng.choice(len(copy), changed, replace=False):
            copy[at] = f"other{rng.integers(1000)}"
        texts.append(copy)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def _behind(rows):
    """The ids that exact links of 0.8 put behind a smaller one."""
    sets = {k: frozenset(simhash.shingle_hashes(t.encode(), near_copies.SHINGLE).tolist()) for k, t in rows}
    return {b for b in sets if any(a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in sets)}


def test_near_copies_inside_a_family_of_less_similarity(docs, monkeypatch):
    rows = _family(300, 3)
    want = _behind(rows)
    assert len(want) == 100
    got = {r.doc_id for r in near_copies.removed(docs(rows)).collect()}
    assert got <= want and len(got) >= 98
    # The same in blocks, of anchors and of families.
    monkeypatch.setattr(near_copies, "BLOCK", 30)
    assert {r.doc_id for r in near_copies.removed(docs(rows)).collect()} == got
    monkeypatch.setattr(near_copies, "HELD", 8)
    many = {r.doc_id for r in near_copies.removed(docs(rows)).collect()}
    assert many <= want and len(many) >= 98


def test_a_large_group_of_near_copies_in_blocks(docs, monkeypatch):
    rows = _copies(30, 3)
    rng, texts = np.random.default_rng(8), [rows[0][1].split() for _ in range(150)]
    for text in texts:
        for at in rng.choice(300, 2, replace=False):
            text[at] = f"other{rng.integers(10_000)}"
    rows += [(1000 + k, " ".join(t)) for k, t in enumerate(texts)]
    want = {r.doc_id for r in near_copies.removed(docs(rows)).collect()}
    assert {1000 + k for k in range(150)} <= want and 0 not in want
    monkeypatch.setattr(near_copies, "BLOCK", 20)
    monkeypatch.setattr(near_copies, "HELD", 8)
    assert {r.doc_id for r in near_copies.removed(docs(rows)).collect()} == want


def test_recall_at_the_least_similarity_in_families(monkeypatch):
    """Pairs that differ in 39 bits meet as often among many rows that lie 50 to 60 bits from them as alone."""
    rng, free = np.random.default_rng(6), 0
    taken = near_copies.samples(free)
    flip = lambda f, p: f ^ np.packbits(rng.random((len(f), 256)) < p, axis=1).view(np.int64)
    for m in (100, 1000, 4000):
        one = flip(np.repeat(rng.integers(-(2**63), 2**63 - 1, (1, 4)), m, axis=0), 0.115)
        some = rng.choice(m, 60, replace=False)
        f = np.concatenate([one, flip(one[some], 0.1515)])
        bits = np.unpackbits(f.astype(">i8").view(np.uint8).reshape(len(f), -1), axis=1)
        root = np.arange(len(f))
        for t in taken:
            key = simhash.nearest(bits[:, t].astype(np.int64) @ (1 << np.arange(near_copies.CODE)))
            for k in np.unique(key[m:]):
                at = np.flatnonzero(key == k)
                a, b = near_copies.loose(f[at])
                for x, y in zip(root[at[a]].tolist(), root[at[b]].tolist(), strict=True):
                    root[root == max(x, y)] = min(x, y)
        assert (root[m:] == root[some]).mean() >= 0.9


def test_loose_links_join_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, (6, 4))
    f = base[rng.integers(0, 6, 120)] ^ np.packbits(rng.random((120, 256)) < 0.115, axis=1).view(np.int64)
    near = near_copies._distance(f[:, None], f[None]) <= near_copies.LIMIT
    reach = near
    for _ in range(7):
        reach = reach.astype(np.float32) @ reach.astype(np.float32) > 0
    want = reach.argmax(1)
    for most in (1 << 18, 700, 50):
        monkeypatch.setattr(near_copies, "AT_ONCE", most)
        a, b = near_copies.loose(f)
        assert near[a, b].all() and len(a) == 120 - len(set(want.tolist()))
        root = {x: x for x in range(120)} | dict(near_copies.forest(list(zip(a.tolist(), b.tolist(), strict=True))))
        assert [root[x] for x in range(120)] == want.tolist()


def test_chance_to_keep_a_codeword():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 50_000)
    for flips in range(1, 5):
        at = np.argsort(rng.random((len(x), 23)), axis=1)[:, :flips]
        y = x ^ (1 << at).sum(1)
        assert abs((simhash.nearest(x) == simhash.nearest(y)).mean() - near_copies._stays(flips)) < 0.01


def test_near_copies_edges(edge, empty):
    assert {r.doc_id for r in near_copies.removed(edge).collect()} == {2, 3, 6}
    assert near_copies.removed(empty).count() == 0
    for free in (0, 6):
        assert near_copies.recall(0.8, free) > 0.945 and near_copies.recall(0.9, free) > 0.99
    assert [near_copies.free_bits(n) for n in (0, 262_144, 2_000_000_000)] == [0, 0, 13]


def test_scratch_goes_where_spark_says(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert Scratch(spark, "x").root.startswith(named or "/tmp/checkpoints")
