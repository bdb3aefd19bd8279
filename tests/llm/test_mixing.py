import itertools

import pytest
from pyspark.sql import functions as F

from hitlake.llm import mixing


def test_targets_cap_and_reshare():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 2, "c": 1})
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and sum(got.values()) == pytest.approx(2010)
    assert mixing.targets({"a": 5}, {"a": 1}) == {"a": 5}
    assert mixing.targets({}, {}) == {}
    assert mixing.targets({"a": 0, "b": 10}, {"a": 5, "b": 1}) == {"a": 0, "b": 10}


def best(supplies, members, quotas, most=3):
    """Largest amount, then least cost, by trying everything."""
    options = [[c for c in itertools.product(range(most * n + 1), repeat=len(m)) if sum(c) <= most * n] for n, m in zip(supplies, members)]
    top = None
    for pick in itertools.product(*options):
        into = [0] * len(quotas)
        for m, c in zip(members, pick):
            for k, v in zip(m, c):
                into[k] += v
        if any(a > q for a, q in zip(into, quotas)):
            continue
        cost = sum(max(0, min(n, sum(c) - r * n)) * r * r for n, c in zip(supplies, pick) for r in range(most))
        key = (-sum(into), cost)
        top = key if top is None or key < top else top
    return top


@pytest.mark.parametrize("case", [([2, 2, 1], [[0], [0, 1], [1]], [4, 3]), ([1, 1], [[0, 1], [0, 1]], [3, 2]), ([2, 1, 1], [[0], [1], [0, 1]], [5, 5]), ([0, 2], [[0], [0]], [4])])
def test_flow_is_the_best(case):
    supplies, members, quotas = case
    got = mixing.flow(supplies, members, quotas)
    sums = [sum(g.values()) for g in got]
    assert all(set(g) <= set(m) for g, m in zip(got, members))
    assert all(s <= 3 * n for s, n in zip(sums, supplies))
    assert all(sum(g.get(k, 0) for g in got) <= q for k, q in enumerate(quotas))
    cost = sum(max(0, min(n, s - r * n)) * r * r for n, s in zip(supplies, sums) for r in range(3))
    assert (-sum(sums), cost) == best(supplies, members, quotas)


def run(df, members=None):
    return mixing.mix(df, F.array("source") if members is None else members, mixing.cycle())


def test_hot_source_meets_its_target(docs):
    rows = [(k, "w " * (1 + k % 50), None, "hot" if k % 3 else f"s{k % 5}") for k in range(3000)]
    mixed, sizes, wanted = run(docs(rows))
    taken = {r.members[0]: r.t for r in mixed.groupBy("members").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
    assert all(abs(taken[s] - wanted[s]) <= 50 for s in sizes)
    assert mixed.agg(F.max("copies")).first()[0] <= 3
    again = {(r.doc_id, r.copies) for r in run(docs(rows).repartition(3))[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed.collect()}


def test_border_matches_one_running_sum(docs):
    rows = [(k, "w " * (k % 7), None, f"s{k % 4}") for k in range(800)]
    mixed, sizes, wanted = run(docs(rows))
    place = {r.doc_id: r.p for r in docs(rows).select("doc_id", mixing.place(F.col("doc_id"), 11).alias("p")).collect()}
    by = {r.doc_id: r for r in mixed.collect()}
    for s in sizes:
        quota, before = int(wanted[s] + 0.5), 0
        for k in sorted((k for k, *_, x in rows if x == s), key=lambda k: (place[k], k)):
            size = k % 7
            more = 2 * before + size <= 2 * (quota % sizes[s])
            assert by[k].copies == quota // sizes[s] + more
            before += size


def test_overlapping_sources(docs):
    df = docs([(k, "w " * 10) for k in range(90)])
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    mixed, sizes, wanted = run(df, members)
    assert sizes == {"a": 600, "b": 600} and mixed.count() == 90
    assert mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == pytest.approx(sum(wanted.values()), abs=30)


def test_too_many_patterns_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 2)
    with pytest.raises(ValueError):
        run(docs([(k, "w", None, f"s{k}") for k in range(4)]))


def test_border_is_cut_until_it_is_small(docs, monkeypatch):
    rows = [(k, "w " * (k % 7), None, f"s{k % 4}") for k in range(800)]
    want = {(r.doc_id, r.copies) for r in run(docs(rows))[0].collect()}
    monkeypatch.setattr(mixing, "BITS", 2)
    monkeypatch.setattr(mixing, "HELD", 3)
    assert {(r.doc_id, r.copies) for r in run(docs(rows))[0].collect()} == want


def test_texts_without_words_are_not_taken_too_often(docs):
    rows = [(0, "w " * 10, None, "a"), *((k, "", None, "a") for k in range(1, 6)), *((k, "w " * 500, None, "b") for k in range(6, 9))]
    mixed, sizes, wanted = run(docs(rows))
    assert wanted["a"] == 3 * sizes["a"]
    assert {r.copies for r in mixed.where("members[0] = 'a'").collect()} == {3}


def test_repeated_ids_are_ordered_by_text(docs):
    rows = [(5, f"t{k} " * 40, None, "a") for k in range(50)] + [(6, "x " * 9000, None, "b")]
    mix = lambda df: sorted((r.text, r.copies) for r in mixing.mix(df.withColumn("own", F.col("text")), F.array("source"), mixing.cycle(), keep=["own"])[0].collect())
    assert mix(docs(rows)) == mix(docs(rows[::-1]).repartition(5))


def test_flow_over_many_patterns_is_quick():
    import random
    import time

    random.seed(2)
    members = [[k] for k in range(20)] + [sorted(random.sample(range(20), random.randint(2, 5))) for _ in range(1200)]
    supplies = [random.randint(1, 10**6) for _ in members]
    quotas = [random.randint(1, 10**8) for _ in range(20)]
    began = time.time()
    got = mixing.flow(supplies, members, quotas)
    assert time.time() - began < 10
    assert all(sum(g.values()) <= 3 * n for g, n in zip(got, supplies)) and all(sum(g.get(k, 0) for g in got) <= q for k, q in enumerate(quotas))


def test_edges(edge, empty):
    mixed, sizes, _ = run(edge)
    rows = mixed.collect()
    assert len(rows) == 10 and list(sizes) == ["s", None]
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert run(empty)[0].count() == 0
