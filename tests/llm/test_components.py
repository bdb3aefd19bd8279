import random

from hitlake.llm.common import Scratch
from hitlake.llm.components import components, forest


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    return {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}


def test_random_graphs(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(250)]
    edges = [(a, b) for a, b in edges if a != b]
    assert run(spark, edges) == brute(edges)


def test_path_star_loops_nulls_and_nothing(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1001 + k) for k in range(200)]
    assert run(spark, path + star + [(5, 5), (None, 3), (4, None)]) == brute(path + star)
    assert run(spark, []) == {}


def test_forest():
    assert dict(forest([(3, 2), (2, 1), (7, 9)])) == {3: 1, 2: 1, 9: 7}
