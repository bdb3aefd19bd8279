import random

import pytest

from hitlake.functions.running import running_sums


@pytest.mark.parametrize(("descending", "buckets"), [(False, 4), (True, 7), (False, 256)])
def test_matches_one_pass(spark, descending, buckets):
    random.seed(1)
    rows = [(g, float(k), random.randrange(9)) for g in ("a", None) for k in random.sample(range(1000), 200)]
    got = {(r.g, r.o): r.before_v for r in running_sums(spark.createDataFrame(rows, "g string, o double, v long"), "o", ["v"], ["g"], descending, buckets).collect()}
    want = {}
    for g in ("a", None):
        total = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
            want[g, o], total = total, total + v
    assert got == want


def test_nothing(spark):
    assert running_sums(spark.createDataFrame([], "o double, v long"), "o", ["v"]).count() == 0
