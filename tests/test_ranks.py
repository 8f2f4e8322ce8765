import math
import random

import pytest
from pyspark.sql import Row

from texloom.operators import ordered, stats


def _mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def _tails(values):
    own = sorted(values, key=lambda v: (v is not None, math.inf if v is None or v != v else v, v is not None and v != v))
    n = len(own)
    k = min(max((n + 10) // 20, 1), n)
    return _mean([own[(n + 1) // 2 - 1], own[n // 2]]), _mean(own[:k]), _mean(own[n - k :])


def _alike(a, b):
    return a == b or (a is not None and b is not None and ((a != a and b != b) or math.isclose(a, b, rel_tol=1e-12)))


def test_tails_of_odd_groups(spark):
    rng = random.Random(1)
    groups = {
        "skewed": [math.exp(rng.gauss(0, 9)) for _ in range(3000)],
        "equal": [4.0] * 77,
        "ties": [float(rng.randrange(5)) for _ in range(1001)],
        "nulls": [None] * 30 + [float(i) for i in range(31)],
        "one": [2.5],
        "two": [2.5, 4.0],
        "none": [None, None],
        "infinite": [math.inf, -math.inf, 1.0, 2.0, 3.0],
        "upper": [math.inf, 1.0, 2.0],
        "nan": [math.nan, 1.0, 2.0, 3.0],
        None: [1.0, 5.0, 9.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    found = {r["k"]: (r["median"], r["low_tail"], r["high_tail"]) for r in stats.tails(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert found.keys() == groups.keys()
    for k, vs in groups.items():
        assert all(_alike(a, b) for a, b in zip(found[k], _tails(vs), strict=True)), k
    assert stats.tails(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_stable_places_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [Row(k=rng.choice(["a", "b", None]), s=rng.choice([None, "x", "y", "z"]), i=i if i % 50 else i * 10_000) for i in rng.sample(range(-500, 5000), 3000)]
    found = ordered.stable_places(spark.createDataFrame(rows, "k string, s string, i long"), ["k"], "s", "i").collect()
    want = {}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r["k"] == key), key=lambda r: (r["s"] is not None, r["s"] or "", r["i"]))
        want |= {(key, r["i"]): p for p, r in enumerate(own, 1)}
    assert {(r["k"], r["i"]): r["place"] for r in found} == want and len(found) == len(rows)
    assert ordered.stable_places(spark.createDataFrame([], "k string, s string, i long"), ["k"], "s", "i").count() == 0


@pytest.mark.parametrize("ids", [[7], [None, 3], [None]])
def test_stable_places_of_few_ids(spark, ids):
    found = ordered.stable_places(spark.createDataFrame([("a", "x", i) for i in ids], "k string, s string, i long"), ["k"], "s", "i").collect()
    assert {r["i"]: r["place"] for r in found} == {i: n for n, i in enumerate(ids, 1)}
