"""Pairs that share a band of bits: results against loops, and that no pair is held to find it again."""

import random

import pytest
from pyspark.sql import functions as F

from texloom.operators import joins


@pytest.mark.parametrize("block, pairs", [(1 << 13, 1 << 24), (10, 1 << 24), (10, 300)])
@pytest.mark.parametrize("bands, width", [(2, 8), (3, 4)])
def test_pairs_of_a_band_once(spark, monkeypatch, bands, width, block, pairs):
    rng = random.Random(1)
    rows = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice([rng.randrange(1 << 12), 7, 7, 0x103]) if rng.random() < 0.9 else None) for _ in range(260)]
    monkeypatch.setattr(joins, "BAND_BLOCK", block, raising=False)
    monkeypatch.setattr(joins, "BAND_PAIRS", pairs, raising=False)
    # an id that stands several times has all bands of its rows
    keys: dict[int, set] = {}
    for i, code in rows:
        if i is not None and code is not None:
            keys.setdefault(i, set()).update((b, code >> (b * width) & ((1 << width) - 1)) for b in range(bands))
    found = joins.band_candidates(spark.createDataFrame(rows, "vec_id long, code long"), "vec_id", F.col("code"), bands, width)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b) for a in keys for b in keys if a < b and keys[a] & keys[b])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join Inner")]


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, None), (None, 3), (4, 0xFFFF), (5, 0)], "vec_id long, code long")
    assert joins.band_candidates(df, "vec_id", F.col("code"), 2, 8).count() == 0
    assert joins.band_candidates(df.where("false"), "vec_id", F.col("code"), 2, 8).count() == 0
