import math

import numpy as np
from pyspark.sql import functions as F

from texloom.llm.metric_search import MTree, top_k


def brute(rows, k, is_query):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(0)
    centers = rng.integers(-2000, 2000, (20, 6))
    vectors = centers[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 6))
    tree = MTree.load(MTree(np.arange(4000), vectors, page=32).dump())
    read = []
    for i in range(0, 4000, 97):
        scores = vectors @ vectors[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert [(-s, j) for s, j in tree.search(i, vectors[i], 5, read)] == want
    assert len(read) < 0.5 * len(tree.leaf) * len(range(0, 4000, 97))


def test_covering_radii():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (900, 3))
    tree = MTree(np.arange(900), vectors, page=16)
    extra = np.sqrt(np.maximum(tree.top[0] - (tree.vectors**2).sum(axis=1), 0))
    points = np.concatenate([tree.vectors, extra[:, None]], axis=1)

    def members(p):
        if tree.leaf[p]:
            return list(range(tree.first[p], tree.last[p]))
        return [m for c in range(tree.first[p], tree.last[p]) for m in members(c)]

    assert sorted(members(0)) == list(range(900))
    for p in range(len(tree.leaf)):
        assert np.sqrt(((points[members(p)] - tree.centers[p]) ** 2).sum(axis=1)).max() <= tree.radius[p] + 1e-6


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 0.0]), (450, [float("nan")] * 5), (500, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5), (350, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).repartition(5)
    found = sorted(tuple(r) for r in top_k(df, F.col("id") % 50 == 0, 5).collect())
    assert found == brute(rows, 5, lambda i: i % 50 == 0)


def test_repeated_rows_ties_and_few_candidates(spark):
    rows = [(0, [1.0]), (0, [1.0]), (3, [1.0]), (2, [1.0])]
    found = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0, 5).collect())
    assert found == [(0, 1, 2, 65536)] * 2 + [(0, 2, 3, 65536)] * 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, F.col("id") == 0, 5).count() == 0
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(2000)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in top_k(same, F.col("id") == 7, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_far_blocks_are_not_searched(spark, monkeypatch):
    from texloom.llm import metric_search

    monkeypatch.setattr(metric_search, "BLOCK", 64)
    monkeypatch.setattr(metric_search, "DESCRIPTORS", 20)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 8))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    points = centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.01
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(points)]
    formed = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    found = sorted(tuple(r) for r in top_k(df, F.col("id") % 50 == 0, 5, formed=formed).collect())
    assert found == brute(rows, 5, lambda i: i % 50 == 0)
    assert formed[0] < 0.3 * formed[1], formed


def test_one_crowded_cell(spark, monkeypatch):
    """A third of all vectors are equal: their cell is dealt into blocks, and the result stays exact."""
    from texloom.llm import metric_search

    monkeypatch.setattr(metric_search, "BLOCK", 50)
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, 0.25, 0.0]) for i in range(300)] + [(i, [float(x) for x in rng.integers(-8, 9, 3) / 8]) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in top_k(df, F.col("id") % 50 == 0, 5).collect()) == brute(rows, 5, lambda i: i % 50 == 0)


def test_sums_beyond_floats(spark):
    rows = [(0, [3.0e9, 1.0]), (1, [3.0e9, 1.0]), (2, [3.0e9, 1.25]), (3, [-3.0e9, 0.0]), (4, [1e30, 0.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["score"] for r in top_k(df, F.col("id") == 0, 5).collect()}
    big = 768_000_000_000
    assert found[1] == min(2**63 - 1, big * big + 256 * 256) and found[2] == min(2**63 - 1, big * big + 256 * 320)
    assert found[4] == 2**63 - 1 and found[5] == big * 256 + 256 * 512 and found[3] == max(-(2**63), -big * big)
