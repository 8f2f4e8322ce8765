import hashlib
import random

import pytest
from pyspark.sql import functions as F

from texloom.llm import mixing
from texloom.llm.mixing import mix, word_count

WEIGHTS, SHARE, REPEATS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 23


def targets(sizes):
    """Shares by weight with caps, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = SHARE * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > REPEATS * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(REPEATS * sizes[s])
            left -= out[s]
        open_ -= full
    return out, weight


def brute(rows):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, weight = targets(sizes)
    key = lambda i: int(hashlib.md5(f"{SEED}:{i}".encode()).hexdigest()[:8], 16)
    queue = []
    for s in sizes:
        upto = 0
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), r[0], r[2])):
            upto += n
            queue += [((sizes[s] * e + upto) / weight[s], key(i), i, e, n) for e in range(REPEATS) if n]
    total, taken = 0, {}
    for _, _, i, _, n in sorted(queue):
        if total + n > SHARE * sum(sizes.values()):
            break
        total += n
        taken[i] = taken.get(i, 0) + n
    return goal, taken


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n long")


@pytest.mark.parametrize("bins", [4, 4096])
def test_against_a_queue(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "LAST", 5)
    monkeypatch.setattr(mixing, "SLICES", 8)
    rng = random.Random(bins)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", None]), rng.choice([0, 1, 5, 30, 400])) for i in range(400)]
    goal, taken = brute(rows)
    for r in mix(frame(spark, rows), F.col("n")).collect():
        assert r["taken"] == taken.get(r["doc_id"], 0) and abs(r["target"] - goal[r["source"]]) < 1e-6


def test_word_count(spark):
    rows = spark.createDataFrame([("a b\tc\nd\x0be\x0cf\rg",), (None,), ("",), ("x\xa0y\x1cz",)], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [7, 0, 0, 1]


def test_reruns_agree_and_targets_are_near(docs):
    one = {tuple(r) for r in mix(docs.repartition(5), word_count(F.col("text")), keep=["doc_id"]).collect()}
    assert one == {tuple(r) for r in mix(docs.coalesce(1), word_count(F.col("text")), keep=["doc_id"]).collect()}
    by = mix(docs, word_count(F.col("text"))).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    for r in by.collect():
        assert abs(r["t"] - r["goal"]) <= r["most"] + 1 and r["over"] <= 0


def test_odd_rows(odd, none):
    rows = mix(odd.withColumn("TARGET", F.lit("mine")), word_count(F.col("text")))
    assert rows.count() == 10 and all(r["taken"] == 0 for r in rows.where("size = 0").collect())
    assert mix(none, word_count(F.col("text"))).count() == 0
    blank = odd.where("doc_id in (2, 3)")
    assert {r["taken"] for r in mix(blank, word_count(F.col("text"))).collect()} == {0}


def test_no_python_on_the_executors(docs):
    plan = mix(docs, word_count(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
