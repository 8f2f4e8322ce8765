import math

import numpy as np
from pyspark.sql import functions as F

from texloom.llm import toxicity
from texloom.llm.features import words_of
from texloom.llm.toxicity import OrdinalModel, OrdinalTraining, fit_toxicity, grade_toxicity, train_ordinal


def test_probabilities_sum_and_order():
    model = OrdinalModel(np.zeros(1, np.float32), np.array([0.5, 1.5, 4.0]))
    p = model.probabilities(np.array([-30.0, 0.0, 1.0, 2.0, 50.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    expected = p @ np.arange(4)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.01 and expected[-1] > 2.99


def test_severity_grows_with_marks():
    clean = [f"plain words number{i} about nothing at all row{i % 17}" for i in range(200)]
    bad = ["plain words " + " ".join(f"vile{'abcdef'[k]}" for k in range(i % 6 + 1)) for i in range(120)]
    model = train_ordinal(clean + bad, [False] * 200 + [True] * 120, OrdinalTraining())
    assert len(model.thresholds) >= 2 and (np.diff(model.thresholds) > 0).all()


def test_held_out_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first = F.crc32(F.col("doc_id").cast("string")) % 3 > 0
    model = fit_toxicity(docs, labels.where(first))
    rows = grade_toxicity(docs, model).join(labels.where(~first).withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert rows and sum(r["toxic"] == bool(r["y"]) for r in rows) >= 0.85 * len(rows)
    assert sum(r["toxic"] and not r["y"] for r in rows) <= 0.05 * len(rows)
    for r in rows:
        assert 0 <= r["p_toxic"] <= 1 and 0 <= r["expected_severity"] <= 3 and r["severity"] in (0, 1, 2, 3)


def test_odd_rows(spark, odd, none, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels)
    rows = grade_toxicity(odd.withColumn("Severity", F.lit("mine")), model)
    assert rows.count() == 10 and not any(r["toxic"] for r in rows.collect())
    assert grade_toxicity(odd, model, only_clean=True).columns == odd.columns
    assert grade_toxicity(none, model).count() == 0
    empty = fit_toxicity(none, labels.limit(0))
    assert {(r["severity"], r["p_toxic"]) for r in grade_toxicity(odd, empty).collect()} == {(0, 0.0)}
    twice = labels.union(labels.withColumn("toxic", F.lit(0)))
    assert len(fit_toxicity(docs, twice).thresholds)


def naive_probabilities(score, thresholds):
    below = [0.0] + [1 / (1 + math.exp(score - t)) for t in thresholds] + [1.0]
    return [b - a for a, b in zip(below, below[1:], strict=False)]


def test_slopes_are_those_of_the_naive_likelihood():
    rng = np.random.default_rng(3)
    beta, theta = rng.normal(size=6), np.array([-0.5, 0.4, 1.3])
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(25)]
    grade, weight = rng.integers(0, 4, 25), rng.random(25)
    row = np.repeat(np.arange(25), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], int)

    def naive(beta, theta):
        loss = 0.05 * sum(b * b for b in beta)
        for own, g, w in zip(rows, grade, weight, strict=True):
            loss -= w * math.log(naive_probabilities(sum(beta[c] for c in own), theta)[g])
        return loss

    loss, slope, bend = toxicity.loss_and_slopes(beta, theta, row, column, grade, weight, 0.1)
    assert abs(loss - naive(beta, theta)) < 1e-9
    for value, found in ((beta, slope), (theta, bend)):
        for i in range(len(value)):
            step = np.zeros(len(value))
            step[i] = 1e-6
            ends = [naive(*((value + s * step, theta) if value is beta else (beta, value + s * step))) for s in (1, -1)]
            assert abs((ends[0] - ends[1]) / 2e-6 - found[i]) < 1e-5


def test_query_rows_against_scores_text_by_text(spark, docs, odd, sf_dir):
    """Every row of the operator against a sum over its distinct words and the naive probabilities."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(model.thresholds)
    buckets = len(model.weights)
    for table in (docs, odd):
        for r in grade_toxicity(table, model, keep=["text"]).collect():
            score = sum(float(model.weights[b]) for w in dict.fromkeys(words_of(r["text"] or "")) for b in toxicity._buckets([w], buckets)[0])
            p = naive_probabilities(score, model.thresholds)
            assert abs(r["p_toxic"] - (1 - p[0])) < 1e-6 and r["toxic"] == (r["p_toxic"] >= 0.5)
            assert abs(r["expected_severity"] - sum(j * x for j, x in enumerate(p))) < 1e-5
            assert p[r["severity"]] >= max(p) - 1e-6


def test_training_keeps_to_its_bytes(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert not len(fit_toxicity(docs, labels, how=OrdinalTraining(sample_bytes=10)).thresholds)
    assert len(fit_toxicity(docs, labels, how=OrdinalTraining(sample_bytes=60_000)).thresholds)
