import math

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_near_copies import brute
from texloom.llm import language, queries, toxicity
from texloom.llm.common import written
from texloom.llm.features import words_of


def test_stages(spark, docs, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "pieces"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, written(stage(spark, now, sf_dir), "test-stage")
        if name != "pieces":
            assert now.columns == docs.columns
        if name in ("toxicity", "language", "near_duplicates"):
            assert now.exceptAll(before).isEmpty() and 0 < now.count() <= before.count()
        if name == "mixing":
            assert now.distinct().exceptAll(before.distinct()).isEmpty()
            assert now.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert now.where("not round_trip").isEmpty()


def test_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, sf_dir).join(labels, "doc_id")
    total = docs.join(labels, "doc_id")
    count = lambda d, y: d.where(F.col("toxic") == y).count()
    assert count(kept, 1) <= 0.1 * count(total, 1) and count(kept, 0) >= 0.98 * count(total, 0)


def test_one_of_each_class_stays(spark, sf_dir):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(3, a, "en", "s", 1), (2, a + " end", "en", "s", 1), (2, a + " end", "en", "s", 1), (None, a, "en", "s", 1), (7, "single one of its kind", "en", "s", 1), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("class_id", F.lit(1))
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8]


def test_odd_rows_pass_every_stage(spark, odd, none, sf_dir):
    for start, left in ((odd, {1, 6, 7, 8, None}), (none, set())):
        now, ids = start.withColumn("n_chars", F.lit(1).cast("long")).withColumn("score", F.lit("extra")), {}
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf_dir), "test-odd")
            ids[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert sorted(ids["near_duplicates"], key=str) == sorted(left, key=str)
        assert set(ids["pieces"]) <= left and sorted(ids["pieces"], key=str) == sorted(ids["mixing"], key=str)
        assert bool(ids["pieces"]) == bool(left)


def _certainty(text, model):
    """Mean of each word's largest probability, by forward-backward in plain loops over one text."""
    words = words_of(text or "")
    if not words:
        return None
    k = len(model.langs)
    scores = np.array([language.emissions([w], model)[0] for w in words], float)
    ahead, back = [scores[0] + model.start], [np.zeros(k)]
    for t in range(1, len(words)):
        ahead.append(scores[t] + np.logaddexp.reduce(ahead[-1][:, None] + model.moves, axis=0))
    for t in range(len(words) - 1, 0, -1):
        back.append(np.logaddexp.reduce(model.moves + (scores[t] + back[-1])[None, :], axis=1))
    total = np.logaddexp.reduce(ahead[-1])
    return float(np.mean([np.exp(a + b - total).max() for a, b in zip(ahead, back[::-1], strict=True)]))


def test_run_against_brute_force(spark, docs, sf_dir):
    """Every stage on the whole smallest table, by plain loops, DuckDB and the piece model's library."""
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def clean(text):
        score = sum(float(model.weights[b]) for w in dict.fromkeys(words_of(text or "")) for b in toxicity._buckets([w], len(model.weights))[0])
        return 1 / (1 + math.exp(score - model.thresholds[0])) > 0.5

    rows = [r for r in rows if clean(r[1])]
    field = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    rows = [r for r in rows if (sure := _certainty(r[1], field)) is not None and sure >= corpus_pipeline.LEAST_CERTAINTY]
    heads = {class_id for _, class_id, _ in brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in heads]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    copies = {i: taken // size for i, size, _, _, taken in con.execute(queries._MIX_SQL).fetchall() if taken}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_FILE))
    want = sorted((r[0], r[2], r[3], library.encode(r[1])) for r in rows for _ in range(copies.get(r[0], 0)))
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "lang", "source", "ids").collect()
    assert sorted(tuple(r) for r in found) == want and len(want) > 100
