"""A corpus pipeline of five stages: toxicity, language, near copies, mixing, pieces.

Each stage works on all rows that the one before kept and writes its result as Parquet. Stages return
the columns of documents; only the last adds ids of pieces instead of the text.

Defined results for unusual rows are those of the operators: null and empty texts are not toxic, have no
language and so leave at the second stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm.common import read_table, written
from texloom.llm.language import fit_language, label_language
from texloom.llm.mixing import mix, word_count
from texloom.llm.near_copies import near_copies
from texloom.llm.pieces import encode_decode
from texloom.llm.queries import PIECE_FILE, tokenizer_path
from texloom.llm.toxicity import fit_toxicity, grade_toxicity

#: A text whose words have, each in its likeliest language, no such mean probability is in none of the languages learned.
#: A text that changes its language stays, however evenly.
LEAST_CERTAINTY = 0.4
#: The last stage's workers live beside heaps that the joins before have grown; they keep fewer words than the lone query.
PIPELINE_CACHE_WORDS = 150_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic."""
    model = fit_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return grade_toxicity(docs, model, only_clean=True)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    return label_language(docs, fit_language(docs), least_certainty=LEAST_CERTAINTY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    found = near_copies(docs)
    heads = found.select(F.col("class_id").alias("__id"), F.col("class_digest").alias("__head")).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.withColumn("__digest", digest)
    kept = rows.join(heads, rows["doc_id"].eqNullSafe(heads["__id"]) & (rows["__digest"] == heads["__head"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__digest"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__words", word_count(F.col("text"))), "mixed")
    taken = mix(keyed.select("__row", "doc_id", "source", "__words"), F.col("__words"), keep=["__row"]).where("copies > 0")
    rows = keyed.join(taken.select("__row", "copies").hint("merge"), "__row")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the check that they decode to its text."""
    return encode_decode(docs, tokenizer_path(PIECE_FILE), keep=["doc_id", "lang", "source"], cache_words=PIPELINE_CACHE_WORDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Trained models and the forest are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
