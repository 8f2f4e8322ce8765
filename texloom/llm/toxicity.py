"""Severity of toxic language by cumulative-link ordinal regression (operator 9).

A text's severity is an ordered grade 0..K-1. The model is P(grade <= j) = logistic(theta_j - s) with
thresholds theta in order and one score s = sum of the weights of the text's features for all of them.
Features are sparse and hashed: each distinct word of the text counts its identity and its first four and
five letters; only features that go with toxic rows beyond chance have weights. Results are the grade probabilities' mode, the expected severity sum(j * P(grade = j)), the
probability of any toxicity P(grade > 0), and the verdict.

Labels say toxic or not. The grades of toxic rows of the training sample follow how many distinct words
they have that mark toxic rows (by document frequency, smoothed log odds): thirds of them are grades 1 to 3. The marks
of a row are learned from the other half of the sample, so a row's grade doesn't rest on its own words' counts.

Training takes a bounded sample of labelled rows (OrdinalTraining.sample_docs and sample_bytes, half of them toxic where
there are as many): those with the smallest hash of their id. Scoring keeps one table of weights (a size
fixed by OrdinalTraining.buckets) and a batch of texts in memory.

Defined results: a null or empty text has no features and is graded by the thresholds alone; where nothing
could be learned every text has grade 0, severity 0 and probability 0; texts of any length are read whole;
a document labelled twice counts as toxic if one label says so; equal rows give equal results; an input
column named like a result gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.llm.common import SAMPLE_BYTES, distinct_ids, map_text, segment_sums, starts_of, within_bytes, worker_cache
from texloom.llm.features import WordCodes, words_of

BATCH_WORDS = 400_000

FIELDS = [
    T.StructField("severity", T.IntegerType()),
    T.StructField("expected_severity", T.DoubleType()),
    T.StructField("p_toxic", T.DoubleType()),
    T.StructField("toxic", T.BooleanType()),
]


@dataclass(frozen=True)
class OrdinalTraining:
    """sample_docs, sample_bytes: most labelled rows, and bytes of their texts, that training reads."""

    sample_docs: int = 3000
    sample_bytes: int = SAMPLE_BYTES
    buckets: int = 1 << 18
    grades: int = 3
    least_docs: int = 2
    least_odds: float = 1.0
    least_z: float = 2.0
    marks_at: float = 2.5
    rounds: int = 300
    rate: float = 0.3
    ridge: float = 3e-4


@dataclass
class OrdinalModel:
    """weights by bucket, thresholds in order (none: nothing was learned)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = j) for each score."""
        if not len(self.thresholds):
            return np.ones((len(scores), 1))
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        edge = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edge, axis=1)


def _buckets(words: list[str], buckets: int) -> np.ndarray:
    """The features of each word, a row a word."""
    codes, mask = WordCodes(words), np.uint32(buckets - 1)
    return np.stack([codes.whole(7) & mask, codes.edges(4, 8) & mask, codes.edges(5, 9) & mask], axis=1).astype(np.int64)


def _distinct(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Distinct words of each text, end to end, and the bounds of the texts."""
    sets = [list(dict.fromkeys(words_of(t))) if t else [] for t in texts]
    return [w for s in sets for w in s], starts_of(np.fromiter(map(len, sets), np.int64, len(sets)))


def _odds(pair: np.ndarray, toxic: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the given rows: toxic ones and all that have each bucket, and its smoothed log odds. pair: row * buckets + bucket."""
    owner = pair // buckets
    own = pair[rows[owner]]
    in_toxic = np.bincount(own[toxic[own // buckets]] % buckets, minlength=buckets)
    in_all = np.bincount(own % buckets, minlength=buckets)
    y = toxic & rows
    return in_toxic, in_all, np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_all - in_toxic + 0.5) / ((rows & ~toxic).sum() + 1))


def loss_and_slopes(beta: np.ndarray, theta: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood with a ridge on beta, and its derivatives by beta and theta.

    row, column: the sparse features of the texts; grade: each text's, 0 to len(theta).
    """
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    k = len(theta)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, k - 1)
    s = np.bincount(row, beta[column], len(grade))
    upper = np.where(grade < k, logistic(theta[high] - s), 1.0)
    lower = np.where(grade > 0, logistic(theta[low] - s), 0.0)
    p = np.maximum(upper - lower, 1e-12)
    up, down = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
    slope = np.bincount(column, (up - down)[row], len(beta)) + ridge * beta
    bend = np.bincount(low[grade > 0], down[grade > 0], k) - np.bincount(high[grade < k], up[grade < k], k)
    return float(-(weight * np.log(p)).sum() + ridge / 2 * (beta @ beta)), slope, bend


def train_ordinal(texts: list[str], toxic: list[bool], how: OrdinalTraining) -> OrdinalModel:
    """Maximum likelihood with a ridge, by AdaGrad over all rows."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return OrdinalModel()
    words, bounds = _distinct(texts)
    ids, vocabulary = distinct_ids(words)
    features = _buckets(vocabulary, how.buckets)[ids]
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = np.unique(np.repeat(doc, features.shape[1]) * how.buckets + features.ravel())
    in_toxic, in_all, odds = _odds(pair, y, np.ones(len(y), bool), how.buckets)
    marks = np.zeros(len(texts), np.int64)
    half = np.arange(len(texts)) % 2 == 0
    for own in (half, ~half):
        marked = (_odds(pair, y, ~own, how.buckets)[2] > how.marks_at)[features].any(axis=1)
        marks += np.bincount(doc[marked], minlength=len(texts)) * own
    cuts = np.unique(np.quantile(marks[y], np.arange(1, how.grades) / how.grades))
    grade = np.where(y, 1 + np.searchsorted(cuts, marks, side="left"), 0)
    present = np.unique(grade)
    grade = np.searchsorted(present, grade)
    spread = np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_all - in_toxic + 0.5))
    used = np.nonzero((in_all >= how.least_docs) & (odds >= how.least_odds) & (odds >= how.least_z * spread))[0]
    slot = np.full(how.buckets, -1)
    slot[used] = np.arange(len(used))
    column = slot[features.ravel()]
    row = np.repeat(doc, features.shape[1])[column >= 0]
    column = column[column >= 0]
    k = len(present) - 1
    beta, square = np.zeros(len(used)), np.full(len(used), 1e-6)
    # toxic and other rows weigh the same in all, however many of each the sample has
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    share = np.cumsum(np.bincount(grade, weight))[:-1]
    theta = np.log(share / (1 - share))
    theta_square = np.full(k, 1e-6)
    for _ in range(how.rounds):
        _, slope, bend = loss_and_slopes(beta, theta, row, column, grade, weight, how.ridge)
        square += slope * slope
        theta_square += bend * bend
        beta -= how.rate * slope / np.sqrt(square)
        theta = np.maximum.accumulate(theta - how.rate * bend / np.sqrt(theta_square))
        theta += np.arange(k) * 1e-6
    weights = np.zeros(how.buckets, np.float32)
    weights[used] = beta
    return OrdinalModel(weights, theta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", how: OrdinalTraining | None = None) -> OrdinalModel:
    """Train on a bounded sample of labelled rows of docs. Labels are read first; texts only of the chosen ids."""
    how = how or OrdinalTraining()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("y"))
    spark = docs.sparkSession
    pick = lambda name: [F.xxhash64(F.lit(name), F.col(id_col)), F.col(id_col)]
    chosen: dict = {}
    for value in (True, False):
        rows = known.where(F.col("y") == value).orderBy(*pick("sample")).limit(how.sample_docs // 2).collect()
        chosen |= {r[0]: value for r in rows}
    if not chosen:
        return OrdinalModel()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("y", T.BooleanType())])
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    sizes = texts.join(F.broadcast(spark.createDataFrame(sorted(chosen.items()), schema)), id_col).select(id_col, F.octet_length(text_col).alias("__size"))
    ids = set(within_bytes([tuple(r) for r in sizes.orderBy(F.xxhash64(F.col(id_col)), id_col, "__size").limit(how.sample_docs).collect()], how.sample_bytes))
    few = spark.createDataFrame(sorted((i, y) for i, y in chosen.items() if i in ids), schema)
    found, held = [], 0
    for r in texts.join(F.broadcast(few), id_col).orderBy(F.xxhash64(F.col(id_col)), id_col, text_col).limit(how.sample_docs).toLocalIterator():
        if (held := held + len(r[text_col].encode())) > how.sample_bytes:
            break
        found.append((r[text_col], r["y"]))
    return train_ordinal([t for t, _ in found], [y for _, y in found], how)


def grade_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep: list[str] | None = None, toxic_at: float = 0.5, only_clean: bool = False) -> DataFrame:
    """Append FIELDS (toxic: p_toxic >= toxic_at), or keep only the rows that are not toxic."""
    fields = [*FIELDS, T.StructField("clean", T.BooleanType())] if only_clean else FIELDS
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def make():
        worker_cache("toxicity")
        own = OrdinalModel(*shared.value)

        def score(texts: list[str | None]) -> np.ndarray:
            if not len(own.thresholds):
                return np.zeros(len(texts))
            words, bounds = _distinct(texts)
            ids, vocabulary = distinct_ids(words)
            by_word = own.weights[_buckets(vocabulary, len(own.weights))].sum(axis=1, dtype=np.float64) if vocabulary else np.zeros(0)
            return segment_sums(by_word[ids], bounds)

        def work(column: pa.Array) -> list[pa.Array]:
            texts, parts, i = column.to_pylist(), [np.zeros(0)], 0
            while i < len(texts):
                j, weight = i, 0
                while j < len(texts) and (j == i or weight < BATCH_WORDS):
                    weight += len(texts[j] or "") // 6
                    j += 1
                parts.append(score(texts[i:j]))
                i = j
            p = own.probabilities(np.concatenate(parts))
            p_toxic = 1 - p[:, 0]
            toxic = p_toxic >= toxic_at
            out = [pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p @ np.arange(p.shape[1])), pa.array(p_toxic), pa.array(toxic)]
            return [*out, pa.array(~toxic)] if only_clean else out

        return work

    return map_text(docs, text_col, fields, make, keep, "clean" if only_clean else None)
