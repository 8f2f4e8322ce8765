"""Language of words and texts by a linear-chain conditional random field (operator 2).

Words are runs of letters with their combining marks. A word's features are its affixes (first and last one to four letters), its
2- to 4-grams and its identity in a lexicon learned with the model, all hashed into one table of weights
a language; between neighbouring words the model has learned transitions. Forward-backward over the
whole text gives each word a probability of each language, so a text that changes its language is
labelled word by word. The text's language is the one with the largest summed probability, its score
the mean probability. Its certainty is the mean of each word's largest probability: how surely its words are in
some language, whether one or several.

Training takes a bounded sample of labelled rows (FieldTraining.sample_docs and sample_bytes): those with the smallest hash
of their id. Only whole texts and labels are given, so stretches of differently labelled texts are joined
to show the model changes of language. Scoring keeps weights (size fixed by FieldTraining.buckets) and a
batch of texts in memory.

Defined results: a text that is null or has no letters, and every text where nothing could be learned, has
`und`, score and certainty 0 and no words; texts of any length are read whole; among equally probable languages the
first by code point wins; equal rows give equal results; an input column named like a result gives way to
it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.llm.common import SAMPLE_BYTES, distinct_ids, map_text, starts_of, within_bytes, worker_cache
from texloom.llm.features import WordCodes, words_of

UNKNOWN = "und"
BATCH_WORDS = 400_000

FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_changes", T.LongType()),
    T.StructField("certainty", T.DoubleType()),
]
SPANS = T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


@dataclass(frozen=True)
class FieldTraining:
    """sample_docs, sample_bytes: most labelled rows, and bytes of their texts, that training reads. stretch: words of one
    language in a row."""

    sample_docs: int = 1200
    sample_bytes: int = SAMPLE_BYTES
    buckets: int = 1 << 17
    stretch: int = 30
    rounds: int = 3
    rate: float = 0.2
    ridge: float = 1e-5
    seed: int = 11


@dataclass
class LanguageField:
    """A trained model: a row of weights for each bucket, transitions, and the languages."""

    langs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def _features(codes: WordCodes, buckets: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Bucket numbers by kind of feature; for n-grams with the number a word."""
    mask = np.uint32(buckets - 1)
    out = [(codes.whole(101) & mask, None)]
    for n in (1, 2, 3, 4):
        out += [(codes.edges(n, n) & mask, None), (codes.edges(n, 10 + n, last=True) & mask, None)]
    for n in (2, 3, 4):
        h, counts = codes.grams(n, 20 + n)
        out.append((h & mask, counts))
    return out


def emissions(words: list[str], model: LanguageField) -> np.ndarray:
    """Summed weights of each word's features."""
    codes = WordCodes(words)
    out = np.zeros((len(words), len(model.langs)), np.float32)
    for h, counts in _features(codes, len(model.weights)):
        if counts is None:
            out += model.weights[h]
        else:
            some = counts > 0
            if some.any():
                out[some] += np.add.reduceat(model.weights[h], starts_of(counts)[:-1][some], axis=0)
    return out


class _Packed:
    """Sequences side by side: slot t holds the t-th word of each sequence that is as long, longest first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        self.alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        self.slot = starts_of(self.alive)
        begin = starts_of(sizes)[:-1]
        which = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        self.place = self.slot[np.arange(len(which)) - begin[which]] + rank[which]

    def posteriors(self, scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probabilities of each word's label in the order of the input, expected transitions, and the log partition sum."""
        top = scores.max(axis=1, keepdims=True)
        emit = np.empty_like(scores)
        emit[self.place] = np.exp(scores - top)
        trans, first = np.exp(moves), np.exp(start)
        total = float(top.sum())
        alpha = np.empty_like(emit)
        norm = np.empty(len(emit), emit.dtype)
        for t, n in enumerate(self.alive):
            a, b = self.slot[t], self.slot[t] + n
            row = emit[a:b] * (first if t == 0 else alpha[self.slot[t - 1] : self.slot[t - 1] + n] @ trans)
            norm[a:b] = row.sum(axis=1)
            alpha[a:b] = row / norm[a:b, None]
        total += float(np.log(norm).sum())
        gamma = np.empty_like(emit)
        expected = np.zeros_like(trans, dtype=np.float64)
        after = np.zeros((0, emit.shape[1]), emit.dtype)
        for t in range(len(self.alive) - 1, -1, -1):
            a, n = self.slot[t], self.alive[t]
            beta = np.ones((n, emit.shape[1]), emit.dtype)
            if len(after):
                beta[: len(after)] = after @ trans.T
                expected += (alpha[a : a + len(after)].T @ after) * trans
            gamma[a : a + n] = alpha[a : a + n] * beta
            after = emit[a : a + n] * beta / norm[a : a + n, None]
        return gamma[self.place], expected, total


def train_field(texts: list[str], labels: list[str], how: FieldTraining) -> LanguageField:
    """Maximum conditional likelihood by AdaGrad over joined stretches of labelled texts."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageField()
    rng = np.random.default_rng(how.seed)
    stretches = []
    for text, lang in zip(texts, labels, strict=True):
        words = words_of(text)
        stretches += [(langs.index(lang), words[i : i + how.stretch]) for i in range(0, len(words), how.stretch)]
    stretches = [s for s in stretches if s[1]]
    if not stretches:
        return LanguageField()
    flat = [w for _, words in stretches for w in words]
    ids, vocabulary = distinct_ids(flat)
    sizes = np.array([len(w) for _, w in stretches])
    bounds, label = starts_of(sizes), np.array([y for y, _ in stretches])
    k = len(langs)
    table: list[list[np.ndarray]] = []
    for h, counts in _features(WordCodes(vocabulary), how.buckets):
        owner = np.arange(len(vocabulary)) if counts is None else np.repeat(np.arange(len(vocabulary)), counts)
        table.append([owner, h.astype(np.int64)])
    owner, bucket = (np.concatenate(x) for x in zip(*table, strict=True))
    by_word = np.argsort(owner, kind="stable")
    owner, bucket = owner[by_word], bucket[by_word]
    first = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    model = LanguageField(langs, np.zeros((how.buckets, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    square = [np.full(x.shape, 1e-4) for x in (model.weights, model.start, model.moves)]
    for _ in range(how.rounds):
        order = rng.permutation(len(stretches))
        for batch in np.array_split(order, max(1, len(order) // 600)):
            # two to four stretches make a sequence; neighbours differ in language as often as the sample does
            cuts = np.sort(rng.choice(np.arange(1, len(batch) + 1), size=min(len(batch), max(1, len(batch) // 3)), replace=False))
            group = np.searchsorted(cuts, np.arange(len(batch)), side="right")
            words = np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in batch])
            gold = np.repeat(label[batch], sizes[batch])
            lengths = np.bincount(np.repeat(group, sizes[batch]))
            lengths = lengths[lengths > 0]
            used, inverse = np.unique(words, return_inverse=True)
            counts = first[used + 1] - first[used]
            at = np.repeat(first[used] - starts_of(counts)[:-1], counts) + np.arange(counts.sum())
            row = np.repeat(np.arange(len(used)), counts)
            scores = np.zeros((len(used), k), np.float32)
            np.add.at(scores, row, model.weights[bucket[at]])
            gamma, expected, _ = _Packed(lengths).posteriors(scores[inverse], model.start, model.moves)
            heads = starts_of(lengths)[:-1]
            error = gamma.astype(np.float64)
            error[np.arange(len(gold)), gold] -= 1
            seen = np.zeros((k, k))
            inner = np.ones(len(gold), bool)
            inner[heads] = False
            np.add.at(seen, (gold[np.nonzero(inner)[0] - 1], gold[inner]), 1)
            by_used = np.zeros((len(used), k))
            np.add.at(by_used, inverse, error)
            slope = np.stack([np.bincount(bucket[at], by_used[row, c], how.buckets) for c in range(k)], axis=1)
            for value, total, grad in zip((model.weights, model.start, model.moves), square, (slope, error[heads].sum(axis=0), expected - seen), strict=True):
                grad = grad / len(lengths) + how.ridge * value
                total += grad * grad
                value -= (how.rate * grad / np.sqrt(total)).astype(np.float32)
    return model


def sample_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> list:
    """At most `most` labelled rows with a text: those with the smallest hash of their id, less what would pass `most_bytes`.
    Ids and sizes are chosen before texts are read."""
    spark = docs.sparkSession
    order = [F.xxhash64(F.lit("sample"), F.col(id_col)), F.col(id_col)]
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    # sorted by short columns, or each task's first texts would go to the driver
    sizes = labelled.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("__size")).orderBy(*order, "__size")
    ids = within_bytes([tuple(r) for r in sizes.limit(most).collect()], most_bytes)
    if not ids:
        return []
    chosen = spark.createDataFrame([(i,) for i in sorted(set(ids))], T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]))
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, label_col)
    # a repeated id may bring more rows than were chosen: no more than the bounds
    found = rows.join(F.broadcast(chosen), id_col).orderBy(*order, text_col, label_col).limit(most).toLocalIterator()
    out, held = [], 0
    for r in found:
        if (held := held + len(r[text_col].encode())) > most_bytes:
            break
        out.append((r[text_col], r[label_col]))
    return out


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: FieldTraining | None = None) -> LanguageField:
    """Train on a bounded sample of the labelled rows of docs."""
    how = how or FieldTraining()
    rows = sample_rows(docs, id_col, text_col, lang_col, how.sample_docs, how.sample_bytes)
    return train_field([t for t, _ in rows], [str(x) for _, x in rows], how)


def _of_texts(texts: list[list[str]], model: LanguageField) -> np.ndarray:
    """Posteriors of all words of all texts, end to end."""
    ids, vocabulary = distinct_ids([w for words in texts for w in words])
    scores = emissions(vocabulary, model)
    packed = _Packed(np.fromiter(map(len, texts), np.int64, len(texts)))
    return packed.posteriors(scores[ids], model.start, model.moves)[0]


def label_language(docs: DataFrame, model: LanguageField, text_col: str = "text", keep: list[str] | None = None, spans: bool = False, least_score: float | None = None, least_certainty: float | None = None) -> DataFrame:
    """Append FIELDS (with spans, the runs of words by language), or with least_score or least_certainty keep only the rows whose
    text has a language and at least that score and certainty."""
    chosen = least_score is not None or least_certainty is not None
    fields = [*FIELDS, T.StructField("accepted", T.BooleanType())] if chosen else [*FIELDS, SPANS] if spans else FIELDS
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.start, model.moves))

    def make():
        worker_cache("language")
        own = LanguageField(*shared.value)

        def some(texts: list[list[str]]) -> tuple[list, list, list, list, list]:
            bounds = starts_of(np.fromiter(map(len, texts), np.int64, len(texts)))
            if not own.langs or not bounds[-1]:
                return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            gamma = _of_texts(texts, own)
            full = np.nonzero(np.diff(bounds))[0]
            sums = np.add.reduceat(gamma.astype(np.float64), bounds[full], axis=0)
            best = sums.argmax(axis=1)
            sure = np.add.reduceat(gamma.max(axis=1).astype(np.float64), bounds[full])
            langs, scores, changes, certain, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            label = gamma.argmax(axis=1)
            turn = np.zeros(len(label), np.int64)
            turn[1:] = label[1:] != label[:-1]
            turn[bounds[full]] = 0
            turns = np.add.reduceat(turn, bounds[full])
            for j, i in enumerate(full):
                langs[i] = own.langs[best[j]]
                scores[i] = min(1.0, float(sums[j, best[j]] / (bounds[i + 1] - bounds[i])))
                changes[i] = int(turns[j])
                certain[i] = min(1.0, float(sure[j] / (bounds[i + 1] - bounds[i])))
                if spans:
                    part = label[bounds[i] : bounds[i + 1]]
                    cut = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(part)]
                    runs[i] = [{"lang": own.langs[part[a]], "start": a, "end": b} for a, b in zip(cut, cut[1:], strict=False)]
            return langs, scores, changes, certain, runs

        def work(column: pa.Array) -> list[pa.Array]:
            out: tuple[list, ...] = ([], [], [], [], [])
            part, n = [], 0
            texts = column.to_pylist()
            for i, text in enumerate(texts):
                part.append(words_of(text) if text else [])
                n += len(part[-1])
                if n >= BATCH_WORDS or i + 1 == len(texts):
                    for whole, found in zip(out, some(part), strict=True):
                        whole += found
                    part, n = [], 0
            langs, scores, changes, certain, runs = out
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(changes, pa.int64()), pa.array(certain, pa.float64())]
            if chosen:
                enough = [x != UNKNOWN and s >= (least_score or 0) and c >= (least_certainty or 0) for x, s, c in zip(langs, scores, certain, strict=True)]
                made.append(pa.array(enough, pa.bool_()))
            elif spans:
                made.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            return made

        return work

    return map_text(docs, text_col, fields, make, keep, "accepted" if chosen else None)
