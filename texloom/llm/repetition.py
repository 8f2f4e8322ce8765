"""Quality rules by suffix arrays (operator 4).

Each text is a sequence of words ``[^\\x20\\x09-\\x0D]+``. A suffix array over the words of a batch of
texts, built by prefix doubling within each text, gives the longest common prefix of neighbouring
suffixes; its intervals of at least ``min_words`` words whose occurrences do not all follow the same word are the
maximal repeats. The union of their spans against all words and the longest repeat decide, and so does the union
of the spans of maximal repeats of at least ``short_words`` words, fewer than the base rule's windows have. Nested
intervals are not spread out: each suffix counts with the longest maximal one that has it.

Doubling refines only suffixes that still share a prefix with another of their text, so a text
without repeats costs one sort of its words; the number of rounds is the logarithm of the longest
repeat. Memory: a few 8-byte numbers a word of a batch (BATCH_WORDS words or one text).

Defined results: a null or empty text has no words, all counts are 0, the base rules fail; texts of
any length are read whole; equal rows give equal results; an input column named like a result gives
way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from texloom.llm.common import distinct_ids, map_text, starts_of, text_bytes, worker_cache

SYMBOLS = b"#*$%&|<>"
BATCH_WORDS = 600_000
#: Words of the windows of the base rule on repeats.
WINDOW = 8

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_maximal_repeats", T.LongType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("short_covered_words", T.LongType()),
    T.StructField("kept", T.BooleanType()),
]
SPANS = T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


@dataclass(frozen=True)
class RepetitionRules:
    """Limits. min_words: shortest repeat that counts. max_covered: largest share of words under repeats.
    max_longest: most words of one repeat. short_words, max_short_covered: the same share for repeats that may be
    shorter than the base rule's windows; it decides where phrases of a few words fill a text."""

    min_words: int = WINDOW
    max_covered: float = 0.3
    max_longest: int = 100
    short_words: int = 3
    max_short_covered: float = 0.4
    base_min_words: int = 20
    base_max_repeat_percent: int = 30


class SuffixArray:
    """Suffix arrays of several word sequences at once.

    sa: positions, text by text, in suffix order. levels[j]: for each position the rank of its first
    2**j words within its text; equal ranks mean equal words.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        self.n, self.bounds = n, bounds
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.end = bounds[self.text + 1] if n else np.zeros(0, np.int64)
        at = np.arange(n)
        key = self.text * (int(ids.max(initial=0)) + 1) + ids
        self.sa = np.argsort(key, kind="stable")
        first = np.ones(n, bool)
        first[1:] = np.diff(key[self.sa]) != 0
        rank = np.empty(n, np.int64)
        rank[self.sa] = np.maximum.accumulate(np.where(first, at, 0)) if n else at
        self.levels = [rank.astype(np.int32)]
        #: slots of the suffix array still shared at each level
        self.shared = []
        active = self._shared(first, at)
        h = 1
        while len(active):
            self.shared.append(active)
            pos = self.sa[active]
            after = pos + h
            inside = after < self.end[pos]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[pos] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            pos, key = pos[order], key[order]
            self.sa[active] = pos
            first = np.ones(len(pos), bool)
            first[1:] = np.diff(key) != 0
            rank[pos] = np.maximum.accumulate(np.where(first, active, 0))
            self.levels.append(rank.astype(np.int32))
            active = active[self._shared(first, np.arange(len(pos)))]
            h *= 2
        self.shared.append(active)

    @staticmethod
    def _shared(first: np.ndarray, at: np.ndarray) -> np.ndarray:
        alone = first.copy()
        alone[:-1] &= first[1:]
        return at[~alone]

    def repeated_windows(self, words: int) -> np.ndarray:
        """Positions whose next `words` (a power of two) words occur twice or more in their text."""
        level = words.bit_length() - 1
        return self.sa[self.shared[level]] if level < len(self.shared) else np.zeros(0, np.int64)

    def common_prefixes(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots k, and the common prefix of sa[k - 1] and sa[k], where that is at least `least` words."""
        level = least.bit_length() - 1
        if level >= len(self.shared) or not len(self.shared[level]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = self.shared[level]
        k = k[k > 0]
        a, b = self.sa[k - 1].copy(), self.sa[k].copy()
        same = self.levels[level][a] == self.levels[level][b]
        k, a, b = k[same], a[same], b[same]
        length = np.zeros(len(k), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            ok = (a < self.end[self.sa[k]]) & (b < self.end[self.sa[k]])
            ok[ok] = self.levels[j][a[ok]] == self.levels[j][b[ok]]
            step = ok * (1 << j)
            length += step
            a += step
            b += step
        long = length >= least
        return k[long], length[long]


@dataclass
class Intervals:
    """Intervals of the common-prefix array: for each its length in words, its first and last slot, and the interval around
    it (-1: none). slots: positions k of the array; owner: the interval that has the common prefix of slots k - 1 and k."""

    length: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    slots: np.ndarray
    owner: np.ndarray


def lcp_intervals(slots: np.ndarray, lengths: np.ndarray) -> Intervals:
    """Every interval of the common-prefix array, from its positions that are not zero, by a stack."""
    length: list[int] = []
    left: list[int] = []
    right: list[int] = []
    parent: list[int] = []
    owner, stack, before = [], [], -2
    for k, value in zip(slots.tolist(), lengths.tolist(), strict=True):
        if k != before + 1:
            while stack:
                t = stack.pop()
                right[t], parent[t] = before, stack[-1] if stack else -1
        begin = k - 1
        while stack and length[stack[-1]] > value:
            t = stack.pop()
            right[t], begin = before, left[t]
            parent[t] = stack[-1] if stack and length[stack[-1]] >= value else len(length)
        if not stack or length[stack[-1]] < value:
            stack.append(len(length))
            length.append(value)
            left.append(begin)
            right.append(0)
            parent.append(-1)
        owner.append(stack[-1])
        before = k
    while stack:
        t = stack.pop()
        right[t], parent[t] = before, stack[-1] if stack else -1
    return Intervals(*(np.array(x, np.int64) for x in (length, left, right, parent)), slots, np.array(owner, np.int64))


def left_maximal(found: Intervals, array: SuffixArray, ids: np.ndarray) -> np.ndarray:
    """Whether the occurrences of each interval do not all follow the same word; one at a text's start follows none."""
    if not len(found.length):
        return np.zeros(0, bool)
    follows = np.where(array.sa > array.bounds[array.text[array.sa]], ids[array.sa - 1], -1)
    turns = starts_of(follows[1:] != follows[:-1])
    return turns[found.right] > turns[found.left]


def longest_maximal(found: Intervals, maximal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of maximal intervals and for each the longest one that has it. An interval that isn't maximal passes on what is
    around it: its words are covered by the longer repeat one word to the left."""
    value = np.where(maximal, found.length, 0)
    open_ = np.nonzero(~maximal & (found.parent >= 0))[0]
    up = found.parent[open_]
    while len(open_):
        done = maximal[up] | (found.parent[up] < 0)
        value[open_[done]] = np.where(maximal[up[done]], found.length[up[done]], 0)
        open_, up = open_[~done], found.parent[up[~done]]
    slots = np.concatenate([found.slots, found.slots - 1])
    reach = np.concatenate([value[found.owner], value[found.owner]])
    order = np.lexsort((reach, slots))
    slots, reach = slots[order], reach[order]
    last = np.append(slots[1:] != slots[:-1], True) if len(slots) else np.zeros(0, bool)
    last &= reach > 0
    return slots[last], reach[last]


def maximal_repeats(words: list, least: int = WINDOW) -> list[tuple[int, list[int]]]:
    """Every maximal repeat of at least `least` words of one text: its length and its positions."""
    ids, _ = distinct_ids(words)
    array = SuffixArray(ids, np.array([0, len(ids)]))
    found = lcp_intervals(*array.common_prefixes(least))
    keep = np.nonzero(left_maximal(found, array, ids))[0]
    return [(int(found.length[i]), sorted(array.sa[found.left[i] : found.right[i] + 1].tolist())) for i in keep]


def union_of_spans(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each of n positions, whether a span covers it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _of_batch(texts: list[bytes], rules: RepetitionRules, spans: bool) -> tuple[np.ndarray, list | None]:
    """A row for each text: n_words, n_repeat_words, covered words, longest repeat, words covered by short repeats too, and how
    many maximal repeats there are."""
    split = [x.split() for x in texts]
    bounds = starts_of(np.fromiter(map(len, split), np.int64, len(split)))
    ids, _ = distinct_ids([w for words in split for w in words])
    n = len(ids)
    array = SuffixArray(ids, bounds)
    at = array.repeated_windows(WINDOW)
    repeated = union_of_spans(n, at, at + WINDOW)
    found = lcp_intervals(*array.common_prefixes(min(rules.min_words, rules.short_words)))
    maximal = left_maximal(found, array, ids)
    slots, reach = longest_maximal(found, maximal)
    begin = array.sa[slots]
    short = reach >= rules.short_words
    short_covered = union_of_spans(n, begin[short], (begin + reach)[short])
    long = reach >= rules.min_words
    begin, reach = begin[long], reach[long]
    covered = union_of_spans(n, begin, begin + reach)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, array.text[begin], reach)
    rows = np.empty((len(texts), 6), np.int64)
    counted = maximal & (found.length >= rules.min_words)
    rows[:, 5] = np.bincount(array.text[array.sa[found.left[counted]]], minlength=len(texts))
    rows[:, 0] = np.diff(bounds)
    for j, flags in ((1, repeated), (2, covered), (4, short_covered)):
        total = starts_of(flags)
        rows[:, j] = total[bounds[1:]] - total[bounds[:-1]]
    rows[:, 3] = longest
    if not spans:
        return rows, None
    lists = []
    for i in range(len(texts)):
        flags = np.diff(np.concatenate([[0], covered[bounds[i] : bounds[i + 1]].astype(np.int8), [0]]))
        lists.append([{"start": int(a), "end": int(b)} for a, b in zip(np.nonzero(flags == 1)[0], np.nonzero(flags == -1)[0], strict=True)])
    return rows, lists


def _plain_counts(texts: list[bytes]) -> np.ndarray:
    """word_chars, n_symbols and n_dup_lines of each text."""
    kind = np.zeros((2, 256), np.uint8)
    kind[0] = [(x & 0xC0) != 0x80 and x not in b" \t\n\v\f\r" for x in range(256)]
    kind[1] = [x in SYMBOLS for x in range(256)]
    rows = np.zeros((len(texts), 3), np.int64)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        rows[i, 0] = np.count_nonzero(kind[0][raw])
        rows[i, 1] = np.count_nonzero(kind[1][raw])
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            rows[i, 2] = len(lines) - len(set(lines))
    return rows


def repetition(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None, keep: list[str] | None = None, spans: bool = False, only_kept: bool = False) -> DataFrame:
    """Append FIELDS (and with spans, the union of the repeats as word ranges), or keep only rows whose verdict is kept."""
    rules = rules or RepetitionRules()
    fields = [*FIELDS, SPANS] if spans else FIELDS

    def make():
        worker_cache("repetition")

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [x or b"" for x in text_bytes(column)]
            plain = _plain_counts(texts)
            parts, lists, i = [], [], 0
            while i < len(texts):
                j, weight = i, 0
                while j < len(texts) and (j == i or weight + len(texts[j]) // 4 < BATCH_WORDS):
                    weight += len(texts[j]) // 4
                    j += 1
                rows, more = _of_batch(texts[i:j], rules, spans)
                parts.append(rows)
                lists += more or []
                i = j
            rows = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
            n, repeat, covered, longest, short, repeats = rows.T
            failed = (n < rules.base_min_words) | (100 * repeat > rules.base_max_repeat_percent * n)
            kept = ~failed & (covered <= rules.max_covered * n) & (longest <= rules.max_longest) & (short <= rules.max_short_covered * n)
            out = [n, plain[:, 0], plain[:, 1], plain[:, 2], repeat, failed, repeats, covered, longest, short, kept]
            return [pa.array(x) for x in out] + ([pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] if spans else [])

        return work

    return map_text(docs, text_col, fields, make, keep, "kept" if only_kept else None)
