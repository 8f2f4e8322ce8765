"""Token counts by prefix dynamic programming (operator 3).

For a byte-level BPE vocabulary, each prefix of a word has exactly one last token: the token that ends
there and forms a valid pair with the last token of the prefix before it. So one pass over a word gives
the exact token count of each of its prefixes; counts of a text's prefixes follow by adding up words.
They are stored as differences, one signed byte a code point, and answer "how many tokens have the
first n characters" and "how many characters fit a budget" without encoding anything again.

Prefixes are counted as if the text ended there: a run of white space before a word, a contraction or a
special string that a prefix cuts counts as the library counts the cut text.

The vocabulary file is read by the driver and sent to the workers. Words are kept in a bounded cache a worker; memory follows the batch and its longest text.

Defined results: a null text counts as empty, an empty text has 0 bytes and 0 tokens; texts of any
length are read whole; equal rows give equal results; an input column named like a result gives way to
it; an empty table gives an empty result. A code point that changed the count by more than a signed byte holds
would raise, not wrap.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from texloom.llm.common import TailLengths, file_bytes, map_text, worker_cache

#: The vocabulary's pattern of words (with \\s spelled as the library reads it).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACE_RUN = r"\p{White_Space}{2,}(?=\P{White_Space})"
#: Contractions of three characters; two of them form two words.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
CACHE_WORDS, CACHE_PREFIXES, CACHED_LENGTH = 700_000, 1_200_000, 64

FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
    T.StructField("chars_in_limit", T.LongType()),
]
DELTAS = T.StructField("prefix_deltas", T.BinaryType())


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word -> differences of its prefixes' counts, computed at need."""

    def __init__(self, counter: "PrefixCounter"):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        found = self.counter.word_deltas(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class PrefixCounter:
    """Counts the tokens of every prefix of a text for a byte-level BPE tokenizer file, or its bytes."""

    def __init__(self, path: str | None = None, raw: bytes | None = None):
        spec = json.loads(file_bytes(path) if raw is None else raw)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.token = {i: b for b, i in self.ids.items()}
        self.tails = TailLengths(self.ids)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._word = regex.compile(WORD_PATTERN)
        self._run = regex.compile(SPACE_RUN)
        self._prefixes: dict[bytes, int] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.words = _Words(self)

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of a short string, by merging pairs in their order."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ids[p] for p in parts]

    def _first(self, token: int) -> bool:
        """Whether the token's own string is encoded as that token."""
        if (found := self._whole.get(token)) is None:
            found = self._whole[token] = self.merge(self.token[token]) == [token]
        return found

    def _pair(self, a: int, b: int) -> bool:
        """Whether two tokens can follow each other in an encoding."""
        key = a << 20 | b
        if (found := self._pairs.get(key)) is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            found = self._pairs[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return found

    def byte_counts(self, raw: bytes) -> list[int]:
        """Token counts of all prefixes of one word's bytes, the empty one included. Short words begin with what is known of
        their prefixes from other words."""
        n, j = len(raw), 0
        last, count = [-1] * (n + 1), [0] * (n + 1)
        ids, pairs, tails = self.ids, self._pairs, self.tails
        prefixes = self._prefixes if n <= CACHED_LENGTH else None
        if prefixes is not None:
            while j < n and (known := prefixes.get(raw[: j + 1])) is not None:
                j += 1
                last[j], count[j] = known >> 8, known & 255
        while j < n:
            j += 1
            for length in tails[raw[j - 3 : j] if j > 3 else raw[:j]]:
                i = j - length
                if i > 0:
                    if (token := ids.get(raw[i:j])) is None:
                        continue
                    if (good := pairs.get(last[i] << 20 | token)) is None:
                        good = self._pair(last[i], token)
                elif i == 0:
                    good = (token := ids.get(raw[:j])) is not None and self._first(token)
                else:
                    continue
                if good:
                    last[j], count[j] = token, count[i] + 1
                    break
            if prefixes is not None:
                if len(prefixes) >= CACHE_PREFIXES:
                    prefixes.clear()
                prefixes[raw[:j]] = last[j] << 8 | count[j]
        return count

    def word_deltas(self, word: str) -> bytes:
        """For each code point, by how much it changes the count."""
        raw = word.encode()
        count = self.byte_counts(raw)
        if len(raw) == len(word):
            at = count[1:]
        else:
            ends = [i + 1 for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
            at = [count[i] for i in ends]
        if word in LONG_CONTRACTIONS:
            at[1] = 1 + self.byte_counts(raw[1:2])[1]
        steps = [b - a for a, b in zip([0, *at], at)]  # noqa: B905
        if max(steps, default=0) > 127 or min(steps, default=0) < -128:
            raise OverflowError("a code point changes the count by more than a stored difference holds")
        return bytes([x & 255 for x in steps])

    def _words(self, text: str) -> np.ndarray:
        """Differences word by word; their sum is the count of the whole text."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, self._word.findall(text))), np.int8)

    def _cut_runs(self, text: str, deltas: np.ndarray) -> np.ndarray:
        """Put right the prefixes that end with a whole run of white space that a word follows."""
        own = None
        for m in self._run.finditer(text):
            a, b = m.span()
            if own is None:
                own = deltas = deltas.copy()
            total = lambda run: int(np.frombuffer(self.words[run], np.int8).sum(dtype=np.int64))
            move = total(text[a:b]) - total(text[a : b - 1]) - int(deltas[b - 1])
            if not (-128 <= deltas[b - 1] + move <= 127 and -128 <= deltas[b] - move <= 127):
                raise OverflowError("a code point changes the count by more than a stored difference holds")
            deltas[b - 1] += move
            deltas[b] -= move
        return deltas

    def _segment(self, text: str) -> np.ndarray:
        """Prefix differences of a text without special strings."""
        return self._cut_runs(text, self._words(text))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def deltas(self, text: str) -> np.ndarray:
        """For each code point of the text, by how much it changes the token count of the prefix."""
        if not self.has_special(text):
            return self._segment(text)
        parts, begin = [], 0
        for a, b in (m.span() for m in self._special.finditer(text)):
            piece = self._segment(text[begin : b - 1]).astype(np.int64)
            before = int(piece[: a - begin].sum())
            parts += [piece, np.array([before + 1 - int(piece.sum())], np.int64)]
            begin = b
        parts.append(self._segment(text[begin:]).astype(np.int64))
        found = np.concatenate(parts)
        if found.max(initial=0) > 127 or found.min(initial=0) < -128:
            raise OverflowError("a code point changes the count by more than a stored difference holds")
        return found.astype(np.int8)

    def count(self, text: str) -> int:
        """Token count of a whole text: the last of its prefix counts."""
        return int(self.deltas(text).sum(dtype=np.int64))


def tokens_of_prefix(deltas: bytes, chars: int) -> int:
    """Tokens of the first `chars` code points, from stored differences."""
    return int(np.frombuffer(deltas, np.int8)[:chars].sum(dtype=np.int64))


def chars_within(deltas: bytes | np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    found = np.nonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)[0]
    return int(found[-1]) + 1 if len(found) else 0


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None, prefixes: bool = True) -> DataFrame:
    """Append FIELDS: bytes, tokens, whether over the limit, and the characters that fit it; and DELTAS, the stored table that
    answers any other prefix or budget (not returned if prefixes is false)."""
    fields = [*FIELDS, DELTAS] if prefixes else FIELDS

    raw = file_bytes(vocabulary)
    name, shared = zlib.crc32(raw), docs.sparkSession.sparkContext.broadcast(raw)

    def make():
        cache = worker_cache("prefix_tokens")
        counter = cache.get(name) or cache.setdefault(name, PrefixCounter(raw=shared.value))

        def work(column: pa.Array) -> list[pa.Array]:
            sizes, counts, fit, stored = [], [], [], []
            for text in column.to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                deltas = counter.deltas(text)
                n = int(deltas.sum(dtype=np.int64))
                counts.append(n)
                fit.append(chars_within(deltas, limit) if n > limit else len(text))
                if prefixes:
                    stored.append(deltas.tobytes())
            out = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fit, pa.int64())]
            return out + ([pa.array(stored, pa.binary())] if prefixes else [])

        return work

    return map_text(docs, text_col, fields, make, keep)
