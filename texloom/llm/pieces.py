"""SentencePiece encoding and decoding by a streaming Viterbi (operator 5).

The lattice of a text has a node for each character boundary and an edge for each piece. A node keeps one
backpointer. For a unigram model that is the edge of the best summed score; for a merge (BPE) model it is
the one piece that forms a valid pair with the piece before it, which is what the model's merges leave.
Only a window of nodes is retained: edges are no longer than the longest piece, so once the backpointer
paths of the last that many nodes meet in one boundary, no later path can avoid it, the ids up to it are
committed and its nodes are dropped. Where no piece spans a boundary (a word's end before a space) the
paths always meet, so a text is read in windows and the ids of each stretch between two such boundaries are committed
as they come; short stretches are kept in a bounded cache a worker, longer ones go node by node.
The model file is read by the driver and sent to the workers.

Pieces that the model ranks all alike (runs of spaces) are merged from the left, after all others.

Defined results: a null text counts as empty and has no ids; texts of any length are read whole; a
character outside the vocabulary becomes its byte pieces; where the model has none, a run of such characters is one unknown piece;
decoding gives the text back with U+2581 read as a space; equal rows give equal results; an input column
named like a result gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from texloom.llm.common import TailLengths, file_bytes, map_text, worker_cache

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Characters of a text whose chunks are held at once.
WINDOW = 1 << 16
#: Words that a worker keeps (with some more prefixes of words, about 300 bytes each), and the longest kept.
CACHE_WORDS, CACHED_LENGTH = 700_000, 64

FIELDS = [
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("n_ids", T.LongType()),
    T.StructField("decoded_crc32", T.LongType()),
    T.StructField("round_trip", T.BooleanType()),
]
DECODED = T.StructField("decoded", T.StringType())


class _Chunks(dict):
    """Chunk of a text -> its ids as little-endian bytes, computed at need."""

    def __init__(self, model: "PieceModel"):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        found = np.array(self.model.chunk_ids(chunk.replace(" ", SPACE)), np.int32).tobytes()
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= self.model.cache_words:
                self.clear()
            self[chunk] = found
        return found


class PieceModel:
    """Encodes and decodes by a SentencePiece model file of kind unigram or BPE."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(file_bytes(path) if proto is None else proto)
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or spec.normalizer_spec.precompiled_charsmap:
            raise ValueError("only unigram and BPE models without a table of character rules are read")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        if spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that remove spaces are not read")
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        normal = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type in (NORMAL, USER)}
        runs = {p: v for p, v in normal.items() if len(p) > 1 and not p.strip(SPACE)}
        #: space runs of one common rank; the lattice leaves them out
        self.runs = runs if self.kind == BPE and len(runs) > 1 and len({s for _, s in runs.values()}) == 1 else {}
        self.pieces = {p: v for p, v in normal.items() if p not in self.runs}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in normal.values()), default=0.0) - 10
        self.text = [b""] * len(spec.pieces)
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (NORMAL, USER):
                self.text[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == UNKNOWN:
                self.text[i] = " ⁇ ".encode()
        self.string = {i: p for p, (i, _) in self.pieces.items()}
        self.ids = {p: i for p, (i, _) in self.pieces.items()}
        self.score = {i: x for i, x in self.pieces.values()}
        self.tails = TailLengths(self.ids)
        #: whether no piece spans the boundary between a word and the space after it
        self.breaks = not any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:], strict=False))
        self._chunk = self._chunk_pattern(normal)
        #: characters of each piece; one for a character outside the vocabulary (-1)
        self.width = {i: len(p) for p, i in self.ids.items()} | {-1: 1}
        self._prefixes: dict[str, int] = {}
        self._pairs: dict[int, bool] = {}
        self._runs: dict[int, list[int]] = {}
        self.chunks = _Chunks(self)

    @staticmethod
    def _chunk_pattern(pieces: dict) -> re.Pattern:
        """Matches stretches between boundaries that no piece spans: before spaces, before marks that no piece has after
        a letter, and around line ends if no piece has them."""
        marks = {c for p in pieces for c in p if not c.isalnum() and c not in (SPACE, "_", "\n")}
        marks -= {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalnum() and not a.isdecimal()}
        line = "" if any("\n" in p for p in pieces) else "\n"
        own = re.escape("".join(sorted(marks)))
        rest = f"[^ {line}{own}]"
        mark = f"[{own}]" if marks else "(?!)"
        return re.compile(f"(?: +|{mark}|{rest})(?:{rest}+|(?<![^\\W\\d_]){mark}+)*" + f"|{line}+" * bool(line))

    def merge(self, text: str, pieces: dict | None = None) -> list[str]:
        """The pieces of a short string by merging the best neighbours again and again."""
        pieces, parts = self.pieces if pieces is None else pieces, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (found := pieces.get(parts[i] + parts[i + 1])) and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (found := self._pairs.get(key)) is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            a, b = self.string.get(a), self.string[b]
            found = self._pairs[key] = self.merge(b) == [b] if a is None else self.merge(a + b) == [a, b]
        return found

    def _outside(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def viterbi(self, text: str):
        """Yield the ids of a text of any length, piece by piece; those of a committed boundary come at once.

        Short texts of a merge model begin with what is known of their prefixes from other texts.
        """
        ids, pairs, tails, unigram = self.ids, self._pairs, self.tails, self.kind == UNIGRAM
        # node k stands for boundary base + k; token -1: outside the vocabulary
        start, token, score = [0], [-1], [0.0]
        base, n, j = 0, len(text), 0
        known_prefixes = self._prefixes if not unigram and n <= CACHED_LENGTH else None
        if known_prefixes is not None:
            while j < n and (known := known_prefixes.get(text[: j + 1])) is not None:
                j += 1
                token.append(known)
                start.append(j - self.width[known])
        while j < n:
            j += 1
            best, found, value = j - 1, -1, 0.0
            for length in tails[text[j - 3 : j] if j > 3 else text[:j]]:
                i = j - length
                if i < base or (known := ids.get(text[i:j])) is None:
                    continue
                k = i - base
                if unigram:
                    if found < 0 or score[k] + self.score[known] > value:
                        best, found, value = i, known, score[k] + self.score[known]
                else:
                    if (good := pairs.get(token[k] << 20 | known)) is None:
                        good = self._pair(token[k], known)
                    if good:
                        best, found = i, known
                        break
            start.append(best)
            token.append(found)
            if unigram:
                score.append(value if found >= 0 else score[j - 1 - base] + self.unknown_score)
            if known_prefixes is not None:
                if len(known_prefixes) >= self.cache_words * 7 // 4:
                    known_prefixes.clear()
                known_prefixes[text[:j]] = found
            elif len(start) > 2 * self.longest + 16 and j % self.longest == 0:
                common = self._meeting(start, base, j)
                if common > base:
                    yield from self._committed(text, start, token, base, common)
                    # the pair rule reads the committed piece; scores count from it
                    keep = common - base
                    start, token, score = start[keep:], token[keep:], [x - score[keep] for x in score[keep:]]
                    base = common
        yield from self._committed(text, start, token, base, n)

    def _meeting(self, start: list[int], base: int, j: int) -> int:
        """The last boundary through which the backpointer paths of the last `longest` nodes all go."""
        lives = set(range(j - self.longest + 1, j + 1))
        while len(lives) > 1:
            far = max(lives)
            lives.remove(far)
            lives.add(start[far - base])
        return lives.pop()

    def _committed(self, text: str, start: list[int], token: list[int], base: int, end: int) -> list[int]:
        """Ids of the path from base to end."""
        out: list[int] = []
        while end > base:
            k = end - base
            if token[k] >= 0:
                out.append(token[k])
            else:
                out += reversed(self._outside(text[end - 1]))
            end = start[k]
        out.reverse()
        return out

    def _run(self, n: int) -> list[int]:
        """Ids of n spaces that no word takes."""
        if n not in self._runs:
            every = self.runs | {SPACE: self.pieces.get(SPACE, (self.unknown, 0.0))}
            parts = self.merge(SPACE * n, self.runs)
            self._runs[n] = [every[p][0] for p in parts]
        return self._runs[n]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of spaces (at least one) and the word after them, or of any text if the model breaks nowhere."""
        spaces = len(chunk) - len(chunk.lstrip(SPACE))
        if not self.runs or spaces < 2:
            return list(self.viterbi(chunk))
        word = list(self.viterbi(chunk[spaces - 1 :]))
        lone = self.pieces.get(SPACE, (self.unknown, 0.0))[0]
        if spaces == len(chunk) or word[0] == lone:
            return self._run(spaces) + word[1:]
        return self._run(spaces - 1) + word

    def stream(self, text: str):
        """Yield the ids of a text of any length, a window of WINDOW characters at a time.

        Boundaries that no piece spans are met by every path, so the chunks between them are committed as they come; a
        window's last chunk may go on, so the next window begins with it. Longer chunks commit inside (`viterbi`).
        """
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        if not self.breaks:
            yield np.array(self.chunk_ids(text.replace(" ", SPACE)), np.int32)
            return
        begin, size, n = 0, WINDOW, len(text)
        while begin < n:
            end = min(n, begin + size)
            found = self._chunk.findall(text, begin, end)
            if end < n:
                if len(found) < 2:
                    size *= 2
                    continue
                end -= len(found.pop())
            yield np.frombuffer(b"".join(map(self.chunks.__getitem__, found)), np.int32)
            begin, size = end, WINDOW

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Without byte pieces, neighbouring unknown characters are one unknown piece, as the library has it."""
        if not text:
            return np.zeros(0, np.int32)
        parts = list(self.stream(text))
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if not self.bytes:
            lost = ids == self.unknown
            lost[1:] &= lost[:-1].copy()
            lost[:1] = False
            ids = ids[~lost]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text of ids."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw[1:] if self.prefix and raw[:1] == b" " else raw


def encode_decode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Append FIELDS: the ids of each whole text, how many, the CRC-32 of their decoding, and whether that is the text.
    decoded: append the decoded text as well. cache_words: fewer take less memory a worker and more time."""
    fields = [*FIELDS, DECODED] if decoded else FIELDS

    raw = file_bytes(model)
    key, shared = (zlib.crc32(raw), cache_words), docs.sparkSession.sparkContext.broadcast(raw)

    def make():
        cache = worker_cache("pieces")
        own = cache.get(key) or cache.setdefault(key, PieceModel(proto=shared.value, cache_words=cache_words))

        def work(column: pa.Array) -> list[pa.Array]:
            ids, crc, same, back = [], [], [], []
            for text in column.to_pylist():
                text = text or ""
                found = own.encode(text)
                raw = own.decode(found)
                ids.append(found)
                crc.append(zlib.crc32(raw))
                same.append(raw == text.replace(SPACE, " ").encode())
                if decoded:
                    back.append(raw.decode("utf-8", "replace"))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False)))
            return [lists, pa.array(sizes), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())] + ([pa.array(back, pa.string())] if decoded else [])

        return work

    return map_text(docs, text_col, fields, make, keep)
