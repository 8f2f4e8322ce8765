"""Bit streams: raw bits, prefix codes with their serialized tables, Rice, truncated binary and chunked codes.

Streams are coded a stripe at a time, so a long slice is many independent pieces and no group grows beyond its stripe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.operators.entropy import canonical_codes, code_lengths

#: Codes 0..16 are lengths; then short and long runs of zero and repeats of the last length: (symbol, least, extra bits).
ZERO_SHORT, ZERO_LONG, REPEAT_SHORT, REPEAT_LONG = (17, 3, 3), (18, 11, 7), (19, 3, 2), (20, 7, 7)


class BitWriter:
    """Bits low first."""

    def __init__(self):
        self.value, self.size = 0, 0
        self.out = bytearray()

    def put(self, value: int, bits: int) -> int:
        self.value |= value << self.size
        self.size += bits
        while self.size >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.size -= 8
        return bits

    def bytes(self) -> bytes:
        return bytes(self.out) + (bytes([self.value]) if self.size else b"")

    def rice(self, v: int, m: int) -> int:
        q = v >> m
        return self.put((1 << q) - 1, q) + self.put((v & (1 << m) - 1) << 1, m + 1)

    def chunked(self, v: int, chunk: int) -> int:
        total = 0
        while True:
            more = v >> chunk
            total += self.put(v & (1 << chunk) - 1 | (1 << chunk if more else 0), chunk + 1)
            if not more:
                return total
            v = more

    def truncated(self, v: int, n: int) -> int:
        k = n.bit_length() - 1
        short = (1 << k + 1) - n
        return self.put(v, k) if v < short else self.put(v + short >> 1, k) + self.put(v + short & 1, 1)


class BitReader:
    def __init__(self, raw: bytes):
        self.value, self.at = int.from_bytes(raw, "little"), 0

    def get(self, bits: int) -> int:
        out = self.value >> self.at & (1 << bits) - 1
        self.at += bits
        return out

    def rice(self, m: int) -> int:
        q = 0
        while self.get(1):
            q += 1
        return q << m | self.get(m)

    def chunked(self, chunk: int) -> int:
        out = at = 0
        while True:
            part = self.get(chunk + 1)
            out |= (part & (1 << chunk) - 1) << at
            at += chunk
            if not part >> chunk:
                return out

    def truncated(self, n: int) -> int:
        k = n.bit_length() - 1
        short = (1 << k + 1) - n
        v = self.get(k)
        return v if v < short else (v << 1 | self.get(1)) - short


class PrefixCode:
    """A canonical code; its codes are written high bit first."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.codes = [int(f"{c:0{n}b}"[::-1], 2) if n else 0 for c, n in zip(canonical_codes(lengths), lengths, strict=True)]
        self.symbols = {(n, c): i for i, (n, c) in enumerate(zip(lengths, self.codes, strict=True)) if n}

    def put(self, out: BitWriter, symbol: int) -> int:
        return out.put(self.codes[symbol], self.lengths[symbol])

    def get(self, source: BitReader) -> int:
        code = n = 0
        while True:
            code |= source.get(1) << n
            n += 1
            if (n, code) in self.symbols:
                return self.symbols[n, code]
            if n > 32:
                raise ValueError("the bits are no code")


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) of a table's lengths."""
    out, i = [], 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        kinds = (ZERO_LONG, ZERO_SHORT) if lengths[i] == 0 else (REPEAT_LONG, REPEAT_SHORT)
        first = 0 if lengths[i] == 0 else 1
        if first:
            out.append((lengths[i], 0, 0))
        left = n - first
        for symbol, least, bits in kinds:
            while left >= least:
                take = min(left, least + (1 << bits) - 1)
                out.append((symbol, take - least, bits))
                left -= take
        out += [(lengths[i], 0, 0)] * left
        i += n
    return out


def put_table(out: BitWriter, lengths: list[int]) -> None:
    """A code's lengths as runs under a small code of their own, whose lengths (up to 7) come first in three bits each."""
    runs = _runs(lengths)
    freqs = [0] * 21
    for s, _, _ in runs:
        freqs[s] += 1
    own = code_lengths(freqs, 7)
    out.put(len(lengths), 16)
    for n in own:
        out.put(n, 3)
    code = PrefixCode(own)
    for s, extra, bits in runs:
        code.put(out, s)
        out.put(extra, bits)


def get_table(source: BitReader) -> list[int]:
    count = source.get(16)
    code = PrefixCode([source.get(3) for _ in range(21)])
    kinds = {k[0]: k for k in (ZERO_SHORT, ZERO_LONG, REPEAT_SHORT, REPEAT_LONG)}
    out: list[int] = []
    while len(out) < count:
        s = code.get(source)
        if s in kinds:
            _, least, bits = kinds[s]
            out += [0 if s < 19 else out[-1]] * (least + source.get(bits))
        else:
            out.append(s)
    return out


def encode_symbols(symbols: list[int], alphabet: int) -> bytes:
    """Count, table and codes of a stream."""
    out = BitWriter()
    lengths = code_lengths(np.bincount(symbols, minlength=alphabet).tolist(), 16)
    out.put(len(symbols), 32)
    put_table(out, lengths)
    code = PrefixCode(lengths)
    for s in symbols:
        code.put(out, s)
    return out.bytes()


def decode_symbols(raw: bytes) -> list[int]:
    source = BitReader(raw)
    count = source.get(32)
    code = PrefixCode(get_table(source))
    return [code.get(source) for _ in range(count)]


def code_streams(df: DataFrame, slice_col: str, order: str, symbol: str, alphabet: int, stripe: int = 4096) -> DataFrame:
    """(slice, stripe, symbols, size, same): each stripe's symbols coded and read back. order: a number a slice counts up."""
    rows = df.select(slice_col, F.expr(f"{order} div {stripe}").cast("long").alias("stripe"), order, symbol)
    schema = T.StructType([rows.schema[slice_col], T.StructField("stripe", T.LongType()), T.StructField("symbols", T.LongType()), T.StructField("size", T.LongType()), T.StructField("same", T.BooleanType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbols = [int(x) for x in pdf.sort_values(order)[symbol]]
        raw = encode_symbols(symbols, alphabet)
        return pd.DataFrame([(key[0], key[1], len(symbols), len(raw), decode_symbols(raw) == symbols)], columns=schema.names)

    return rows.groupBy(slice_col, "stripe").applyInPandas(run, schema)
