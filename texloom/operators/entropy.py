"""Code tables, reordering and byte streams.

Histograms are aggregated by the engine; only tables of a bounded alphabet (MOST_SYMBOLS) reach one task.
"""

from __future__ import annotations

import binascii
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SYMBOLS = 1 << 14
#: Codes of a tour: all that 16 bits can have.
MOST_TOUR_CODES = 1 << 16


def code_lengths(freqs: list[int], most: int = 16) -> list[int]:
    """Lengths of a prefix code of least total size with no code longer than `most` bits.

    Package-merge: `most` rounds, each pairing the cheapest packages and adding the single symbols again; a symbol's
    length is the number of times it is in the 2n - 2 cheapest packages. One symbol alone has length 1.
    """
    used = [i for i, f in enumerate(freqs) if f > 0]
    out = [0] * len(freqs)
    if len(used) > 1 << most:
        raise ValueError("more symbols than codes")
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    single = sorted((freqs[i], (i,)) for i in used)
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        packages = list(heapq.merge(single, [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[::2], packages[1::2], strict=False)]))
    for _, members in packages[: 2 * len(used) - 2]:
        for i in members:
            out[i] += 1
    return out


def canonical_codes(lengths: list[int]) -> list[int]:
    """Codes by length and then by symbol, as numbers."""
    codes, code, last = [0] * len(lengths), 0, 0
    for length, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= length - last
        codes[i], last = code, length
        code += 1
    return codes


def code_table(rows: DataFrame, keys: list[str], symbol: str, most: int) -> DataFrame:
    """(keys, symbol, freq, length, code) of each group's symbols."""
    counted = rows.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("freq"))
    schema = T.StructType([*counted.schema.fields, T.StructField("length", T.IntegerType()), T.StructField("code", T.LongType())])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_SYMBOLS:
            raise ValueError(f"more than {MOST_SYMBOLS} symbols in a table")
        pdf = pdf.sort_values(symbol).reset_index(drop=True)
        lengths = code_lengths(pdf["freq"].tolist(), most)
        return pdf.assign(length=np.array(lengths, np.int32), code=np.array(canonical_codes(lengths), np.int64))

    return counted.groupBy(*keys).applyInPandas(build, schema)


#: Pairs of a palette that reach the driver.
MOST_PAIRS = MOST_SYMBOLS * 64


def reorder_palette(pairs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol, place) from counted pairs (a, b, n) and all symbols (a column; those in pairs if not given).

    The two-ended greedy order of palettes: begin with the most frequent pair, then put the symbol with the most pairs to
    those placed on the end whose neighbourhood it is nearer to. Symbols without a neighbour come last, in their order.
    More than MOST_PAIRS pairs or MOST_SYMBOLS symbols raise.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["a"].dataType
    table = pairs.where("a <> b").limit(MOST_PAIRS + 1).collect()
    known = pairs.selectExpr("explode(array(a, b)) as s") if symbols is None else symbols.select(F.col(symbols.columns[0]).alias("s"))
    found = [r[0] for r in known.where("s is not null").distinct().limit(MOST_SYMBOLS + 1).collect()]
    if len(table) > MOST_PAIRS or len(found) > MOST_SYMBOLS:
        raise ValueError(f"a palette has at most {MOST_SYMBOLS} symbols and {MOST_PAIRS} pairs")
    n: dict = {(r["a"], r["b"]): r["n"] for r in table}
    todo = sorted({s for pair in n for s in pair} | set(found))
    placed: list = []
    if n:
        placed = list(max(sorted(n), key=lambda p: n[p]))
        todo = [s for s in todo if s not in placed]
    toward = {s: sum(n.get((s, p), 0) for p in placed) for s in todo}
    while todo:
        best = max(todo, key=lambda s: toward[s])
        todo.remove(best)
        half = len(placed) - 1
        lean = sum(n.get((best, p), 0) * (half - 2 * i) for i, p in enumerate(placed))
        placed = [best, *placed] if lean > 0 else [*placed, best]
        for s in todo:
            toward[s] += n.get((s, best), 0)
    schema = T.StructType([T.StructField("symbol", kind), T.StructField("place", T.IntegerType())])
    return spark.createDataFrame([(s, i) for i, s in enumerate(placed)], schema)


def hamming_tour(codes: DataFrame, column: str) -> DataFrame:
    """(code, place): from the smallest code always to the nearest code left, by differing bits; ties to the smaller. For
    codebooks of up to MOST_TOUR_CODES codes."""
    found = [r[0] for r in codes.select(column).orderBy(column).limit(MOST_TOUR_CODES + 1).collect()]
    if len(found) > MOST_TOUR_CODES:
        raise ValueError(f"a codebook has at most {MOST_TOUR_CODES} codes")
    left = np.array(found, np.int64)
    tour = []
    at = 0
    while len(left):
        code = int(left[at])
        tour.append((code, len(tour)))
        left = np.delete(left, at)
        at = int(np.bitwise_count(left ^ code).argmin()) if len(left) else 0
    return codes.sparkSession.createDataFrame(tour, T.StructType([T.StructField(column, T.LongType()), T.StructField("place", T.IntegerType())]))


def _map_bytes(df: DataFrame, key: str, data: str, fields: list[T.StructField], work) -> DataFrame:
    """(key, fields) from a binary column, a row at a time within Arrow batches."""
    source = df.select(key, data)
    schema = T.StructType([source.schema[key], *fields])
    kinds = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.IntegerType: pa.int32(), T.StringType: pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(x or b"") for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kinds[type(f.dataType)]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def deflate_sizes(df: DataFrame, key: str, data: str, level: int = 6) -> DataFrame:
    """(key, raw, packed, same): sizes before and after DEFLATE, and whether inflating gives the bytes back."""
    fields = [T.StructField("raw", T.LongType()), T.StructField("packed", T.LongType()), T.StructField("same", T.BooleanType())]

    def work(raw: bytes) -> tuple:
        packed = zlib.compress(raw, level)
        return len(raw), len(packed), zlib.decompress(packed) == raw

    return _map_bytes(df, key, data, fields, work)


def crc16_of(raw: bytes, start: int = 0) -> int:
    """CRC with polynomial 0x1021, high bit first, inverted before and after."""
    return binascii.crc_hqx(raw, ~start & 0xFFFF) ^ 0xFFFF


def crc16(df: DataFrame, key: str, data: str) -> DataFrame:
    return _map_bytes(df, key, data, [T.StructField("crc", T.IntegerType())], lambda raw: (crc16_of(raw),))


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def pack_blobs(blobs: dict[int, bytes]) -> bytes:
    """Tagged blobs behind a directory of (tag, size, stored size): Zstandard where that saves a 400th at least."""
    codec = pa.Codec("zstd")
    head, body = varint(len(blobs)), b""
    for tag, raw in sorted(blobs.items()):
        packed = codec.compress(raw, asbytes=True) if raw else b""
        stored = packed if raw and len(raw) - len(packed) >= len(raw) / 400 else raw
        head += varint(tag) + varint(len(raw)) + varint(len(stored))
        body += stored
    return head + body


def unpack_blobs(raw: bytes) -> dict[int, bytes]:
    codec = pa.Codec("zstd")
    count, at = read_varint(raw, 0)
    entries = []
    for _ in range(count):
        tag, at = read_varint(raw, at)
        size, at = read_varint(raw, at)
        stored, at = read_varint(raw, at)
        entries.append((tag, size, stored))
    out = {}
    for tag, size, stored in entries:
        part = raw[at : at + stored]
        out[tag] = part if stored == size else codec.decompress(part, size, asbytes=True)
        at += stored
    return out


def blob_round_trip(df: DataFrame, key: str, label: str, data: str) -> DataFrame:
    """(key, label, size, same): each batch's columns as blobs of one container, read back."""
    source = df.select(key, label, data)
    schema = T.StructType([source.schema[key], source.schema[label], T.StructField("size", T.LongType()), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(2).to_pylist()]
            names = [(x or "").encode() for x in batch.column(1).to_pylist()]
            sizes = b"".join(varint(len(x)) for x in raw) , b"".join(varint(len(x)) for x in names)
            back = unpack_blobs(pack_blobs({1: sizes[0], 2: b"".join(raw), 3: sizes[1], 4: b"".join(names)}))
            found = []
            for sizes_tag, body_tag in ((1, 2), (3, 4)):
                at = place = 0
                part = []
                while at < len(back[sizes_tag]):
                    n, at = read_varint(back[sizes_tag], at)
                    part.append(back[body_tag][place : place + n])
                    place += n
                found.append(part)
            same = [a == b for a, b in zip(raw, found[0], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in found[1]]), pa.array([len(x) for x in found[0]], pa.int64()), pa.array(same, pa.bool_())], names=schema.names)

    return source.mapInArrow(run, schema)
