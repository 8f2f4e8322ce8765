"""4x4 block formats: decoders and analytic encoders over arrays of blocks, and their DataFrame forms.

A decoder takes (n, bytes) uint8 and gives (n, 16, 4) uint8 in raster order; an encoder goes the other way. Rows stay
where they are: Arrow batches go through numpy, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.functions.colors import perceptual_distance_wide

#: Intensity modifiers of the ETC1 format, from the smallest to the largest table.
ETC1_MODIFIERS = np.array(
    [[-8, -2, 2, 8], [-17, -5, 5, 17], [-29, -9, 9, 29], [-42, -13, 13, 42], [-60, -18, 18, 60], [-80, -24, 24, 80], [-106, -33, 33, 106], [-183, -47, 47, 183]]
)
#: Modifiers of the EAC alpha format.
EAC_MODIFIERS = np.array(
    [
        [-3, -6, -9, -15, 2, 5, 8, 14], [-3, -7, -10, -13, 2, 6, 9, 12], [-2, -5, -8, -13, 1, 4, 7, 12], [-2, -4, -6, -13, 1, 3, 5, 12],
        [-3, -6, -8, -12, 2, 5, 7, 11], [-3, -7, -9, -11, 2, 6, 8, 10], [-4, -7, -8, -11, 3, 6, 7, 10], [-3, -5, -8, -11, 2, 4, 7, 10],
        [-2, -6, -8, -10, 1, 5, 7, 9], [-2, -5, -8, -10, 1, 4, 7, 9], [-2, -4, -8, -10, 1, 3, 7, 9], [-2, -5, -7, -10, 1, 4, 6, 9],
        [-3, -4, -7, -10, 2, 3, 6, 9], [-1, -2, -3, -10, 0, 1, 2, 9], [-4, -6, -8, -9, 3, 5, 7, 8], [-3, -5, -7, -9, 2, 4, 6, 8],
    ]
)


def _word(b: np.ndarray, first: int, count: int, big: bool = False) -> np.ndarray:
    """An unsigned number of `count` bytes of each block."""
    at = range(count) if not big else range(count - 1, -1, -1)
    return sum(b[:, first + k].astype(np.uint64) << np.uint64(8 * i) for i, k in enumerate(at))


def _bits(v: np.ndarray, shift: int, width: int) -> np.ndarray:
    return ((v >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _widen(v: np.ndarray, width: int) -> np.ndarray:
    """A value of `width` bits as 8 bits, by repeating its high bits."""
    return (v << (8 - width)) | (v >> (2 * width - 8))


def _pick(colors: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    return np.take_along_axis(colors, selectors[:, :, None], axis=1)


def _rgb565(c: np.ndarray) -> np.ndarray:
    return np.stack([_widen(_bits(c, 11, 5), 5), _widen(_bits(c, 5, 6), 6), _widen(_bits(c, 0, 5), 5)], axis=1)


def decode_bc1(b: np.ndarray, rounding: str = "ideal", always_four: bool = False) -> np.ndarray:
    """Two 565 colors and 2-bit selectors; where the first is not the larger, the third is the mean and the fourth clear.

    rounding: `ideal` thirds, or the fixed-point thirds and halves of one hardware family (`43/64`).
    """
    low, high = _word(b, 0, 2), _word(b, 2, 2)
    c0, c1 = _rgb565(low), _rgb565(high)
    third = (lambda x, y: (2 * x + y) // 3) if rounding == "ideal" else (lambda x, y: (x * 43 + y * 21 + 32) >> 6)
    half = (lambda x, y: (x + y) // 2) if rounding == "ideal" else (lambda x, y: (x + y + 1) >> 1)
    four = ((low > high) | always_four)[:, None]
    colors = np.full((len(b), 4, 4), 255, np.int64)
    colors[:, 0, :3], colors[:, 1, :3] = c0, c1
    colors[:, 2, :3] = np.where(four, third(c0, c1), half(c0, c1))
    colors[:, 3, :3] = np.where(four, third(c1, c0), 0)
    colors[:, 3, 3] = np.where(four[:, 0], 255, 0)
    bits = _word(b, 4, 4)
    return _pick(colors, np.stack([_bits(bits, 2 * i, 2) for i in range(16)], axis=1)).astype(np.uint8)


def decode_bc4_values(b: np.ndarray) -> np.ndarray:
    """(n, 16): two bytes and 3-bit selectors over 8 levels, or over 6 with 0 and 255."""
    a0, a1 = b[:, 0].astype(np.int64), b[:, 1].astype(np.int64)
    levels = np.zeros((len(b), 8), np.int64)
    levels[:, 0], levels[:, 1] = a0, a1
    for k in range(1, 7):
        levels[:, k + 1] = ((7 - k) * a0 + k * a1) // 7
    six = a0 <= a1
    for k in range(1, 5):
        levels[six, k + 1] = ((5 - k) * a0[six] + k * a1[six]) // 5
    levels[six, 6], levels[six, 7] = 0, 255
    bits = _word(b, 2, 6)
    return np.take_along_axis(levels, np.stack([_bits(bits, 3 * i, 3) for i in range(16)], axis=1), axis=1).astype(np.uint8)


def _gray(n: int) -> np.ndarray:
    out = np.zeros((n, 16, 4), np.uint8)
    out[:, :, 3] = 255
    return out


def decode_bc3(b: np.ndarray) -> np.ndarray:
    out = decode_bc1(b[:, 8:], always_four=True)
    out[:, :, 3] = decode_bc4_values(b)
    return out


def decode_bc4(b: np.ndarray) -> np.ndarray:
    out = _gray(len(b))
    out[:, :, 0] = decode_bc4_values(b)
    return out


def decode_bc5(b: np.ndarray) -> np.ndarray:
    out = _gray(len(b))
    out[:, :, 0], out[:, :, 1] = decode_bc4_values(b), decode_bc4_values(b[:, 8:])
    return out


def decode_atc(b: np.ndarray) -> np.ndarray:
    """A 555 and a 565 color; between them three eighths, or a darkened first color and black."""
    first, second = _word(b, 0, 2), _word(b, 2, 2)
    a = np.stack([_widen(_bits(first, s, 5), 5) for s in (10, 5, 0)], axis=1)
    d = _rgb565(second)
    dark = (_bits(first, 15, 1) == 1)[:, None]
    colors = np.full((len(b), 4, 4), 255, np.int64)
    colors[:, 0, :3] = np.where(dark, 0, a)
    colors[:, 1, :3] = np.where(dark, np.maximum(0, a - (d >> 2)), (a * 5 + d * 3) >> 3)
    colors[:, 2, :3] = np.where(dark, a, (a * 3 + d * 5) >> 3)
    colors[:, 3, :3] = d
    bits = _word(b, 4, 4)
    return _pick(colors, np.stack([_bits(bits, 2 * i, 2) for i in range(16)], axis=1)).astype(np.uint8)


def decode_etc1(b: np.ndarray) -> np.ndarray:
    """Two half blocks, each a base color and a table of modifiers; base colors are separate (444) or the second is a
    difference (555 and three signed bits)."""
    head = _word(b, 0, 4, big=True)
    differential, flip = _bits(head, 1, 1) == 1, _bits(head, 0, 1) == 1
    base = np.zeros((len(b), 2, 3), np.int64)
    for c, shift in enumerate((24, 16, 8)):
        five, delta = _bits(head, shift + 3, 5), _bits(head, shift, 3)
        delta = np.where(delta > 3, delta - 8, delta)
        first, second = _bits(head, shift + 4, 4), _bits(head, shift, 4)
        base[:, 0, c] = np.where(differential, _widen(five, 5), first * 17)
        base[:, 1, c] = np.where(differential, _widen(np.clip(five + delta, 0, 31), 5), second * 17)
    tables = np.stack([_bits(head, 5, 3), _bits(head, 2, 3)], axis=1)
    high, low = _word(b, 4, 2, big=True), _word(b, 6, 2, big=True)
    out = np.full((len(b), 16, 4), 255, np.uint8)
    # a selector's two bits: sign (set: negative) and size (set: large)
    order = np.array([2, 3, 1, 0])
    for x in range(4):
        for y in range(4):
            selector = order[_bits(high, x * 4 + y, 1) * 2 + _bits(low, x * 4 + y, 1)]
            side = np.where(flip, y // 2, x // 2)
            rows = np.arange(len(b))
            shift = ETC1_MODIFIERS[tables[rows, side], selector]
            out[:, y * 4 + x, :3] = np.clip(base[rows, side] + shift[:, None], 0, 255)
    return out


def _eac_selectors(b: np.ndarray) -> np.ndarray:
    """(n, 16) in raster order; the format stores columns, high bits first."""
    bits = _word(b, 2, 6, big=True)
    return np.stack([_bits(bits, 45 - 3 * (y + 4 * x), 3) for y in range(4) for x in range(4)], axis=1)


def decode_eac_a8_values(b: np.ndarray) -> np.ndarray:
    base, mul, table = b[:, 0].astype(np.int64), b[:, 1].astype(np.int64) >> 4, b[:, 1] & 15
    steps = np.take_along_axis(EAC_MODIFIERS[table], _eac_selectors(b), axis=1)
    return np.clip(base[:, None] + steps * mul[:, None], 0, 255).astype(np.uint8)


def decode_eac_a8(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 16, 4), np.uint8)
    out[:, :, 3] = decode_eac_a8_values(b)
    return out


def decode_eac_r11(b: np.ndarray) -> np.ndarray:
    """Eleven bits a texel, given as 8 with rounding."""
    base, mul, table = b[:, 0].astype(np.int64) * 8 + 4, b[:, 1].astype(np.int64) >> 4, b[:, 1] & 15
    scale = np.where(mul > 0, mul * 8, 1)
    v = np.clip(base[:, None] + np.take_along_axis(EAC_MODIFIERS[table], _eac_selectors(b), axis=1) * scale[:, None], 0, 2047)
    out = _gray(len(b))
    out[:, :, 0] = (v * 255 + 1023) // 2047
    return out


def decode_etc2_rgba(b: np.ndarray) -> np.ndarray:
    out = decode_etc1(b[:, 8:])
    out[:, :, 3] = decode_eac_a8_values(b)
    return out


DECODERS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "BC1": (8, decode_bc1),
    "BC1_43_64": (8, lambda b: decode_bc1(b, "43/64")),
    "BC3": (16, decode_bc3),
    "BC4": (8, decode_bc4),
    "BC5": (16, decode_bc5),
    "ATC": (8, decode_atc),
    "ETC1": (8, decode_etc1),
    "EAC_A8": (8, decode_eac_a8),
    "EAC_R11": (8, decode_eac_r11),
    "ETC2_RGBA": (16, decode_etc2_rgba),
}


def _pack565(c: np.ndarray) -> np.ndarray:
    r, g, b = ((c[:, i] * m + 127) // 255 for i, m in enumerate((31, 63, 31)))
    return (r << 11 | g << 5 | b).astype(np.int64)


def encode_bc1(t: np.ndarray) -> np.ndarray:
    """Endpoints at the ends of the texels' principal axis, pulled in by a sixteenth; nearest selectors."""
    rgb = t[:, :, :3].astype(np.float64)
    mean = rgb.mean(axis=1, keepdims=True)
    d = rgb - mean
    cov = np.einsum("nti,ntj->nij", d, d)
    axis = np.ones((len(t), 3))
    for _ in range(8):
        axis = np.einsum("nij,nj->ni", cov, axis)
        size = np.linalg.norm(axis, axis=1, keepdims=True)
        axis = np.where(size > 1e-9, axis / np.maximum(size, 1e-9), 1 / np.sqrt(3))
    along = np.einsum("nti,ni->nt", d, axis)
    low, high = along.min(axis=1), along.max(axis=1)
    inset = (high - low) / 16
    ends = [np.clip(np.floor(mean[:, 0] + axis * v[:, None] + 0.5), 0, 255).astype(np.int64) for v in (high - inset, low + inset)]
    a, b = _pack565(ends[0]), _pack565(ends[1])
    a, b = np.maximum(a, b), np.minimum(a, b)
    out = np.zeros((len(t), 8), np.uint8)
    for k, v in enumerate((a, b)):
        out[:, 2 * k], out[:, 2 * k + 1] = v & 255, v >> 8
    colors = np.zeros((len(t), 4, 3), np.int64)
    c0, c1 = _rgb565(a.astype(np.uint64)), _rgb565(b.astype(np.uint64))
    equal = (a == b)[:, None]
    colors[:, 0], colors[:, 1] = c0, c1
    colors[:, 2] = np.where(equal, (c0 + c1) // 2, (2 * c0 + c1) // 3)
    colors[:, 3] = np.where(equal, c0, (2 * c1 + c0) // 3)
    selectors = ((t[:, :, None, :3].astype(np.int64) - colors[:, None]) ** 2).sum(axis=3)
    selectors[:, :, 3] = np.where(equal, 1 << 40, selectors[:, :, 3])
    selectors = selectors.argmin(axis=2)
    for i in range(16):
        out[:, 4 + i // 4] |= (selectors[:, i] << 2 * (i % 4)).astype(np.uint8)
    return out


def encode_bc4(v: np.ndarray) -> np.ndarray:
    """Eight levels from the largest to the smallest value; nearest selectors."""
    v = v.astype(np.int64)
    high, low = v.max(axis=1), v.min(axis=1)
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = high, low
    levels = np.stack([high, low, *[((7 - k) * high + k * low) // 7 for k in range(1, 7)]], axis=1)
    selectors = np.where((high == low)[:, None], 0, np.abs(v[:, :, None] - levels[:, None]).argmin(axis=2))
    bits = sum(selectors[:, i].astype(np.uint64) << np.uint64(3 * i) for i in range(16))
    for k in range(6):
        out[:, 2 + k] = (bits >> np.uint64(8 * k)).astype(np.uint8)
    return out


def encode_etc1_solid(t: np.ndarray) -> np.ndarray:
    """Blocks of one color, the texels' mean: the table and selector nearest to it over all tables, 555 base."""
    mean = np.floor(t[:, :, :3].astype(np.float64).mean(axis=1) + 0.5).astype(np.int64)
    best = np.full(len(t), 1 << 40)
    head, sel = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for table in range(8):
        for s in range(4):
            m = ETC1_MODIFIERS[table, s]
            five = np.clip((np.clip(mean - m, 0, 255) * 31 + 127) // 255, 0, 31)
            got = np.clip(_widen(five, 5) + m, 0, 255)
            error = ((got - mean) ** 2).sum(axis=1)
            better = error < best
            best = np.where(better, error, best)
            code = five[:, 0] << 27 | five[:, 1] << 19 | five[:, 2] << 11 | table << 5 | table << 2 | 2
            head, sel = np.where(better, code, head), np.where(better, s, sel)
    out = np.zeros((len(t), 8), np.uint8)
    for k in range(4):
        out[:, k] = head >> (24 - 8 * k) & 255
    stored = np.array([3, 2, 0, 1])[sel]
    out[:, 4] = out[:, 5] = np.where(stored & 2, 255, 0)
    out[:, 6] = out[:, 7] = np.where(stored & 1, 255, 0)
    return out


def encode_eac_a8(v: np.ndarray) -> np.ndarray:
    """Alpha blocks: of every table, the multipliers about the one that spans the texels; the base starts at three places about
    their middle and moves by the mean of what is left. The least squared error wins, the first of equal ones."""
    v = v.astype(np.int64)
    high, low = v.max(axis=1), v.min(axis=1)
    best = np.full(len(v), 1 << 40)
    found = np.zeros((3, len(v)), np.int64)
    chosen = np.zeros(v.shape, np.int64)
    for table, steps in enumerate(EAC_MODIFIERS):
        span, ends = steps.max() - steps.min(), steps.max() + steps.min()
        for near in (-2, -1, 0, 1):
            mul = np.clip((2 * (high - low) + span) // (2 * span) + near, 1, 15)
            for start in (-2, 0, 2):
                base = np.clip((high + low - ends * mul + 1) // 2 + start * mul, 0, 255)
                for _ in range(3):
                    values = np.clip(base[:, None] + steps * mul[:, None], 0, 255)
                    selectors = np.abs(v[:, :, None] - values[:, None]).argmin(axis=2)
                    left = v - np.take_along_axis(values, selectors, axis=1)
                    error = (left**2).sum(axis=1)
                    better = error < best
                    best = np.where(better, error, best)
                    found = np.where(better, np.stack([base, mul, np.full(len(v), table)]), found)
                    chosen = np.where(better[:, None], selectors, chosen)
                    base = np.clip(base + (2 * left.sum(axis=1) + 16) // 32, 0, 255)
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = found[0], found[1] << 4 | found[2]
    bits = sum(chosen[:, x + 4 * y].astype(np.uint64) << np.uint64(45 - 3 * (y + 4 * x)) for y in range(4) for x in range(4))
    for k in range(6):
        out[:, 2 + k] = (bits >> np.uint64(40 - 8 * k)).astype(np.uint8)
    return out


ENCODERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "BC1": encode_bc1,
    "BC3": lambda t: np.concatenate([encode_bc4(t[:, :, 3]), encode_bc1(t)], axis=1),
    "BC4": lambda t: encode_bc4(t[:, :, 0]),
    "BC5": lambda t: np.concatenate([encode_bc4(t[:, :, 0]), encode_bc4(t[:, :, 1])], axis=1),
    "ETC1_SOLID": encode_etc1_solid,
    "EAC_A8": lambda t: encode_eac_a8(t[:, :, 3]),
}


def _texel_array(column: pa.Array) -> np.ndarray:
    """(n, 16, 4) from a list column of 64 channel values, texel by texel."""
    return np.asarray(column.flatten(), np.int64).astype(np.uint8).reshape(len(column), 16, 4)


def encode_blocks(df: DataFrame, texels: str, fmt: str, name: str = "block") -> DataFrame:
    """Append a block's bytes. texels: array of 64 numbers 0..255, r g b a of each texel in raster order."""
    encoder = ENCODERS[fmt]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    at = df.columns.index(texels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = encoder(_texel_array(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in raw], pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_blocks(df: DataFrame, block: str, fmt: str, name: str = "texels") -> DataFrame:
    """Append a block's 64 channel values."""
    size, decoder = DECODERS[fmt]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(-1, size)
            flat = decoder(raw).reshape(-1).astype(np.int32)
            offsets = np.arange(0, 64 * (len(raw) + 1), 64, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return df.mapInArrow(run, schema)


def block_error(df: DataFrame, block: str, texels: str, fmt: str, perceptual: bool = False, half: int | None = None, name: str = "error") -> DataFrame:
    """Append the color error of a block against its texels (64 channel values): summed squared differences, or perceptual
    distances. half: of ETC1 blocks only the first (0) or second (1) of the two halves that the block's flip bit gives."""
    if half is not None and fmt != "ETC1":
        raise ValueError("only ETC1 blocks have halves")
    rows = decode_blocks(df, block, fmt, "__decoded")
    flip = F.conv(F.hex(F.substring(block, 4, 1)), 16, 10).cast("int") % 2 == 1

    def distance(i: Column) -> Column:
        d = tuple(F.get(F.col(texels), i * 4 + c) - F.get(F.col("__decoded"), i * 4 + c) for c in range(3))
        return (perceptual_distance_wide(d) if perceptual else d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("long")

    def inside(i: Column) -> Column:
        return F.lit(True) if half is None else F.when(flip, F.floor(i / 8) == half).otherwise(F.floor(i % 4 / 2) == half)

    every = F.sequence(F.lit(0), F.lit(15))
    return rows.withColumn(name, F.aggregate(every, F.lit(0).cast("long"), lambda s, i: s + F.when(inside(i), distance(i)).otherwise(0))).drop("__decoded")


#: Bytes of texts that `decode_every` decodes at once.
DECODE_BYTES = 1 << 20


def decode_every(df: DataFrame, key: str, data: str, formats: list[str] | None = None) -> DataFrame:
    """(key, fmt, blocks, mean): a binary column cut into the blocks of each format and decoded, in one pass over the rows.

    The last block is filled up with zeros; null and empty values have no blocks and no row.
    """
    formats = list(formats or DECODERS)
    source = df.where(F.octet_length(data) > 0).select(key, data)
    schema = T.StructType([source.schema[key], T.StructField("fmt", T.StringType()), T.StructField("blocks", T.LongType()), T.StructField("mean", T.DoubleType())])

    def some(keys: pa.Array, values: list[bytes]) -> Iterator[pa.RecordBatch]:
        for fmt in formats:
            size, decoder = DECODERS[fmt]
            counts = np.array([-(-len(x) // size) for x in values])
            raw = np.frombuffer(b"".join(x.ljust(int(n) * size, b"\0") for x, n in zip(values, counts, strict=True)), np.uint8).reshape(-1, size)
            sums = decoder(raw).reshape(len(raw), -1).sum(axis=1, dtype=np.int64)
            total = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(counts)[:-1]]))
            yield pa.RecordBatch.from_arrays([keys, pa.array([fmt] * len(values)), pa.array(counts, pa.int64()), pa.array(total / (64.0 * counts))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, begin, held = batch.column(1).to_pylist(), 0, 0
            for i, value in enumerate(values):
                held += len(value)
                if held >= DECODE_BYTES or i + 1 == len(values):
                    yield from some(batch.column(0).slice(begin, i + 1 - begin), values[begin : i + 1])
                    begin, held = i + 1, 0

    return source.mapInArrow(run, schema)
