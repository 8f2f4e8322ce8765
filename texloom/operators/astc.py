"""The adaptive scalable block format, low dynamic range, by its public specification.

Bounded integer sequences, block modes, the partition hash, endpoint modes and weight grids are rules, so no table is needed
beyond the endpoint and weight ranges. HDR endpoint modes and reserved encodings give None.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (trits, quints, bits) of the 21 sequence ranges, and the 12 that weights use by their three range bits.
RANGES = (
    (0, 0, 1), (1, 0, 0), (0, 0, 2), (0, 1, 0), (1, 0, 1), (0, 0, 3), (0, 1, 1), (1, 0, 2), (0, 0, 4), (0, 1, 2), (1, 0, 3),
    (0, 0, 5), (0, 1, 3), (1, 0, 4), (0, 0, 6), (0, 1, 4), (1, 0, 5), (0, 0, 7), (0, 1, 5), (1, 0, 6), (0, 0, 8),
)
LEVELS = tuple((3 if t else 5 if q else 1) << b for t, q, b in RANGES)


def sequence_bits(count: int, kind: int) -> int:
    trits, quints, bits = RANGES[kind]
    return count * bits + (-(-8 * count // 5) if trits else -(-7 * count // 3) if quints else 0)


def _trits(v: int) -> tuple[int, ...]:
    """Five base-3 digits of a packed byte."""
    if v >> 2 & 7 == 7:
        c, t3, t4 = (v >> 5 & 7) << 2 | v & 3, 2, 2
    else:
        c = v & 31
        t3, t4 = (v >> 7 & 1, 2) if v >> 5 & 3 == 3 else (v >> 5 & 3, v >> 7 & 1)
    if c & 3 == 3:
        return (c >> 3 & 1) << 1 | (c >> 2 & 1 & ~(c >> 3)), c >> 4 & 1, 2, t3, t4
    if c >> 2 & 3 == 3:
        return c & 3, 2, 2, t3, t4
    return (c >> 1 & 1) << 1 | (c & 1 & ~(c >> 1)), c >> 2 & 3, c >> 4 & 1, t3, t4


def _quints(v: int) -> tuple[int, ...]:
    """Three base-5 digits of seven packed bits."""
    if v >> 1 & 3 == 3 and v >> 5 & 3 == 0:
        low = ~v & 1
        return 4, 4, (v & 1) << 2 | (v >> 4 & low) << 1 | (v >> 3 & low)
    if v >> 1 & 3 == 3:
        q2, c = 4, (v >> 3 & 3) << 3 | (~(v >> 5) & 3) << 1 | v & 1
    else:
        q2, c = v >> 5 & 3, v & 31
    return (c >> 3 & 3, 4, q2) if c & 7 == 5 else (c & 7, c >> 3 & 3, q2)


#: How the packed digits are spread between the values' own bits.
_SPREAD = {5: (2, 2, 1, 2, 1), 3: (3, 2, 2)}
_DIGITS = {5: [_trits(v) for v in range(256)], 3: [_quints(v) for v in range(128)]}
_PACKED = {n: {d: v for v, d in reversed(list(enumerate(table)))} for n, table in _DIGITS.items()}


def decode_sequence(bits: int, count: int, kind: int) -> list[int]:
    """Values of a bounded integer sequence from its bits, low first; bits beyond its length count as zero."""
    trits, quints, low = RANGES[kind]
    bits &= (1 << sequence_bits(count, kind)) - 1
    if not trits and not quints:
        return [bits >> low * i & (1 << low) - 1 for i in range(count)]
    n = 5 if trits else 3
    out: list[int] = []
    while len(out) < count:
        packed = at = 0
        own = []
        for width in _SPREAD[n]:
            own.append(bits & (1 << low) - 1)
            bits >>= low
            packed |= (bits & (1 << width) - 1) << at
            bits >>= width
            at += width
        out += [d << low | o for d, o in zip(_DIGITS[n][packed], own, strict=True)]
    return out[:count]


def encode_sequence(values: list[int], kind: int) -> int:
    trits, quints, low = RANGES[kind]
    if not trits and not quints:
        return sum(v << low * i for i, v in enumerate(values))
    n, bits, at = 5 if trits else 3, 0, 0
    for i in range(0, len(values), n):
        part = values[i : i + n] + [0] * (n - len(values[i : i + n]))
        packed = _PACKED[n][tuple(v >> low for v in part)]
        for v, width in zip(part, _SPREAD[n], strict=True):
            bits |= (v & (1 << low) - 1) << at
            at += low
            bits |= (packed & (1 << width) - 1) << at
            packed >>= width
            at += width
    return bits & (1 << sequence_bits(len(values), kind)) - 1


#: Multipliers of the digit and places of the value's bits (from b up, highest place first) when levels are spread.
_COLOR_SPREAD = {3: ((204, ""), (93, "b000b0bb0"), (44, "cb000cbcb"), (22, "dcb000dcb"), (11, "edcb000ed"), (5, "fedcb000f")), 5: ((113, ""), (54, "b0000bb00"), (26, "cb0000cbc"), (13, "dcb0000dc"), (6, "edcb0000e"))}
_WEIGHT_SPREAD = {3: ((50, ""), (23, "b000b0b"), (11, "cb000cb")), 5: ((28, ""), (13, "b0000b0"))}


def _spread(value: int, kind: int, width: int, table: dict) -> int:
    trits, quints, low = RANGES[kind]
    if not trits and not quints:
        out = got = 0
        while got < width:
            out, got = out << low | value, got + low
        return out >> got - width
    factor, places = table[3 if trits else 5][low - 1]
    digit, own = value >> low, value & (1 << low) - 1
    b = 0
    for c in places:
        b = b << 1 | (own >> "abcdef".index(c) & 1 if c != "0" else 0)
    mask = (1 << width + 1) - 1 if own & 1 else 0
    t = digit * factor + b ^ mask
    return mask & 1 << width - 1 | t >> 2


def color_value(value: int, kind: int) -> int:
    """A stored endpoint value as 8 bits."""
    return _spread(value, kind, 8, _COLOR_SPREAD)


def weight_value(value: int, kind: int) -> int:
    """A stored weight as 0..64."""
    trits, quints, low = RANGES[kind]
    if low == 0:
        w = ((0, 32, 63) if trits else (0, 16, 32, 47, 63))[value]
    else:
        w = _spread(value, kind, 6, _WEIGHT_SPREAD)
    return w + (w > 32)


def _hash(p: int) -> int:
    m = 0xFFFFFFFF
    p ^= p >> 15
    for shift in (-17, 7, 4):
        p = (p + (p << shift if shift > 0 else -(p << -shift))) & m
    p ^= p >> 5
    p = (p + (p << 16)) & m
    p ^= p >> 7
    p ^= p >> 3
    p = (p ^ p << 6) & m
    return p ^ p >> 17


def partition_of(seed: int, x: int, y: int, parts: int, small: bool) -> int:
    """Which of the partitions a texel belongs to, by the format's hash."""
    if parts == 1:
        return 0
    if small:
        x, y = 2 * x, 2 * y
    seed += (parts - 1) * 1024
    r = _hash(seed)
    s = [(r >> k & 15) ** 2 for k in (0, 4, 8, 12, 16, 20, 24, 28)]
    first, second = (4 if seed & 2 else 5), (6 if parts == 3 else 5)
    shifts = (first, second) if seed & 1 else (second, first)
    s = [v >> shifts[i % 2] for i, v in enumerate(s)]
    scores = [(s[2 * i] * x + s[2 * i + 1] * y + (r >> 14 - 4 * i)) & 63 for i in range(parts)]
    return scores.index(max(scores))


def _block_mode(bits: int) -> tuple[int, int, int, bool] | None:
    """Weight grid width and height, weight range, two planes; None where reserved."""
    mode = bits & 0x7FF
    a, b = mode >> 5 & 3, mode >> 7 & 3
    high, dual = mode >> 9 & 1, bool(mode >> 10 & 1)
    if mode & 3:
        r = mode >> 4 & 1 | (mode & 3) << 1
        kind = mode >> 2 & 3
        if kind < 3:
            w, h = ((b + 4, a + 2), (b + 8, a + 2), (a + 2, b + 8))[kind]
        else:
            w, h = ((b & 1) + 2, a + 2) if b & 2 else (a + 2, (b & 1) + 6)
    else:
        r = mode >> 4 & 1 | (mode >> 2 & 3) << 1
        if b == 0:
            w, h = 12, a + 2
        elif b == 1:
            w, h = a + 2, 12
        elif b == 2:
            w, h, high, dual = a + 6, (mode >> 9 & 3) + 6, 0, False
        elif a < 2:
            w, h = ((6, 10), (10, 6))[a]
        else:
            return None
    return None if r < 2 else (w, h, r - 2 + 6 * high, dual)


def _contract(r: int, g: int, b: int, a: int) -> list[int]:
    return [r + b >> 1, g + b >> 1, b, a]


def _offset(v: list[int], i: int) -> tuple[int, int]:
    """Base and signed offset from two stored values."""
    base, off = v[i] >> 1 | v[i + 1] & 128, v[i + 1] >> 1 & 63
    return base, off - 64 if off & 32 else off


def endpoints(mode: int, v: list[int]) -> tuple[list[int], list[int]] | None:
    """Both colors of an endpoint mode; None for HDR modes."""
    if mode == 0:
        return [v[0]] * 3 + [255], [v[1]] * 3 + [255]
    if mode == 1:
        low = v[0] >> 2 | v[1] & 192
        return [low] * 3 + [255], [min(255, low + (v[1] & 63))] * 3 + [255]
    if mode == 4:
        return [v[0]] * 3 + [v[2]], [v[1]] * 3 + [v[3]]
    if mode == 5:
        (a, da), (b, db) = _offset(v, 0), _offset(v, 2)
        clip = lambda x: max(0, min(255, x))
        return [a] * 3 + [b], [clip(a + da)] * 3 + [clip(b + db)]
    if mode in (6, 10):
        alpha = v[4:6] if mode == 10 else [255, 255]
        return [v[i] * v[3] >> 8 for i in range(3)] + [alpha[0]], [*v[:3], alpha[1]]
    if mode in (8, 12):
        low, high = [v[0], v[2], v[4], v[6] if mode == 12 else 255], [v[1], v[3], v[5], v[7] if mode == 12 else 255]
        return (low, high) if sum(high[:3]) >= sum(low[:3]) else (_contract(*high), _contract(*low))
    if mode in (9, 13):
        pairs = [_offset(v, 2 * i) for i in range(4 if mode == 13 else 3)] + ([(255, 0)] if mode == 9 else [])
        base, far = [b for b, _ in pairs], [b + d for b, d in pairs]
        clip = lambda c: [max(0, min(255, x)) for x in c]
        return (clip(base), clip(far)) if sum(d for _, d in pairs[:3]) >= 0 else (clip(_contract(*far)), clip(_contract(*base)))
    return None


def _grid(weights: list[int], w: int, h: int, bw: int, bh: int) -> list[int]:
    """Weights of the block's texels from the stored grid, by bilinear interpolation in sixteenths."""
    step_x, step_y = ((1024 + n // 2) // (n - 1) for n in (bw, bh))
    out = []
    for y in range(bh):
        gy = (step_y * y * (h - 1) + 32) >> 6
        for x in range(bw):
            gx = (step_x * x * (w - 1) + 32) >> 6
            at, fx, fy = (gy >> 4) * w + (gx >> 4), gx & 15, gy & 15
            far = fx * fy + 8 >> 4
            total = 8
            for place, share in ((at, 16 - fx - fy + far), (at + 1, fx - far), (at + w, fy - far), (at + w + 1, far)):
                total += weights[place] * share if share else 0
            out.append(total >> 4)
    return out


def decode_block(raw: bytes, bw: int, bh: int) -> np.ndarray | None:
    """(bh * bw, 4) colors of a block of 16 bytes; None where it is reserved or of high range."""
    bits = int.from_bytes(raw, "little")
    if bits & 0x1FF == 0x1FC:
        return None if bits & 0x200 else np.tile(np.array([raw[9 + 2 * i] for i in range(4)], np.uint8), (bw * bh, 1))
    mode = _block_mode(bits)
    if mode is None:
        return None
    w, h, kind, dual = mode
    kind = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)[kind]
    count = w * h * (1 + dual)
    used = sequence_bits(count, kind)
    parts = (bits >> 11 & 3) + 1
    if w > bw or h > bh or count > 64 or not 24 <= used <= 96 or (dual and parts == 4):
        return None
    mirrored = int(f"{bits:0128b}"[::-1], 2)
    stored = [weight_value(v, kind) for v in decode_sequence(mirrored, count, kind)]
    top = 128 - used
    if parts == 1:
        modes, begin, seed = [bits >> 13 & 15], 17, 0
    else:
        seed, field, begin = bits >> 13 & 1023, bits >> 23 & 63, 29
        if field & 3 == 0:
            modes = [field >> 2] * parts
        else:
            extra = 3 * parts - 4
            top -= extra
            field |= (bits >> top & (1 << extra) - 1) << 6
            classes = [(field & 3) - 1 + (field >> 2 + i & 1) for i in range(parts)]
            modes = [classes[i] << 2 | field >> 2 + parts + 2 * i & 3 for i in range(parts)]
    plane = 0
    if dual:
        top -= 2
        plane = bits >> top & 3
    values = sum((m >> 2) * 2 + 2 for m in modes)
    fits = [k for k in range(len(RANGES)) if sequence_bits(values, k) <= top - begin]
    if values > 18 or not fits or fits[-1] < 4:
        return None
    range_no = fits[-1]
    colors = [color_value(v, range_no) for v in decode_sequence(bits >> begin, values, range_no)]
    ends, at = [], 0
    for m in modes:
        n = (m >> 2) * 2 + 2
        pair = endpoints(m, colors[at : at + n])
        if pair is None:
            return None
        ends.append(pair)
        at += n
    planes = [_grid(stored[i :: 1 + dual], w, h, bw, bh) for i in range(1 + dual)]
    out = np.zeros((bw * bh, 4), np.uint8)
    for t in range(bw * bh):
        low, high = ends[partition_of(seed, t % bw, t // bw, parts, bw * bh < 31)]
        for c in range(4):
            weight = planes[1 if dual and c == plane else 0][t]
            out[t, c] = (low[c] * 257 * (64 - weight) + high[c] * 257 * weight + 32 >> 6) >> 8
    return out


def pack_block(mode: int, endpoint_mode: int, colors: list[int], weights: list[int]) -> bytes:
    """A block of one partition and one plane from its mode bits, stored endpoint values and stored weights."""
    w, h, kind, dual = _block_mode(mode)
    if dual or len(weights) != w * h:
        raise ValueError("one plane of the mode's grid is packed")
    used = sequence_bits(len(weights), kind)
    fits = [k for k in range(len(RANGES)) if sequence_bits(len(colors), k) <= 128 - used - 17]
    bits = mode | endpoint_mode << 13 | encode_sequence(colors, fits[-1]) << 17
    mirrored = f"{encode_sequence(weights, kind):0{used}b}"[::-1]
    return (bits | int(mirrored, 2) << 128 - used).to_bytes(16, "little")


def decode_blocks(df: DataFrame, block: str, bw: int, bh: int, name: str = "texels") -> DataFrame:
    """Append the channel values of each block, texel by texel; null where it is not of low range."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_block(raw, bw, bh) for raw in batch.column(at).to_pylist()]
            lists = pa.array([None if x is None else x.reshape(-1).tolist() for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return df.mapInArrow(run, schema)


def partition_expression(seed: Column, x: Column, y: Column, parts: int, small: bool) -> Column:
    """The partition hash in the engine, for a block position a row. Steps chain through one-element arrays."""
    mask = F.lit(0xFFFFFFFF)
    keep = lambda v: v.bitwiseAND(mask)
    right = lambda v, n: F.shiftright(v, n)
    steps = [
        lambda v: v.bitwiseXOR(right(v, 15)), lambda v: keep(v - F.shiftleft(v, 17)), lambda v: keep(v + F.shiftleft(v, 7)), lambda v: keep(v + F.shiftleft(v, 4)),
        lambda v: v.bitwiseXOR(right(v, 5)), lambda v: keep(v + F.shiftleft(v, 16)), lambda v: v.bitwiseXOR(right(v, 7)), lambda v: v.bitwiseXOR(right(v, 3)),
        lambda v: keep(v.bitwiseXOR(F.shiftleft(v, 6))), lambda v: v.bitwiseXOR(right(v, 17)),
    ]
    scale = 2 if small else 1
    s = seed.cast("long") + (parts - 1) * 1024
    value = F.array(s)
    for step in steps:
        value = F.transform(value, step)

    def choose(r: Column) -> Column:
        bit = lambda n: s.bitwiseAND(F.lit(n)) != 0
        first, second = F.when(bit(2), 4).otherwise(5), F.lit(6 if parts == 3 else 5)
        odd = bit(1)
        shifts = (F.when(odd, first).otherwise(second), F.when(odd, second).otherwise(first))
        square = lambda k: F.call_function("shiftright", right(r, k).bitwiseAND(F.lit(15)) * right(r, k).bitwiseAND(F.lit(15)), shifts[k // 4 % 2])
        scores = [(square(8 * i) * x * scale + square(8 * i + 4) * y * scale + right(r, 14 - 4 * i)).bitwiseAND(F.lit(63)) for i in range(parts)]
        return F.array_position(F.array(*scores), F.greatest(*scores)) - 1 if parts > 1 else F.lit(0)

    return F.transform(value, choose)[0].cast("int")
