"""Integer functions on columns. 32-bit unsigned arithmetic is done in 64 bits under a mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def long(c: Column | int) -> Column:
    return F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")


def u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(c, low), high)


def bit_field(c: Column, offset: int, length: int) -> Column:
    """Bits offset .. offset + length - 1 of a non-negative value."""
    return F.shiftright(long(c), offset).bitwiseAND(F.lit((1 << length) - 1))


def leading_zeros32(c: Column) -> Column:
    v = long(c)
    return F.when(v == 0, 32).otherwise(F.lit(32) - F.length(F.bin(v)))


def bit_length(c: Column) -> Column:
    """Bits needed for a non-negative value; 0 needs none."""
    v = long(c)
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def floor_log2(c: Column) -> Column:
    return bit_length(c) - 1


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is not below a positive value."""
    return F.expr("1L") * F.pow(F.lit(2.0), bit_length(long(c) - 1)).cast("long")


def _shift_left(v: Column, n: int) -> Column:
    return u32(F.shiftleft(v, n))


#: The six (constant, combine, inner combine, shift) steps of the 32-bit mixing hash.
MIX_STEPS = (
    (0x7ED55D16, "+", "+", 12),
    (0xC761C23C, "^", "^", -19),
    (0x165667B1, "+", "+", 5),
    (0xD3A2646C, "+", "^", 9),
    (0xFD7046C5, "+", "+", 3),
    (0xB55A4F09, "^", "^", -16),
)


def mixing_hash(c: Column) -> Column:
    """32-bit integer hash by six add/xor/shift steps. Steps chain through one-element arrays so that each is computed once."""
    def step(constant: int, combine: str, join: str, shift: int):
        def apply(v: Column) -> Column:
            first = u32(v + F.lit(constant)) if combine == "+" else v.bitwiseXOR(F.lit(constant))
            moved = _shift_left(v, shift) if shift > 0 else F.shiftright(v, -shift)
            return u32(first + moved) if join == "+" else first.bitwiseXOR(moved)

        return apply

    return reduce(lambda value, s: F.transform(value, step(*s)), MIX_STEPS, F.array(u32(long(c))))[0]


def wang_hash(c: Column) -> Column:
    """32-bit integer hash: two xor-shifts around small multiplications."""
    steps = (
        lambda v: v.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(v, 16)),
        lambda v: u32(v * 9),
        lambda v: v.bitwiseXOR(F.shiftright(v, 4)),
        lambda v: u32(v * F.lit(0x27D4EB2D)),
        lambda v: v.bitwiseXOR(F.shiftright(v, 15)),
    )
    return reduce(F.transform, steps, F.array(u32(long(c))))[0]


def little_endian(data: Column, offset: int, size: int) -> Column:
    """The unsigned integer of `size` bytes (1 to 7) at a byte offset of a binary column, low byte first."""
    digits = F.concat(*[F.hex(F.substring(data, offset + size - k, 1)) for k in range(size)])
    return F.conv(digits, 16, 10).cast("long")


def interleave(x: Column, y: Column, bits: int) -> Column:
    """Morton order: bit k of y at 2k, bit k of x at 2k + 1."""
    parts = [F.shiftleft(bit_field(y, k, 1), 2 * k) + F.shiftleft(bit_field(x, k, 1), 2 * k + 1) for k in range(bits)]
    return reduce(lambda a, b: a + b, parts)


def truncated_binary_bits(v: Column, n: Column) -> Column:
    """Bits of a truncated binary code of v in 0..n-1."""
    k = floor_log2(n)
    short = F.pow(F.lit(2.0), k + 1).cast("long") - n
    return F.when(v < short, k).otherwise(k + 1)


def rice_bits(v: Column, m: int) -> Column:
    """Bits of a Rice code with parameter m."""
    return F.shiftright(long(v), m) + F.lit(m + 1)


def chunked_bits(v: Column, chunk: int) -> Column:
    """Bits of a code in chunks of `chunk` bits, each with a flag that another follows."""
    return F.greatest(F.ceil(bit_length(v) / chunk), F.lit(1)) * (chunk + 1)


def varint_bytes(v: Column) -> Column:
    return F.greatest(F.ceil(bit_length(v) / 7), F.lit(1))


def match_cost(distance: Column) -> Column:
    """Estimated bits of a dictionary match at a distance: 7 for the length, and 5 plus the extra bits of the distance class.
    Distance d >= 4 has floor(log2(d)) - 1 extra bits; distances from 32768 on count one more for each doubling."""
    d = long(distance)
    capped = F.least(d, F.lit(32767))
    extra = F.when(capped < 4, 0).otherwise(floor_log2(capped) - 1)
    beyond = F.when(d < 32768, 0).otherwise(floor_log2(d) - 14)
    return F.lit(12) + extra + beyond


def sequence_bits(count: int, trits: int, quints: int, bits: int) -> int:
    """Bits of a bounded integer sequence: each value has `bits` bits and at most one trit or quint; five trits share 8 bits,
    three quints 7."""
    return count * bits + (-(-8 * count // 5) if trits else 0) + (-(-7 * count // 3) if quints else 0)
