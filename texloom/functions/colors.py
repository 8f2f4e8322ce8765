"""Color functions on columns of 8-bit channels (as numbers) or linear floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texloom.functions.integers import clamp, long

#: Luma weights in 1/65536.
LUMA_601, LUMA_709 = (19595, 38470, 7471), (13938, 46869, 4729)
#: Weights of Y in 1/256 for integer YCbCr.
YCBCR = (54, 183, 19)


def luma(r: Column, g: Column, b: Column, weights: tuple[int, int, int] = LUMA_709) -> Column:
    return F.shiftright(long(r) * weights[0] + long(g) * weights[1] + long(b) * weights[2] + 32768, 16)


def srgb_to_linear(s: Column) -> Column:
    return F.when(s < 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v < 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def transform_byte(v: Column, curve) -> Column:
    """A byte through a curve on 0..1, rounded to the nearest byte."""
    return clamp(F.floor(curve(v / 255.0) * 255.0 + 0.5), 0, 255).cast("int")


def upconvert(v: Column, nits: float, bias: float, to_linear: bool = True) -> Column:
    """An 8-bit channel as a linear float: curve, scale, black level."""
    x = v / 255.0
    return (srgb_to_linear(x) if to_linear else x) * nits + bias


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = long(r) * YCBCR[0] + long(g) * YCBCR[1] + long(b) * YCBCR[2]
    return y, long(b) * 256 - y, long(r) * 256 - y


def _weighted_square(dr: Column, dg: Column, db: Column, weights: tuple[int, int, int], unit: int, shift: int) -> Column:
    """Squared differences of luma and of two chroma axes; chroma counts 26/128 and 3/128."""
    d_l = dr * weights[0] + dg * weights[1] + db * weights[2]
    d_cr, d_cb = dr * unit - d_l, db * unit - d_l
    square = lambda x: F.shiftright(x * x, shift)
    return square(d_l) + F.shiftright(square(d_cr) * 26, 7) + F.shiftright(square(d_cb) * 3, 7)


def perceptual_distance(d: tuple[Column, Column, Column]) -> Column:
    """From channel differences, with 7-bit scale and no overflow in 32 bits."""
    return _weighted_square(*map(long, d), (14, 45, 5), 64, 5)


def perceptual_distance_wide(d: tuple[Column, Column, Column]) -> Column:
    """The same with finer weights, for 64 bits."""
    return _weighted_square(*map(long, d), (27, 92, 9), 128, 7)


def squared_distance(*d: Column) -> Column:
    return sum((long(x) * long(x) for x in d), F.lit(0))


def weighted_distance(d: tuple[Column, ...], weights: tuple[int, ...]) -> Column:
    return sum((long(x) * long(x) * w for x, w in zip(d, weights, strict=True)), F.lit(0))


def pack_channels(channels: list[tuple[Column, int]]) -> Column:
    """8-bit channels, low one first, each rounded to its number of bits (565, 1555, 4444 and so on)."""
    out, at = F.lit(0).cast("long"), 0
    for c, bits in channels:
        out = out + F.shiftleft(F.floor((long(c) * ((1 << bits) - 1) + 127) / 255), at)
        at += bits
    return out


def reinhard(v: Column) -> Column:
    return v / (v + 1.0)


#: Constants of the perceptual quantizer curve.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32


def perceptual_quantizer(v: Column, peak: float = 10000.0) -> Column:
    p = F.pow(clamp(v / peak, 0.0, 1.0), F.lit(PQ_M1))
    return F.pow((p * PQ_C2 + PQ_C1) / (p * PQ_C3 + 1.0), F.lit(PQ_M2))


def ictcp(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear BT.2100 light to intensity and two chroma axes."""
    dot = lambda w, v, unit: sum((x * (k / unit) for k, x in zip(w, v, strict=True)), F.lit(0.0))
    lms = [perceptual_quantizer(dot(w, (r, g, b), 4096)) for w in ((1688, 2146, 262), (683, 2951, 462), (99, 309, 3688))]
    return dot((2048, 2048, 0), lms, 4096), dot((6610, -13613, 7003), lms, 4096), dot((17933, -17390, -543), lms, 4096)


def unit_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A normal stored in bytes, renormalized: bytes to -1..1, length 1, back; a zero vector stays."""
    v = [c / 255.0 * 2.0 - 1.0 for c in (x, y, z)]
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    back = lambda c: clamp(F.floor((c / n * 0.5 + 0.5) * 255.0 + 0.5), 0, 255).cast("int")
    return tuple(F.when(n == 0, F.lit(128)).otherwise(back(c)) for c in v)


def clean_hdr(v: Column, highest: float) -> Column:
    """NaN and negative values to 0, infinite and too large ones to the highest."""
    return F.when(F.isnan(v) | (v < 0), 0.0).when(v > highest, highest).otherwise(v)
