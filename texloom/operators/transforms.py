"""Cosine transforms, the visual quality metric built on them, and small float formats."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The luminance quantization table of the baseline image standard (Annex K), on which the metric's sensitivities rest.
LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ],
    float,
)
SENSITIVITY = 25.735088 / LUMINANCE
MASKING = 100.0 / LUMINANCE**2


def cosine_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II: row k is the k-th basis vector."""
    k, i = np.mgrid[0:n, 0:n]
    out = np.cos(math.pi * (2 * i + 1) * k / (2 * n)) * math.sqrt(2 / n)
    out[0] /= math.sqrt(2)
    return out


def forward_transform(block: np.ndarray) -> np.ndarray:
    return cosine_matrix(block.shape[-2]) @ block @ cosine_matrix(block.shape[-1]).T


def inverse_transform(block: np.ndarray) -> np.ndarray:
    return cosine_matrix(block.shape[-2]).T @ block @ cosine_matrix(block.shape[-1])


def _spread(v: np.ndarray) -> np.ndarray:
    """Sample variance times count, over the last axis."""
    n = v.shape[-1]
    return v.var(axis=-1) * n * n / (n - 1)


def _mask(block: np.ndarray, transformed: np.ndarray) -> np.ndarray:
    """How much detail of a block hides errors: its weighted energy, by how evenly its quarters vary."""
    energy = (transformed**2 * MASKING).reshape(len(block), 64)[:, 1:].sum(axis=1)
    whole = _spread(block.reshape(-1, 64))
    parts = sum(_spread(block[:, y : y + 4, x : x + 4].reshape(-1, 16)) for y in (0, 4) for x in (0, 4))
    share = np.divide(parts, whole, out=np.zeros_like(whole), where=whole != 0)
    return np.sqrt(energy * share / 16 / 64)


def visual_errors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks (n, 8, 8) of values 0..1: sums of squared sensitivity-weighted differences, without and with masking."""
    fa, fb = forward_transform(a), forward_transform(b)
    hidden = np.maximum(_mask(a, fa), _mask(b, fb))[:, None, None] / MASKING
    hidden[:, 0, 0] = 0
    u = np.abs(fa - fb)
    plain = ((u * SENSITIVITY) ** 2).sum(axis=(1, 2))
    masked = ((np.maximum(u - hidden, 0) * SENSITIVITY) ** 2).sum(axis=(1, 2))
    return plain, masked


def visual_psnr(a: DataFrame, b: DataFrame, channel: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, psnr_hvs, psnr_hvsm) of one 8-bit channel of two pictures, or of each two of equal keys. Their sides are multiples
    of 8: pad others first."""
    keys = keys or []
    at = [*keys, "x", "y"]
    pair = a.select(*at, F.col(channel).alias("p")).join(b.select(*at, F.col(channel).alias("q")), at)
    texel = F.array_sort(F.collect_list(F.struct("y", "x", "p", "q")))
    blocks = pair.groupBy(*keys, F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("by")).agg(texel.alias("t"))
    blocks = blocks.select(*keys, F.transform("t", lambda s: s["p"].cast("double")).alias("p"), F.transform("t", lambda s: s["q"].cast("double")).alias("q"))

    @F.pandas_udf("plain double, masked double")
    def errors(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        x, y = (np.array(s.tolist(), float).reshape(-1, 8, 8) / 255 for s in (p, q))
        plain, masked = visual_errors(x, y)
        return pd.DataFrame({"plain": plain, "masked": masked})

    sums = blocks.select(*keys, errors("p", "q").alias("e")).groupBy(*keys).agg((F.sum("e.plain") / (F.count("*") * 64)).alias("m"), (F.sum("e.masked") / (F.count("*") * 64)).alias("n"))
    decibel = lambda c: F.when(F.col(c) > 0, F.log10(F.when(F.col(c) > 0, F.col(c))) * -10.0).otherwise(100.0)
    return sums.select(*keys, decibel("m").alias("psnr_hvs"), decibel("n").alias("psnr_hvsm"))


@F.pandas_udf(T.IntegerType())
def half_bits(v: pd.Series) -> pd.Series:
    """Bits of the nearest 16-bit float."""
    with np.errstate(over="ignore"):
        return pd.Series(v.to_numpy(np.float64).astype(np.float16).view(np.uint16).astype(np.int32))


@F.pandas_udf(T.DoubleType())
def from_half_bits(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy(np.int64).astype(np.uint16).view(np.float16).astype(np.float64))


@F.pandas_udf(T.IntegerType())
def bfloat_bits(v: pd.Series) -> pd.Series:
    """Bits of the nearest bfloat16, ties to even."""
    raw = v.to_numpy(np.float32).view(np.uint32).astype(np.uint64)
    return pd.Series(((raw + 0x7FFF + (raw >> 16 & 1)) >> 16).astype(np.int32))


def shared_exponent(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Three non-negative floats in 32 bits: 9-bit fractions under one 5-bit exponent of bias 15."""
    top = (511 / 512) * 2.0**16
    rgb = np.clip(np.nan_to_num(np.stack([r, g, b], axis=-1), nan=0.0, posinf=top), 0, top)
    largest = rgb.max(axis=-1)
    exponent = np.maximum(-16, np.floor(np.log2(np.maximum(largest, 2.0**-40)))) + 16
    scale = 2.0 ** (exponent - 24)
    exponent = np.where(np.floor(largest / scale + 0.5) == 512, exponent + 1, exponent)
    m = np.floor(rgb / (2.0 ** (exponent - 24))[..., None] + 0.5).astype(np.int64)
    return m[..., 0] | m[..., 1] << 9 | m[..., 2] << 18 | exponent.astype(np.int64) << 27


def from_shared_exponent(v: np.ndarray) -> np.ndarray:
    scale = 2.0 ** ((v >> 27) - 24)
    return np.stack([(v & 511) * scale, (v >> 9 & 511) * scale, (v >> 18 & 511) * scale], axis=-1)


@F.pandas_udf(T.LongType())
def pack_shared_exponent(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(shared_exponent(*(x.to_numpy(np.float64) for x in (r, g, b))))


def half_as_expression(bits: Column) -> Column:
    """A 16-bit float's value from its bits, in the engine."""
    sign = F.when(F.shiftright(bits, 15) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    small = fraction * 2.0**-24
    usual = F.pow(F.lit(2.0), exponent - 15) * (fraction / 1024.0 + 1)
    special = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
    return sign * F.when(exponent == 0, small).when(exponent == 31, special).otherwise(usual)
