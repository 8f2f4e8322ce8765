"""Arithmetic on pixel tables (keys, x, y, channels): projections, and equi-joins of two pictures on keys and place.

Every operator takes a table of any number of pictures; `keys` names the columns that tell them apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.operators import filters
from texloom.operators.images import MOST_HALF, half_code


def _each(pixels: DataFrame, channels: list[str], f: Callable[[Column, int], Column]) -> DataFrame:
    return pixels.withColumns({c: f(F.col(c), i) for i, c in enumerate(channels)})


def _two(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], f: Callable[[Column, Column, int], Column]) -> DataFrame:
    at = [*keys, "x", "y"]
    other = b.select(*at, *[F.col(c).alias(f"__{c}") for c in channels])
    joined = a.select(*at, *channels).join(other, at)
    return joined.select(*at, *[f(F.col(c).cast("double"), F.col(f"__{c}").cast("double"), i).alias(c) for i, c in enumerate(channels)])


def scale_shift(pixels: DataFrame, channels: list[str], scale: list[float], shift: list[float]) -> DataFrame:
    """Each channel times its scale plus its shift, as floats."""
    return _each(pixels, channels, lambda c, i: c.cast("double") * scale[i] + shift[i])


def power(pixels: DataFrame, channels: list[str], exponents: list[float]) -> DataFrame:
    """Each channel to its power."""
    return _each(pixels, channels, lambda c, i: F.pow(c.cast("double"), F.lit(exponents[i])))


def multiply(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], scale: list[float]) -> DataFrame:
    """Products of two pictures, times a scale a channel."""
    return _two(a, b, keys, channels, lambda p, q, i: p * q * scale[i])


def divide(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], scale: list[float]) -> DataFrame:
    """Quotients of two pictures, times a scale a channel; 0 where the divisor is 0."""
    return _two(a, b, keys, channels, lambda p, q, i: F.when(q == 0, 0.0).otherwise(p * scale[i] / F.when(q != 0, q)))


def weighted_sum(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], alpha: list[float], beta: list[float], gamma: list[float]) -> DataFrame:
    """alpha * a + beta * b + gamma, by channel."""
    return _two(a, b, keys, channels, lambda p, q, i: p * alpha[i] + q * beta[i] + gamma[i])


def set_alpha(pixels: DataFrame, value: int, channel: str = "a") -> DataFrame:
    return pixels.withColumn(channel, F.lit(value))


def split_alpha(pixels: DataFrame, color: list[str], alpha: str) -> tuple[DataFrame, DataFrame]:
    """The picture without its alpha (which becomes 255), and its alpha as a gray picture."""
    gray = pixels.withColumns({c: F.col(alpha) for c in color})
    return set_alpha(pixels, 255, alpha), set_alpha(gray, 255, alpha)


def half_range_tonemap(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Floats to 8 bits over the range of 16-bit float codes that each picture has; pictures of one value give no row.

    NaN, infinite and negative values count as 0, larger ones as the largest 16-bit float.
    """
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0), 0.0).otherwise(F.least(c.cast("double"), F.lit(MOST_HALF)))
    codes = _each(pixels, channels, lambda c, i: half_code(clean(c)))
    every = F.array(*channels)
    ends = codes.groupBy(*keys).agg(F.min(F.array_min(every)).alias("__low"), F.max(F.array_max(every)).alias("__high")).where("__low < __high")
    joined = codes.join(ends, keys) if keys else codes.join(ends.withColumn("__one", F.lit(1)), F.col("__one") == 1).drop("__one")
    mapped = lambda c, i: F.floor((c - F.col("__low")) / (F.col("__high") - F.col("__low")) * 255.0 + 0.5).cast("int")
    return _each(joined, channels, mapped).drop("__low", "__high")


def directional_weights(angle: float, along: float, across: float) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of a Gaussian with two deviations, turned by an angle in degrees, out to three of the larger one."""
    half = max(1, math.ceil(3 * max(along, across)))
    turn = math.radians(angle)
    found = []
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            u, v = dx * math.cos(turn) + dy * math.sin(turn), dy * math.cos(turn) - dx * math.sin(turn)
            found.append((dx, dy, math.exp(-0.5 * ((u / along) ** 2 + (v / across) ** 2))))
    total = sum(w for _, _, w in found)
    return [(dx, dy, w / total) for dx, dy, w in found]


def directional_blur(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, angle: float, along: float, across: float) -> DataFrame:
    """Blur along a direction with clamped borders, by whole pictures or strips of them (`filters`).

    The kernel is a list of a few hundred numbers at most; its size depends on the deviations alone.
    """
    return filters.weighted_neighbors(pixels, keys, channels, w, h, directional_weights(angle, along, across))


def block_errors(pairs: DataFrame, keys: list[str], channels: list[str], weights: list[int]) -> DataFrame:
    """Errors of blocks from their texels' two values (channel c beside c + '2'): squared sums of r, g, b; of r, g, b, a; of r, a;
    and the weighted PSNR (10000 where the weighted mean square is at most 1e-5). keys: those of a block."""
    square = [F.sum(F.pow((F.col(c) - F.col(f"{c}2")).cast("double"), F.lit(2.0))).cast("long") for c in channels]
    r, g, b, a = square
    mean = sum((s * w for s, w in zip(square[1:], weights[1:], strict=True)), r * weights[0]) / (F.count(F.lit(1)) * float(sum(weights)))
    weighted = F.when(mean > 1e-5, F.log10(F.lit(255.0) / F.sqrt(F.when(mean > 1e-5, mean))) * 20.0).otherwise(10000.0)
    return pairs.groupBy(*keys).agg((r + g + b).alias("rgb_error"), (r + g + b + a).alias("rgba_error"), (r + a).alias("la_error"), weighted.alias("weighted_psnr"))


def block_moments(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Of each block: every channel's least, largest and sum, and the sums of products of each two channels (s_ab)."""
    found = [F.count(F.lit(1)).alias("texels")]
    for c in channels:
        found += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.sum(c).alias(f"sum_{c}")]
    found += [F.sum(F.col(p) * F.col(q)).alias(f"s_{p}{q}") for i, p in enumerate(channels) for q in channels[i:]]
    return pixels.groupBy(*keys).agg(*found)


#: Fixed value: channels that correlate less than this profit from weights of their own.
DUAL_PLANE_CORRELATION = 0.9999


def dual_plane_worth(moments: DataFrame, has_alpha: Column) -> Column:
    """Whether a block (a row of `block_moments` over r, g, b, a) is worth a second plane of weights: more than one channel
    varies, and alpha or two colors correlate less than DUAL_PLANE_CORRELATION. A channel that is constant correlates 0."""
    n = F.col("texels").cast("double")
    spread = lambda p, q: F.col(f"s_{p}{q}") / n - (F.col(f"sum_{p}") / n) * (F.col(f"sum_{q}") / n)

    def correlation(p: str, q: str) -> Column:
        both = spread(p, p) * spread(q, q)
        return F.when(both > 0, F.abs(spread(p, q)) / F.sqrt(F.when(both > 0, both))).otherwise(0.0)

    active = [F.col(f"min_{c}") < F.col(f"max_{c}") for c in "rgb"]
    count = sum((a.cast("int") for a in active), has_alpha.cast("int"))
    color = F.least(correlation("r", "g"), correlation("r", "b"), correlation("g", "b")) < DUAL_PLANE_CORRELATION
    alpha = has_alpha & (F.least(correlation("r", "a"), correlation("g", "a"), correlation("b", "a")) < DUAL_PLANE_CORRELATION)
    return (count > 1) & (color | alpha)


def sample_history(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Statistics of the last `most` samples of each series: mean, population deviation and variance, mean absolute deviation,
    least and largest. A series' samples are first ranked, which the engine limits before it shuffles them."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    last = df.select(*keys, *order, F.col(value).cast("double").alias("__v")).withColumn("__k", rank).where(F.col("__k") <= most)
    kept = last.groupBy(*keys).agg(F.collect_list("__v").alias("__all"), F.count("__v").alias("samples"), F.avg("__v").alias("avg"), F.var_pop("__v").alias("var"), F.min("__v").alias("least"), F.max("__v").alias("largest"))
    mad = F.aggregate("__all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("avg"))) / F.col("samples")
    return kept.select(*keys, "samples", "avg", F.sqrt("var").alias("std"), "var", mad.alias("mad"), "least", "largest")


def valid_key(key: Column) -> Column:
    """Whether bytes are a key of a key-value table: at most 255 bytes without zeros, then one zero."""
    text = F.hex(key)
    size = F.length(text) / 2
    zeros = F.size(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1)).cast("int")), lambda i: F.substring(text, i * 2 - 1, F.lit(2)) == "00"))
    return F.coalesce(size.between(1, 256) & (F.substring(text, -2, 2) == "00") & (zeros == 1), F.lit(False))


def rate_distortion_drops(level: Column) -> list[Column]:
    """Largest PSNR losses of the passes at a level of 0 to 100 (above: 100): general ones up to 10 dB, block reuse up to 4 dB."""
    share = F.least(level.cast("double"), F.lit(100.0)) / 100.0
    return [(share > 0).alias("passes"), (share * 10.0).alias("general_drop"), (share * 4.0).alias("reuse_drop")]


def frame_kind(codec: Column, frame: Column) -> Column:
    """I for frames that stand alone: the first of ETC1S, and every frame of other codecs; else P."""
    return F.when((codec == "ETC1S") & (frame > 0), "P").otherwise("I")


def psnr_triple(is_hdr: Column, rgb: Column, rgba: Column, half: Column, second_ldr: Column, second_hdr: Column) -> list[Column]:
    """(rgb, rgba, second): of a low-range codec its color and alpha PSNR; of a high-range one the half-float PSNR and -1."""
    return [F.when(is_hdr, half).otherwise(rgb).alias("rgb_psnr"), F.when(is_hdr, F.lit(-1.0)).otherwise(rgba).alias("rgba_psnr"), F.when(is_hdr, second_hdr).otherwise(second_ldr).alias("psnr2")]
