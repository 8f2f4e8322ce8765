"""Passes over blocks and texels of many pictures: slice checksums, tonemap of used high bytes, flips, borders, strips, checks.

`keys` names the columns that tell pictures (slices, files) apart.
"""

from __future__ import annotations

import binascii
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.functions.integers import bit_length, clamp, little_endian
from texloom.operators import entropy, images, ordered

#: Polynomial of `entropy.crc16_of`, with its leading bit, and the number of shifts after which a remainder returns.
_POLYNOMIAL, _PERIOD = 0x11021, 32767


def _shift_powers() -> np.ndarray:
    powers = np.ones(_PERIOD, np.int64)
    for k in range(1, _PERIOD):
        powers[k] = powers[k - 1] << 1
        if powers[k] > 0xFFFF:
            powers[k] ^= _POLYNOMIAL
    return powers


def moved_remainders(rest: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Remainders after that many zero bytes: products with a power of x."""
    power = _shift_powers()[behind * 8 % _PERIOD]
    out = np.zeros_like(power)
    for bit in range(16):
        out ^= np.where(rest >> bit & 1, power, 0)
        power = power << 1
        power ^= np.where(power > 0xFFFF, _POLYNOMIAL, 0)
    return out


@F.pandas_udf(T.LongType())
def _share(data: pd.Series, behind: pd.Series) -> pd.Series:
    rest = np.array([binascii.crc_hqx(x, 0) for x in data], np.int64)
    return pd.Series(moved_remainders(rest, behind.to_numpy(np.int64)))


@F.pandas_udf(T.LongType())
def _start(size: pd.Series) -> pd.Series:
    return pd.Series(moved_remainders(np.full(len(size), 0xFFFF, np.int64), size.to_numpy(np.int64)))


def slice_checksums(blocks: DataFrame, keys: list[str], order: list[str], data: str) -> DataFrame:
    """(keys, bytes, crc): CRC-16 of each slice's blocks in order, which are never put together.

    A remainder is linear, so each block adds its own one, moved past the bytes behind it; these are xored. Blocks without
    data add nothing. `order` must tell a slice's blocks apart.
    """
    rows = blocks.select(*keys, *order, F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("__data"))
    rows = ordered.offsets(rows.withColumn("__size", F.length("__data").cast("long")), keys, [F.desc(c) for c in order], "__size")
    shares = rows.select(*keys, "__size", _share("__data", "offset").alias("__share"))
    sums = shares.groupBy(*keys).agg(F.sum("__size").alias("bytes"), F.bit_xor("__share").alias("__crc"))
    crc = F.col("__crc").bitwiseXOR(_start("bytes")).bitwiseXOR(F.lit(0xFFFF))
    return sums.select(*keys, "bytes", crc.cast("int").alias("crc"))


def high_byte_tonemap(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Floats to 8 bits: 16-bit float codes without their sign, moved up as far as the picture's largest one lets them; their
    high bytes are then spread evenly over 0 to 255 in the order of those that the picture uses (256 at most).

    Pictures with a value that is null, NaN, negative or above the largest 16-bit float give no rows.
    """
    every = F.array(*[F.col(c).cast("double") for c in channels])
    wrong = F.exists(every, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > images.MOST_HALF))
    codes = pixels.withColumn("__wrong", wrong).withColumns({c: images.half_code(F.col(c)) * 2 for c in channels})
    ends = codes.groupBy(*keys).agg(F.max(F.array_max(F.array(*channels))).alias("__top"), F.bool_or("__wrong").alias("__any"))
    shifted = codes.join(ends.where("not __any").withColumn("__up", 16 - bit_length(F.col("__top"))), keys)
    high = shifted.withColumns({c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("__up")) / 256).cast("int") for c in channels}).drop("__wrong", "__top", "__any", "__up")
    one = high.select(*keys, F.explode(F.array(*channels)).alias("__high"))
    used = one.groupBy(*keys).agg(F.array_sort(F.collect_set("__high")).alias("__used"))
    last = F.size("__used") - 1
    place = lambda c: (F.array_position("__used", F.col(c)) - 1).cast("int")
    spread = lambda c: F.when(last == 0, place(c)).otherwise(F.floor((place(c) * 255 + F.floor(last / 2)) / F.greatest(last, F.lit(1)))).cast("int")
    return high.join(used, keys).withColumns({c: spread(c) for c in channels}).drop("__used")


def estimated_flip(color: tuple[str, str, str] = ("r", "g", "b")) -> Column:
    """Whether a block (a row of `images.blockify`, 4 x 4) is better split into an upper and a lower half than into a left and
    a right one: each texel's distance to the gray line through its half's mean. Null for blocks without all 16 texels."""
    t = F.col("texels")

    def half(inside: list[int]) -> Column:
        mean = [F.floor((sum((t[i][c] for i in inside[1:]), t[inside[0]][c]) + 4) / 8).cast("int") for c in color]
        own = F.array(*[t[i] for i in inside])

        def distance(texel: Column) -> Column:
            off = sum((texel[c] - m for c, m in zip(color[1:], mean[1:], strict=True)), texel[color[0]] - mean[0])
            gray = ((off + 1) / 3).cast("int")
            squares = [F.pow((texel[c] - clamp(m + gray, 0, 255)).cast("double"), F.lit(2.0)) for c, m in zip(color, mean, strict=True)]
            return squares[0] + squares[1] + squares[2]

        return F.aggregate(own, F.lit(0.0), lambda s, x: s + distance(x))

    places = range(16)
    level = half([i for i in places if i < 8]) + half([i for i in places if i >= 8])
    upright = half([i for i in places if i % 4 < 2]) + half([i for i in places if i % 4 >= 2])
    return F.when(F.size(t) == 16, level < upright)


def strip_sizes(block_rows: Column, weighs_rate: Column, tasks: int, one_strip: Column) -> list[Column]:
    """(strips, rows_per_strip) of a picture's block rows. Without a rate a strip a task; else 12 rows a strip, at least 8 strips
    from 16 rows on and 32 at most. Several strips have an even number of rows, 2 at least. Null where there are no rows."""
    dealt = F.greatest(F.lit(1), F.floor(block_rows / 12), F.when(block_rows >= 16, 8).otherwise(1))
    wanted = F.when(one_strip, 1).when(weighs_rate, F.least(dealt, F.lit(32))).otherwise(tasks)
    rows = F.when(wanted <= 1, block_rows).otherwise(F.greatest(F.floor(block_rows / wanted / 2) * 2, F.lit(2)))
    rows = F.when(block_rows > 0, rows)
    return [F.ceil(block_rows / rows).cast("int").alias("strips"), rows.cast("int").alias("rows_per_strip")]


def symbol_group_codes(df: DataFrame, keys: list[str], order: list[str], symbol: str, bits: int, k: int, most: int = 16) -> DataFrame:
    """(value, freq, length, code): prefix codes of k symbols at a time, the first one in the lowest bits, over all slices.
    A slice's last group may be short. k * bits may be 16 at most."""
    if not 1 <= k * bits <= 16:
        raise ValueError("groups have 1 to 16 bits")
    groups = ordered.symbol_groups(df, keys, order, symbol, k)
    value = F.aggregate(F.reverse("symbols"), F.lit(0).cast("long"), lambda s, x: s * (1 << bits) + x)
    return entropy.code_table(groups.select(value.alias("value"), F.lit(0).alias("__all")), ["__all"], "value", most).drop("__all")


def consistent_inputs(reads_files: Column, files: Column, low: Column, low_mips: Column, high: Column, high_mips: Column) -> Column:
    """Whether a job names its pictures once: files to read, or pictures in memory of one range (counts of each). Mips need
    pictures of their range; files leave no room for pictures in memory."""
    from_files = (files > 0) & (low + low_mips + high + high_mips == 0)
    from_memory = (files == 0) & F.when(low > 0, high + high_mips == 0).otherwise((low_mips == 0) & (high > 0))
    return F.coalesce(F.when(reads_files, from_files).otherwise(from_memory), F.lit(False))


def animation(data: Column) -> list[Column]:
    """(duration, timescale, loops) of a container's animation value: three numbers of 4 bytes; null where it is shorter."""
    whole = F.length(data) >= 12
    return [F.when(whole, little_endian(data, at, 4)).alias(name) for at, name in ((0, "duration"), (4, "timescale"), (8, "loops"))]


def border_penalty(original: DataFrame, decoded: DataFrame, keys: list[str], channels: list[str], size: int = 6) -> DataFrame:
    """(keys, bx, by, penalty): how much decoding changes the step across a block's borders, against the original's step.

    Of each border texel and each neighbour outside the block: the mean squared difference to the original's neighbour, once
    of the original texel and once of the decoded one; the penalty is their relative difference, 0 where the original has no
    step. Neighbours are found by equi-join on their place, so a picture may span tasks.
    """
    at = [*keys, "x", "y"]
    both = original.select(*at, *channels).join(decoded.select(*at, *[F.col(c).alias(f"__{c}") for c in channels]), at)
    x, y = F.col("x"), F.col("y")
    ways = ((x % size == 0, -1, 0), (x % size == size - 1, 1, 0), (y % size == 0, 0, -1), (y % size == size - 1, 0, 1))
    near = F.array(*[F.when(edge, F.struct((x + dx).alias("x"), (y + dy).alias("y"))) for edge, dx, dy in ways])
    rows = both.withColumns({"bx": F.expr(f"x div {size}"), "by": F.expr(f"y div {size}")})
    rows = rows.withColumn("__near", F.explode_outer(F.filter(near, lambda n: n.isNotNull()))).withColumns({"x": F.col("__near.x"), "y": F.col("__near.y")})
    joined = rows.join(original.select(*at, *[F.col(c).alias(f"__near_{c}") for c in channels]), at, "left")
    square = lambda prefix: reduce(Column.__add__, [F.pow((F.col(f"__near_{c}") - F.col(prefix + c)).cast("double"), F.lit(2.0)) for c in channels])
    means = joined.groupBy(*keys, "bx", "by").agg(F.avg(square("")).alias("__own"), F.avg(square("__")).alias("__decoded"))
    own = F.when(F.col("__own") > 0, F.col("__own"))
    return means.select(*keys, "bx", "by", F.coalesce(F.abs((F.col("__decoded") - own) / own), F.lit(0.0)).alias("penalty"))
