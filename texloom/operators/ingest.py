"""From pictures to slices: alpha from a second picture, unit normals, swizzle, flip, resampling, mips, alpha slices, padding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import colors
from texloom.operators import images

CHANNELS = ["r", "g", "b", "a"]


@dataclass(frozen=True)
class Preparation:
    """What happens to pictures on their way in. size: resample to it. smallest: mips end where neither side is longer.
    split_alpha: where any picture has alpha, every level has a slice of colors and one of alpha."""

    renormalize: bool = False
    swizzle: tuple[str, str, str, str] = ("r", "g", "b", "a")
    flip: bool = False
    size: tuple[int, int] | None = None
    kernel: str = "box"
    mips: bool = False
    smallest: int = 1
    split_alpha: bool = True
    block: int = 4


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")


def level_sizes(w: int, h: int, smallest: int) -> list[tuple[int, int]]:
    sizes = [(w, h)]
    while max(sizes[-1]) > max(smallest, 1):
        sizes.append(tuple(max(n >> 1, 1) for n in sizes[-1]))
    return sizes


def slices(pixels: DataFrame, w: int, h: int, how: Preparation, alpha: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Texels (image, level, alpha, x, y, r, g, b, a) and slices (image, slice_idx, level, alpha, orig_w, orig_h, w, h, nbx, nby,
    first_block) of 8-bit pictures of one size, (image, x, y, r, g, b, a).

    alpha: pictures whose luma becomes the alpha channel, 0 where they have no texel. Slices are padded to whole blocks with
    their border; first_block counts from a picture's start. Without split_alpha a slice is an alpha slice if it has alpha
    itself. Levels are filtered as they are stored, without a transfer curve. Whether any picture has alpha is the one
    value that the driver sees.
    """
    at = ["image", "x", "y"]
    rows = pixels.select(*at, *CHANNELS)
    if alpha is not None:
        light = alpha.select(*at, colors.luma(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("__light"))
        rows = rows.join(light, at, "left").withColumn("a", F.coalesce("__light", F.lit(0))).drop("__light")
    if how.renormalize:
        rows = rows.withColumns(dict(zip("rgb", colors.unit_vector(*[F.col(c) for c in "rgb"]), strict=True)))
    rows = images.swizzle(rows, CHANNELS, list(how.swizzle))
    any_alpha = how.swizzle[3] != "a" or bool(rows.agg(F.bool_or(F.col("a") < 255)).first()[0])
    if how.flip:
        rows = images.flip_y(rows, h)
    if how.size:
        rows = images.resample(rows, ["image"], CHANNELS, w, h, *how.size, how.kernel).withColumns({c: _byte(F.col(c)) for c in CHANNELS})
        w, h = how.size
    sizes = level_sizes(w, h, how.smallest) if how.mips else [(w, h)]
    images_found = rows.select("image").distinct()
    if how.mips:
        rows = images.mip_chain(rows, CHANNELS, w, h, how.kernel, ["image"], len(sizes))
    else:
        rows = rows.withColumn("level", F.lit(0))
    rows = rows.select("image", "level", "x", "y", *[_byte(F.col(c)).alias(c) for c in CHANNELS])
    parts = any_alpha and how.split_alpha
    if parts:
        both = rows.withColumn("alpha", F.explode(F.array(F.lit(False), F.lit(True))))
        rows = both.withColumns({c: F.when(F.col("alpha"), F.col("a")).otherwise(F.col(c)) for c in "rgb"}).withColumn("a", F.lit(255))
    else:
        rows = rows.withColumn("alpha", F.lit(False))
    whole = lambda n: -(-n // how.block) * how.block
    of_level = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("level"))
    widths, heights = zip(*sizes, strict=True)
    padded = images.pad(rows, ["image", "level", "alpha"], *[of_level(n) for n in (widths, heights, [whole(n) for n in widths], [whole(n) for n in heights])])
    found, first = [], 0
    for level, (lw, lh) in enumerate(sizes):
        for flag in (False, True) if parts else (False,):
            nbx, nby = whole(lw) // how.block, whole(lh) // how.block
            values = {"slice_idx": len(found), "level": level, "alpha": flag, "orig_w": lw, "orig_h": lh, "w": whole(lw), "h": whole(lh), "nbx": nbx, "nby": nby, "first_block": first}
            found.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
            first += nbx * nby
    table = images_found.select("image", F.inline(F.array(*found)))
    if any_alpha and not parts:
        has = padded.groupBy("image", "level").agg(F.bool_or(F.col("a") < 255).alias("__has"))
        padded = padded.join(has, ["image", "level"]).withColumn("alpha", F.col("__has")).drop("__has")
        table = table.join(has, ["image", "level"]).withColumn("alpha", F.col("__has")).drop("__has")
    return padded.select("image", "level", "alpha", "x", "y", *CHANNELS), table.select("image", "slice_idx", "level", "alpha", "orig_w", "orig_h", "w", "h", "nbx", "nby", "first_block")
