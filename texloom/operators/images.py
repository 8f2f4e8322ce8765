"""Pixel tables: (keys, x, y, channels). Geometry is arithmetic on coordinates; neighbourhoods are linear filters or joins on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.operators import filters


def swirl(spark: SparkSession, w: int, h: int) -> DataFrame:
    """A procedural picture (x, y, r, g, b, a) of 8-bit channels, made by the engine."""
    rows = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.expr(f"cast(id div {w} as int)").alias("y"))
    u, v = F.col("x") / w - 0.5, F.col("y") / h - 0.5
    radius, angle = F.sqrt(u * u + v * v), F.atan2(v, u)
    wave = lambda k, p: F.floor(F.lit(127.5) * (F.lit(1.0) + F.sin(angle * k + radius * 20.0 + p)) + 0.5).cast("int")
    alpha = F.floor(F.lit(255.0) * (F.lit(1.0) - radius) + 0.5).cast("int")
    return rows.select("x", "y", wave(3, 0.0).alias("r"), wave(5, 1.0).alias("g"), wave(2, 2.0).alias("b"), F.greatest(F.lit(0), F.least(F.lit(255), alpha)).alias("a"))


def blockify(pixels: DataFrame, keys: list[str], x: str, y: str, channels: list[str], size: int = 4) -> DataFrame:
    """(keys, bx, by, texels): blocks of size x size in raster order."""
    texel = F.struct(F.col(y).alias("y"), F.col(x).alias("x"), *channels)
    return (
        pixels.groupBy(*keys, F.expr(f"{x} div {size}").alias("bx"), F.expr(f"{y} div {size}").alias("by"))
        .agg(F.array_sort(F.collect_list(texel)).alias("t"))
        .select(*keys, "bx", "by", F.transform("t", lambda s: F.struct(*[s[c].alias(c) for c in channels])).alias("texels"))
    )


def unblock(blocks: DataFrame, keys: list[str], channels: list[str], w: int, h: int, size: int = 4) -> DataFrame:
    """Blocks back to pixels; texels beyond the picture are cut."""
    rows = blocks.select(*keys, "bx", "by", F.posexplode("texels").alias("i", "t"))
    x, y = F.col("bx") * size + F.col("i") % size, F.col("by") * size + F.expr(f"i div {size}")
    out = rows.select(*keys, x.cast("int").alias("x"), y.cast("int").alias("y"), *[F.col(f"t.{c}").alias(c) for c in channels])
    return out.where((F.col("x") < w) & (F.col("y") < h))


def pad(pixels: DataFrame, keys: list[str], w: int | Column, h: int | Column, new_w: int | Column, new_h: int | Column) -> DataFrame:
    """Extend to a larger size by repeating the border: each border pixel explodes to the places that it covers. Sizes may be columns."""
    w, h, new_w, new_h = [F.lit(n) if isinstance(n, int) else n for n in (w, h, new_w, new_h)]
    reach = lambda c, n, new: F.when(F.col(c) == n - 1, F.sequence(n - 1, F.greatest(n, new) - 1)).otherwise(F.array(F.col(c)))
    others = [c for c in pixels.columns if c not in ("x", "y")]
    wide = pixels.where((F.col("x") < new_w) & (F.col("y") < new_h)).withColumn("__x", F.explode(reach("x", w, new_w)))
    tall = wide.withColumn("__y", F.explode(reach("y", h, new_h)))
    return tall.select(*[c for c in others if c in keys], F.col("__x").cast("int").alias("x"), F.col("__y").cast("int").alias("y"), *[c for c in others if c not in keys])


def crop(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """A rectangle, moved to the origin."""
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    return pixels.where(inside).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def flip_y(pixels: DataFrame, h: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(h - 1) - F.col("y"))


def swizzle(pixels: DataFrame, channels: list[str], source: list[str]) -> DataFrame:
    """Channel i of the result is channel source[i]."""
    rest = [c for c in pixels.columns if c not in channels]
    return pixels.select(*rest, *[F.col(s).alias(c) for c, s in zip(channels, source, strict=True)])


def blit(target: DataFrame, source: DataFrame, dx: int, dy: int, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """source drawn over target with its origin at (dx, dy); with keys, over the picture of the same keys."""
    keys = keys or []
    moved = source.select(*keys, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"__{c}") for c in channels])
    joined = target.join(moved, [*keys, "x", "y"], "left")
    return joined.select(*keys, "x", "y", *[F.coalesce(f"__{c}", c).alias(c) for c in channels])


def kernel(name: str, t: float) -> float:
    """Value of a resampling filter at a distance."""
    t = abs(t)
    sinc = lambda x: 1.0 if abs(x) < 1e-9 else math.sin(math.pi * x) / (math.pi * x)
    window = lambda x: 0.42659071 + 0.49656062 * math.cos(math.pi * x) + 0.07684867 * math.cos(2 * math.pi * x)
    if name in CUBIC:
        b, c = CUBIC[name]
        if t < 1:
            return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t * t + 6 - 2 * b) / 6
        return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t * t + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6 if t < 2 else 0.0
    if name in QUADRATIC:
        r = QUADRATIC[name]
        if t <= 0.5:
            return -2 * r * t * t + 0.5 * (r + 1)
        return r * t * t + (-2 * r - 0.5) * t + 0.75 * (r + 1) if t < 1.5 else 0.0
    if t >= SUPPORT[name]:
        return 0.0
    if name == "box":
        return 1.0 if t <= 0.5 else 0.0
    if name == "tent":
        return 1 - t
    if name == "bell":
        return 0.75 - t * t if t < 0.5 else 0.5 * (1.5 - t) ** 2
    if name == "blackman":
        return sinc(t) * window(t / 3)
    if name == "gaussian":
        return math.exp(-2 * t * t) * math.sqrt(2 / math.pi) * window(t / SUPPORT[name])
    if name == "kaiser":
        above = 40.0 - 20.96
        alpha = (0.58417 * above) ** 0.4 + 0.07886 * above
        bessel = lambda x: sum((x / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(30))
        return sinc(t) * bessel(alpha * math.sqrt(1 - (t / 3) ** 2)) / bessel(alpha)
    return sinc(t) * sinc(t / SUPPORT[name])


#: Filter parameters and supports.
CUBIC = {"b-spline": (1.0, 0.0), "mitchell": (1 / 3, 1 / 3), "catmullrom": (0.0, 0.5)}
QUADRATIC = {"quadratic_interp": 1.0, "quadratic_approx": 0.5, "quadratic_mix": 0.8}
SUPPORT = {"box": 0.5, "tent": 1.0, "bell": 1.5, "blackman": 3.0, "lanczos3": 3.0, "lanczos4": 4.0, "lanczos6": 6.0, "lanczos12": 12.0, "kaiser": 3.0, "gaussian": 1.25}
SUPPORT |= dict.fromkeys(CUBIC, 2.0) | dict.fromkeys(QUADRATIC, 1.5)
FILTERS = tuple(sorted(SUPPORT))


def wrap(j: int, n: int, boundary: str) -> int:
    """A source place outside 0..n-1 by clamping, wrapping round or reflecting."""
    if boundary == "wrap":
        return j % n
    if boundary == "reflect":
        period = max(1, 2 * n - 2)
        j = j % period
        return min(period - j, j) if n > 1 else 0
    return min(max(j, 0), n - 1)


#: Longest side of a picture: tables of a number or a few per column or row stay small enough to broadcast.
MOST_SIDE = 1 << 14


def _check_sides(*sides: int) -> None:
    if max(sides) > MOST_SIDE:
        raise ValueError(f"pictures have at most {MOST_SIDE} texels a side")


def contributors(n: int, m: int, name: str, scale: float = 1.0, boundary: str = "clamp") -> list[tuple[int, int, float]]:
    """(destination, source, weight) to resample n places to m; weights of a destination sum to 1."""
    ratio = m / n
    stretch = (1 / ratio if ratio < 1 else 1.0) * scale
    reach = SUPPORT[name] * stretch
    out = []
    for i in range(m):
        center = (i + 0.5) / ratio - 0.5
        found: dict[int, float] = {}
        for j in range(math.floor(center - reach), math.ceil(center + reach) + 1):
            if weight := kernel(name, (center - j) / stretch):
                k = wrap(j, n, boundary)
                found[k] = found.get(k, 0.0) + weight
        if not found:
            found = {wrap(round(center), n, boundary): 1.0}
        total = sum(found.values())
        out += [(i, k, v / total) for k, v in sorted(found.items())]
    return out


def resample(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, new_w: int, new_h: int, name: str = "lanczos4", boundary: str = "clamp", scale: float = 1.0) -> DataFrame:
    """Separable resampling along x and then y, by whole pictures or strips of them (`filters`)."""
    return filters.separable(pixels, keys, channels, w, h, *_axes(w, h, new_w, new_h, name, boundary, scale))


def _axes(w: int, h: int, new_w: int, new_h: int, name: str, boundary: str = "clamp", scale: float = 1.0) -> tuple[filters.Axis, filters.Axis]:
    _check_sides(w, h, new_w, new_h)
    return tuple(filters.axis(n, m, contributors(n, m, name, scale, boundary)) for n, m in ((w, new_w), (h, new_h)))


def mip_chain(pixels: DataFrame, channels: list[str], w: int, h: int, name: str = "box", keys: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """(keys, level, x, y, channels): each level from the one before, down to 1 x 1 or for so many levels.

    A picture that is a unit of `filters` gives all its levels in one pass."""
    keys = keys or []
    sizes = [(w, h)]
    while max(sizes[-1]) > 1 and len(sizes) != levels:
        sizes.append(tuple(max(n >> 1, 1) for n in sizes[-1]))
    steps = [_axes(*old, *new, name) for old, new in zip(sizes, sizes[1:])]
    if steps and filters.fits(w, h, *steps[0]):
        return filters.filtered(pixels, keys, channels, w, h, steps, "level")
    out, current = pixels.select(*keys, F.lit(0).alias("level"), "x", "y", *[F.col(c).cast("double").alias(c) for c in channels]), pixels
    for level, ((w, h), step) in enumerate(zip(sizes, steps, strict=False), 1):
        current = filters.separable(current, keys, channels, w, h, *step)
        out = out.unionByName(current.select(*keys, F.lit(level).alias("level"), "x", "y", *channels))
    return out


def gaussian_weights(width: int, sigma: float) -> list[float]:
    raw = [math.exp(-((i - width // 2) ** 2) / (2 * sigma * sigma)) for i in range(width)]
    return [x / sum(raw) for x in raw]


def convolve(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, weights: list[float]) -> DataFrame:
    """Separable filter with clamped borders, by whole pictures or strips of them (`filters`)."""
    _check_sides(w, h, len(weights))
    half, axes = len(weights) // 2, []
    for n in (w, h):
        rows: list[tuple[int, int, float]] = []
        for i in range(n):
            found: dict[int, float] = {}
            for k, weight in enumerate(weights):
                j = min(max(i + k - half, 0), n - 1)
                found[j] = found.get(j, 0.0) + weight
            rows += [(i, j, v) for j, v in found.items()]
        axes.append(filters.axis(n, n, rows))
    return filters.separable(pixels, keys, channels, w, h, *axes)


#: Width and deviation of the window and the two stabilizers of the structural similarity.
SSIM_WIDTH, SSIM_SIGMA, SSIM_C1, SSIM_C2 = 11, 1.5, 6.5025, 58.5225


def ssim(a: DataFrame, b: DataFrame, channel: str, w: int, h: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, ssim): mean structural similarity of one channel of two pictures, or of each two of equal keys."""
    keys = keys or []
    at = [*keys, "x", "y"]
    both = a.select(*at, F.col(channel).cast("double").alias("p")).join(b.select(*at, F.col(channel).cast("double").alias("q")), at)
    p, q = F.col("p"), F.col("q")
    moments = both.select(*at, "p", "q", (p * p).alias("pp"), (q * q).alias("qq"), (p * q).alias("pq"))
    m = convolve(moments, keys, ["p", "q", "pp", "qq", "pq"], w, h, gaussian_weights(SSIM_WIDTH, SSIM_SIGMA))
    upper = (2 * p * q + SSIM_C1) * (2 * (F.col("pq") - p * q) + SSIM_C2)
    lower = (p * p + q * q + SSIM_C1) * ((F.col("pp") - p * p) + (F.col("qq") - q * q) + SSIM_C2)
    return m.groupBy(*keys).agg(F.avg(upper / lower).alias("ssim"))


def bilinear(pixels: DataFrame, points: DataFrame, channels: list[str], w: int, h: int, keys: list[str] | None = None) -> DataFrame:
    """Values at fractional places (keys, id, px, py): four neighbours by equi-join, weighted."""
    keys = keys or []
    fx, fy = F.floor("px"), F.floor("py")
    corners = []
    for dx in (0, 1):
        for dy in (0, 1):
            wx = F.col("px") - fx if dx else 1 - (F.col("px") - fx)
            wy = F.col("py") - fy if dy else 1 - (F.col("py") - fy)
            clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
            corners.append(F.struct(clamp(fx + dx, w).alias("x"), clamp(fy + dy, h).alias("y"), (wx * wy).alias("weight")))
    near = points.select(*keys, "id", F.explode(F.array(*corners)).alias("c")).select(*keys, "id", "c.*")
    return near.join(pixels, [*keys, "x", "y"]).groupBy(*keys, "id").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in channels])


def _channel_pairs(a: DataFrame, b: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """(keys, channel, p, q): values of two pictures over their common part, a row a channel."""
    other = b.select(*keys, "x", "y", *[F.col(c).alias(f"__{c}") for c in channels])
    pairs = ", ".join(f"'{c}', cast({c} as double), cast(__{c} as double)" for c in channels)
    return a.join(other, [*keys, "x", "y"]).select(*keys, F.expr(f"stack({len(channels)}, {pairs}) as (channel, p, q)"))


def compare(a: DataFrame, b: DataFrame, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, channel, largest, mean, mse, rms, psnr) of two pictures over their common part, or of each two of equal keys."""
    from texloom.operators.stats import compare_stats

    keys = keys or []
    return _channel_pairs(a, b, channels, keys).groupBy(*keys, "channel").agg(*compare_stats(F.col("p") - F.col("q")))


def compare_histogram(a: DataFrame, b: DataFrame, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, channel, delta, n): how often each signed difference occurs."""
    keys = keys or []
    return _channel_pairs(a, b, channels, keys).groupBy(*keys, "channel", (F.col("p") - F.col("q")).cast("int").alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def compare_half(a: DataFrame, b: DataFrame, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Metrics of two float pictures in the space of 16-bit float codes, with flags of values that such codes can't hold well.

    PSNR is against a peak of 65535 and within 0..1000; 1000 where nothing differs.
    """
    keys = keys or []
    p, q = F.col("p"), F.col("q")
    d = (half_code(p) - half_code(q)).cast("double")
    abnormal = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    mse = F.avg(d * d)
    psnr = F.when(mse > 0, F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.log10(F.lit(65535.0) / F.sqrt(F.when(mse > 0, mse))) * 20.0))).otherwise(1000.0)
    return _channel_pairs(a, b, channels, keys).groupBy(*keys, "channel").agg(
        F.max(F.abs(d)).alias("largest"),
        F.avg(F.abs(d)).alias("mean"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rms"),
        psnr.alias("psnr"),
        F.bool_or((p < 0) | (q < 0)).alias("has_negative"),
        F.bool_or((F.abs(p) > MOST_HALF) | (F.abs(q) > MOST_HALF)).alias("has_overflow"),
        F.bool_or(abnormal(p) | abnormal(q)).alias("has_abnormal"),
    )


#: Fixed value: the largest finite 16-bit float.
MOST_HALF = 65504.0


def half_code(v: Column) -> Column:
    """Bits of the nearest 16-bit float, ties to even, in the engine: too large values are infinite, NaN is 0x7E00."""
    a = F.abs(v.cast("double"))
    safe = F.when((a > 0) & (a < 131072.0), a).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(safe))
    exponent = F.when(F.pow(F.lit(2.0), guess + 1) <= safe, guess + 1).when(F.pow(F.lit(2.0), guess) > safe, guess - 1).otherwise(guess)
    exponent = F.greatest(exponent, F.lit(-14))
    code = (exponent + 14) * 1024 + F.rint(safe / F.pow(F.lit(2.0), exponent - 10)).cast("long")
    code = F.when(F.isnan(a), 0x7E00).when(a == 0, 0).when(a >= 131072.0, 0x7C00).otherwise(F.least(code, F.lit(0x7C00)))
    return (code + F.when(v < 0, 0x8000).otherwise(0)).cast("int")
