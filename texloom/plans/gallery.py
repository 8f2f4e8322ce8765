"""Picture operators over a table of many pictures: orders as texels, 640 of them a picture of 32 by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.operators import arithmetic, frontend, images, transforms
from texloom.operators.blockcodecs import ETC1_MODIFIERS
from texloom.plans.carriers import table
from texloom.registry import query

W, H = 32, 20
_GALLERY = f"""pic AS (SELECT o_orderkey // {W * H} AS image, (o_orderkey % {W})::INT AS x, (o_orderkey % {W * H} // {W})::INT AS y,
  o_custkey % 256 AS r, (o_custkey * 7 + o_orderkey) % 256 AS g, o_orderkey * 5 % 256 AS b, o_custkey * 3 % 251 AS a, o_totalprice / 16 AS v FROM orders)"""


def gallery(spark, sf_dir: str) -> DataFrame:
    """(image, x, y, r, g, b, a, v): 8-bit channels and a float."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {W * H}").alias("image"),
        (key % W).cast("int").alias("x"),
        F.expr(f"cast(o_orderkey % {W * H} div {W} as int)").alias("y"),
        (customer % 256).alias("r"),
        ((customer * 7 + key) % 256).alias("g"),
        (key * 5 % 256).alias("b"),
        (customer * 3 % 251).alias("a"),
        (F.col("o_totalprice") / 16).alias("v"),
    )


def _pair(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The gallery and a coarser copy of it."""
    pic = gallery(spark, sf_dir)
    return pic, pic.withColumns({c: F.expr(f"({c} + 2) div 4 * 4") for c in "rgba"}).withColumn("v", F.floor("v"))


_COARSE = "c AS (SELECT image, x, y, (r + 2) // 4 * 4 AS r, (g + 2) // 4 * 4 AS g, (b + 2) // 4 * 4 AS b, (a + 2) // 4 * 4 AS a, floor(v) AS v FROM pic)"


@query("gallery_flip_crop", f"WITH {_GALLERY} SELECT image, x - 5 AS x, {H - 1} - y - 3 AS y, r FROM pic WHERE x BETWEEN 5 AND 14 AND {H - 1} - y BETWEEN 3 AND 8")
def gallery_flip_crop(spark, sf_dir):
    """Every picture flipped, then a rectangle of it."""
    return images.crop(images.flip_y(gallery(spark, sf_dir).select("image", "x", "y", "r"), H), 5, 3, 10, 6)


@query(
    "gallery_blit",
    f"WITH {_GALLERY} SELECT a.image, a.x, a.y, coalesce(b.g, a.r) AS r FROM pic a LEFT JOIN pic b ON b.image = a.image AND b.x = a.x - 4 AND b.y = a.y - 2",
)
def gallery_blit(spark, sf_dir):
    """Each picture's green drawn over its red, moved by (4, 2)."""
    pic = gallery(spark, sf_dir)
    return images.blit(pic.select("image", "x", "y", "r"), pic.select("image", "x", "y", F.col("g").alias("r")), 4, 2, ["r"], ["image"])


@query(
    "gallery_blocks",
    f"WITH {_GALLERY} SELECT image, x // 4 AS bx, y // 4 AS by, array_to_string(list(r ORDER BY y, x), ',') AS texels, min(r) = max(r) AS solid FROM pic GROUP BY 1, 2, 3",
)
def gallery_blocks(spark, sf_dir):
    rows = images.blockify(gallery(spark, sf_dir), ["image"], "x", "y", ["r"])
    values = F.transform("texels", lambda t: t["r"])
    return rows.select("image", "bx", "by", F.array_join(values, ",").alias("texels"), (F.array_min(values) == F.array_max(values)).alias("solid"))


@query(
    "gallery_mips",
    f"""WITH {_GALLERY}, l0 AS (SELECT image, 0 AS level, x, y, r::DOUBLE AS r FROM pic),
l1 AS (SELECT image, 1 AS level, x // 2 AS x, y // 2 AS y, avg(r) AS r FROM l0 GROUP BY ALL), l2 AS (SELECT image, 2 AS level, x // 2 AS x, y // 2 AS y, avg(r) AS r FROM l1 GROUP BY ALL)
SELECT image, level, x, y, round(r, 6) AS r FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2)
WHERE image < (SELECT max(image) FROM pic)""",
)
def gallery_mips(spark, sf_dir):
    """The first three levels of every picture with all its texels (the last one of the table lacks some)."""
    pic = gallery(spark, sf_dir)
    whole = pic.join(pic.groupBy("image").count().where(F.col("count") == W * H).select("image"), "image", "left_semi")
    return images.mip_chain(whole, ["r"], W, H, "box", ["image"], 3).select("image", "level", "x", "y", F.round("r", 6).alias("r"))


_DIFF = "d AS (SELECT pic.image, u.channel, u.p::DOUBLE AS p, u.q::DOUBLE AS q FROM pic JOIN c USING (image, x, y), LATERAL (VALUES ('r', pic.r, c.r), ('g', pic.g, c.g)) u(channel, p, q))"


@query(
    "gallery_compare",
    f"""WITH {_GALLERY}, {_COARSE}, {_DIFF} SELECT image, channel, max(abs(p - q)) AS largest, round(avg(abs(p - q)), 9) AS mean, round(avg((p - q) * (p - q)), 9) AS mse, round(sqrt(avg((p - q) * (p - q))), 9) AS rms,
  round(CASE WHEN avg((p - q) * (p - q)) = 0 THEN 100.0 ELSE least(100.0, greatest(0.0, 20 * log10(255 / sqrt(avg((p - q) * (p - q)))))) END, 9) AS psnr FROM d GROUP BY 1, 2""",
)
def gallery_compare(spark, sf_dir):
    found = images.compare(*_pair(spark, sf_dir), ["r", "g"], ["image"])
    return found.select("image", "channel", "largest", *[F.round(c, 9).alias(c) for c in ("mean", "mse", "rms", "psnr")])


@query("gallery_difference_histogram", f"WITH {_GALLERY}, {_COARSE}, {_DIFF} SELECT image, channel, (p - q)::INT AS delta, count(*) AS n FROM d GROUP BY 1, 2, 3")
def gallery_difference_histogram(spark, sf_dir):
    return images.compare_histogram(*_pair(spark, sf_dir), ["r", "g"], ["image"])


#: The half code of a positive value: exponent, then the fraction rounded to even.
_HALF = """h AS (SELECT *, greatest(floor(log2(greatest(p, 1e-30))), -14) AS e FROM t),
k AS (SELECT * EXCLUDE (e), CASE WHEN pow(2, e + 1) <= p THEN e + 1 WHEN pow(2, e) > p AND e > -14 THEN e - 1 ELSE e END AS e FROM h),
code AS (SELECT *, least(31744, (e + 14) * 1024 + round_even(p / pow(2, e - 10), 0))::INT AS bits FROM k)"""


@query(
    "gallery_compare_half",
    f"""WITH {_GALLERY}, {_COARSE}, t AS (SELECT image, x, y, 0 AS side, v AS p FROM pic UNION ALL SELECT image, x, y, 1, v FROM c), {_HALF},
d AS (SELECT a.image, (a.bits - b.bits)::DOUBLE AS d, greatest(a.p, b.p) AS most FROM code a JOIN code b USING (image, x, y) WHERE a.side = 0 AND b.side = 1)
SELECT image, 'v' AS channel, max(abs(d)) AS largest, round(avg(abs(d)), 9) AS mean, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 9) AS rms,
  round(CASE WHEN avg(d * d) = 0 THEN 1000.0 ELSE least(1000.0, greatest(0.0, 20 * log10(65535 / sqrt(avg(d * d))))) END, 9) AS psnr,
  false AS has_negative, bool_or(most > 65504) AS has_overflow, false AS has_abnormal FROM d GROUP BY image""",
)
def gallery_compare_half(spark, sf_dir):
    """Float pictures against their whole parts, in 16-bit float codes."""
    found = images.compare_half(*_pair(spark, sf_dir), ["v"], ["image"])
    flags = ["has_negative", "has_overflow", "has_abnormal"]
    return found.select("image", "channel", "largest", F.round("mean", 9).alias("mean"), F.round("mse", 6).alias("mse"), F.round("rms", 9).alias("rms"), F.round("psnr", 9).alias("psnr"), *flags)


@query(
    "gallery_half_tonemap",
    f"""WITH {_GALLERY}, t AS (SELECT image, x, y, least(v, 65504) AS p FROM pic), {_HALF},
m AS (SELECT image, min(bits) AS low, max(bits) AS high FROM code GROUP BY image)
SELECT image, x, y, floor((bits - low)::DOUBLE / (high - low) * 255.0 + 0.5)::INT AS v FROM code JOIN m USING (image) WHERE low < high""",
)
def gallery_half_tonemap(spark, sf_dir):
    return arithmetic.half_range_tonemap(gallery(spark, sf_dir).select("image", "x", "y", "v"), ["image"], ["v"])


@query(
    "gallery_arithmetic",
    f"""WITH {_GALLERY}, {_COARSE} SELECT pic.image, pic.x, pic.y, pic.r * 0.5::DOUBLE + 3 AS scaled, pow(pic.r::DOUBLE, 1.5) AS powered, pic.r * c.r * 0.25::DOUBLE AS product,
  CASE WHEN c.r = 0 THEN 0 ELSE pic.r * 2.0::DOUBLE / c.r END AS quotient, pic.r * 0.75::DOUBLE + c.r * 0.125::DOUBLE + 1 AS weighted FROM pic JOIN c USING (image, x, y)""",
)
def gallery_arithmetic(spark, sf_dir):
    """Scale and shift, power, product, quotient and weighted sum of the gallery and its coarser copy."""
    pic, coarse = ([t.select("image", "x", "y", "r") for t in _pair(spark, sf_dir)])
    at = ["image", "x", "y"]
    parts = {
        "scaled": arithmetic.scale_shift(pic, ["r"], [0.5], [3.0]),
        "powered": arithmetic.power(pic, ["r"], [1.5]),
        "product": arithmetic.multiply(pic, coarse, ["image"], ["r"], [0.25]),
        "quotient": arithmetic.divide(pic, coarse, ["image"], ["r"], [2.0]),
        "weighted": arithmetic.weighted_sum(pic, coarse, ["image"], ["r"], [0.75], [0.125], [1.0]),
    }
    out = None
    for name, part in parts.items():
        part = part.select(*at, F.col("r").alias(name))
        out = part if out is None else out.join(part, at)
    return out


@query(
    "gallery_split_alpha",
    f"WITH {_GALLERY} SELECT 'color' AS part, image, x, y, r, g, 255 AS a FROM pic UNION ALL SELECT 'alpha', image, x, y, a, a, 255 FROM pic",
)
def gallery_split_alpha(spark, sf_dir):
    color, alpha = arithmetic.split_alpha(gallery(spark, sf_dir).select("image", "x", "y", "r", "g", "a"), ["r", "g"], "a")
    return color.withColumn("part", F.lit("color")).unionByName(alpha.withColumn("part", F.lit("alpha")))


@query("gallery_directional_blur")
def gallery_directional_blur(spark, sf_dir):
    """Every picture blurred along 30 degrees."""
    out = arithmetic.directional_blur(gallery(spark, sf_dir).select("image", "x", "y", "r"), ["image"], ["r"], W, H, 30.0, 1.0, 0.5)
    return out.withColumn("r", F.round("r", 6))


@query(
    "gallery_block_errors",
    f"""WITH {_GALLERY}, {_COARSE}, s AS (SELECT pic.image, pic.x // 4 AS bx, pic.y // 4 AS by, count(*) AS n, sum((pic.r - c.r) ** 2) AS r, sum((pic.g - c.g) ** 2) AS g, sum((pic.b - c.b) ** 2) AS b, sum((pic.a - c.a) ** 2) AS a
FROM pic JOIN c USING (image, x, y) GROUP BY 1, 2, 3)
SELECT image, bx, s.by, (r + g + b)::BIGINT AS rgb_error, (r + g + b + a)::BIGINT AS rgba_error, (r + a)::BIGINT AS la_error,
  round(CASE WHEN (r * 3 + g * 4 + b * 2 + a) / (n * 10.0::DOUBLE) > 1e-5 THEN 20 * log10(255 / sqrt((r * 3 + g * 4 + b * 2 + a) / (n * 10.0::DOUBLE))) ELSE 10000 END, 9) AS weighted_psnr FROM s""",
)
def gallery_block_errors(spark, sf_dir):
    pic, coarse = _pair(spark, sf_dir)
    both = pic.join(coarse.select("image", "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgba"]), ["image", "x", "y"])
    both = both.withColumns({"bx": F.expr("x div 4"), "by": F.expr("y div 4")})
    return arithmetic.block_errors(both, ["image", "bx", "by"], list("rgba"), [3, 4, 2, 1]).withColumn("weighted_psnr", F.round("weighted_psnr", 9))


_MOMENTS = ", ".join(f"sum({p} * {q})::BIGINT AS s_{p}{q}" for i, p in enumerate("rgba") for q in "rgba"[i:])


@query(
    "gallery_block_moments",
    f"""WITH {_GALLERY}, m AS (SELECT image, x // 4 AS bx, y // 4 AS by, count(*) AS texels, {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, sum({c})::BIGINT AS sum_{c}" for c in "rgba")}, {_MOMENTS},
  {", ".join(f"coalesce(abs(corr({p}, {q})), 0) AS k_{p}{q}" for p, q in ("rg", "rb", "gb", "ra", "ga", "ba"))} FROM pic GROUP BY 1, 2, 3)
SELECT m.* EXCLUDE (k_rg, k_rb, k_gb, k_ra, k_ga, k_ba), (min_r < max_r)::INT + (min_g < max_g)::INT + (min_b < max_b)::INT + (min_a < 255)::INT > 1
  AND (least(k_rg, k_rb, k_gb) < 0.9999 OR (min_a < 255 AND least(k_ra, k_ga, k_ba) < 0.9999)) AS dual_plane FROM m""",
)
def gallery_block_moments(spark, sf_dir):
    """Moments of every block, and whether a second plane of weights is worth it."""
    rows = gallery(spark, sf_dir).withColumns({"bx": F.expr("x div 4"), "by": F.expr("y div 4")})
    moments = arithmetic.block_moments(rows, ["image", "bx", "by"], list("rgba"))
    return moments.withColumn("dual_plane", arithmetic.dual_plane_worth(moments, F.col("min_a") < 255))


@query("gallery_similarity")
def gallery_similarity(spark, sf_dir):
    """Structural similarity of every picture and its coarser copy."""
    pic, coarse = _pair(spark, sf_dir)
    return images.ssim(pic, coarse, "r", W, H, ["image"]).withColumn("ssim", F.round("ssim", 9))


@query("gallery_visual_psnr")
def gallery_visual_psnr(spark, sf_dir):
    """Visual PSNR of every picture's upper 16 lines."""
    pic, coarse = ([t.join(t.groupBy("image").count().where(F.col("count") == W * H).select("image"), "image", "left_semi").where("y < 16") for t in _pair(spark, sf_dir)])
    return transforms.visual_psnr(pic, coarse, "r", ["image"])


@query(
    "sample_history",
    """WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT * FROM k WHERE k <= 100), m AS (SELECT event_type, avg(value) AS avg FROM s GROUP BY 1)
SELECT event_type, count(*) AS samples, round(any_value(m.avg), 9) AS avg, round(stddev_pop(value), 9) AS std, round(var_pop(value), 6) AS var, round(avg(abs(value - m.avg)), 9) AS mad, min(value) AS least, max(value) AS largest
FROM s JOIN m USING (event_type) GROUP BY 1""",
)
def sample_history(spark, sf_dir):
    """Statistics of each event type's last 100 values."""
    found = arithmetic.sample_history(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", 100)
    return found.withColumns({c: F.round(c, 6 if c == "var" else 9) for c in ("avg", "std", "var", "mad")})


@query(
    "key_validity",
    """SELECT doc_id, source, coalesce(length(source) BETWEEN 0 AND 255, false) AS valid, false AS bare FROM documents""",
)
def key_validity(spark, sf_dir):
    """Sources as keys with the closing zero, and without it."""
    source = F.col("source").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", "source", arithmetic.valid_key(F.concat(source, F.lit(b"\0"))).alias("valid"), arithmetic.valid_key(source).alias("bare"))


@query(
    "rate_distortion_levels",
    """SELECT DISTINCT l_quantity::INT * 3 AS level, l_quantity > 0 AS passes, least(l_quantity::INT * 3, 100) / 100.0::DOUBLE * 10 AS general_drop, least(l_quantity::INT * 3, 100) / 100.0::DOUBLE * 4 AS reuse_drop FROM lineitem""",
)
def rate_distortion_levels(spark, sf_dir):
    levels = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") * 3).alias("level")).distinct()
    return levels.select("level", *arithmetic.rate_distortion_drops(F.col("level")))


@query(
    "frame_kinds",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 'P' ELSE 'I' END AS kind FROM events""",
)
def frame_kinds(spark, sf_dir):
    """Events as frames of a user's stream, every other stream one of ETC1S."""
    from pyspark.sql import Window

    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    codec = F.when(F.col("user_id") % 2 == 0, "ETC1S").otherwise("UASTC")
    return table(spark, sf_dir, "events").select("event_id", codec.alias("codec"), frame.alias("frame")).select("event_id", arithmetic.frame_kind(F.col("codec"), F.col("frame")).alias("kind"))


def _texels(spark, sf_dir: str) -> DataFrame:
    """The gallery's colors by block, with the block's cluster: (image, bx, by, cluster, i, r, g, b)."""
    rows = gallery(spark, sf_dir).withColumns({"bx": F.expr("x div 4"), "by": F.expr("y div 4"), "i": F.expr("y % 4 * 4 + x % 4")})
    return rows.select("image", "bx", "by", ((F.col("image") * 40 + F.col("by") * 8 + F.col("bx")) % 97).alias("cluster"), "i", "r", "g", "b")


#: The four colors' squared errors of a texel under each row of modifiers, least first.
_ROWS = ", ".join(
    "least(" + ", ".join("+".join(f"({c} - greatest(0, least(255, {c}8 + {m})))**2" for c in "rgb") for m in sorted(int(x) for x in row)) + ")" for row in ETC1_MODIFIERS
)
_CLUSTERS = f"""{_GALLERY}, t AS (SELECT image, x // 4 AS bx, y // 4 AS by, (image * 40 + y // 4 * 8 + x // 4) % 97 AS cluster, r, g, b FROM pic),
m AS (SELECT cluster, {", ".join(f"floor(avg({c}) * 31.0::DOUBLE / 255.0 + 0.5)::INT AS {c}5" for c in "rgb")} FROM t GROUP BY 1),
u AS (SELECT t.*, r5, g5, b5, {", ".join(f"(({c}5 << 3) + ({c}5 >> 2)) AS {c}8" for c in "rgb")} FROM t JOIN m USING (cluster)),
e AS (SELECT *, [{_ROWS}] AS errors FROM u),
k AS (SELECT cluster, r5, g5, b5, count(*) AS texels, [{", ".join(f"sum(errors[{k + 1}])" for k in range(len(ETC1_MODIFIERS)))}] AS sums FROM e GROUP BY 1, 2, 3, 4),
p AS (SELECT *, list_position(sums, list_min(sums)) AS at FROM k)"""


@query("cluster_endpoints", f"WITH {_CLUSTERS} SELECT cluster, r5, g5, b5, (p.at - 1)::INT AS row, list_min(sums)::BIGINT AS error, texels FROM p")
def cluster_endpoints(spark, sf_dir):
    """Color and row of modifiers of each cluster of blocks."""
    return frontend.cluster_endpoints(_texels(spark, sf_dir), ["cluster"])


@query("block_endpoint_errors", f"WITH {_CLUSTERS} SELECT e.image, e.bx, e.by, sum(e.errors[p.at])::BIGINT AS error FROM e JOIN p USING (cluster) GROUP BY 1, 2, 3")
def block_endpoint_errors(spark, sf_dir):
    """Squared errors of every block under its cluster's endpoint."""
    texels = _texels(spark, sf_dir)
    return frontend.block_endpoint_errors(texels, frontend.cluster_endpoints(texels, ["cluster"]), ["image", "bx", "by"], "cluster")


@query("endpoint_codebook")
def endpoint_codebook(spark, sf_dir):
    """Clusters' endpoints as training vectors, in a codebook of 16 codes below 4 parents."""
    vectors = frontend.endpoint_vectors(frontend.cluster_endpoints(_texels(spark, sf_dir), ["cluster"]), ["cluster"])
    labels, book = frontend.hierarchical_codebook(vectors, "v", "w", 16, 4)
    return labels.groupBy("code", "parent").agg(F.sum("members").alias("members")).join(book, ["code", "parent"])


@query("selector_training")
def selector_training(spark, sf_dir):
    """Selectors of every block as training vectors with their weights."""
    texels = _texels(spark, sf_dir)
    blocks = ["image", "bx", "by"]
    found = frontend.selector_vectors(texels, frontend.cluster_endpoints(texels, blocks), blocks)
    return found.select(*blocks, F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), "").alias("selectors"), "w")


@query(
    "block_similarity",
    f"""WITH {_GALLERY}, {_COARSE}, s AS (SELECT pic.image, pic.x // 4 AS bx, pic.y // 4 AS by, avg(pic.r / 255::DOUBLE) AS mp, avg(c.r / 255::DOUBLE) AS mq, var_pop(pic.r / 255::DOUBLE) AS vp, var_pop(c.r / 255::DOUBLE) AS vq,
  covar_pop(pic.r / 255::DOUBLE, c.r / 255::DOUBLE) AS pq FROM pic JOIN c USING (image, x, y) GROUP BY 1, 2, 3)
SELECT image, bx, s.by, round(pow(greatest(0, least(1, (2 * mp * mq + 0.0001::DOUBLE) / (mp * mp + mq * mq + 0.0001::DOUBLE))), 1.5::DOUBLE) * greatest(0, least(1, (2 * sqrt(vp) * sqrt(vq) + 0.0009::DOUBLE) / (vp + vq + 0.0009::DOUBLE)))
  * greatest(0, least(1, (pq + 0.00045::DOUBLE) / (sqrt(vp) * sqrt(vq) + 0.00045::DOUBLE))), 9) AS similarity FROM s""",
)
def block_similarity(spark, sf_dir):
    pic, coarse = _pair(spark, sf_dir)
    both = pic.join(coarse.select("image", "x", "y", F.col("r").alias("r2")), ["image", "x", "y"])
    both = both.select("image", F.expr("x div 4").alias("bx"), F.expr("y div 4").alias("by"), (F.col("r") / 255).alias("r"), (F.col("r2") / 255).alias("r2"))
    return frontend.block_similarity(both, ["image", "bx", "by"], ["r"]).withColumn("similarity", F.round("similarity", 9))


@query(
    "split_blocks",
    "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_suppkey % 3) <> max(l_suppkey % 3)",
)
def split_blocks(spark, sf_dir):
    """Orders as blocks, lines as their parts: those in more than one cluster."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("cluster"))
    return frontend.split_blocks(rows, ["l_orderkey"], "cluster")
