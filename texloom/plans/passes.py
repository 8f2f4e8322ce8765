"""Passes over blocks and texels: checksums, tonemap of high bytes, flips, borders, strips, grouped symbols and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import blockcodecs, images, ingest, passes
from texloom.plans.carriers import frames, table
from texloom.plans.gallery import _COARSE, _GALLERY, _HALF, H, W, _pair, gallery
from texloom.registry import query


@query(
    "slice_checksums",
    """WITH s AS (SELECT o_custkey, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)
SELECT o_custkey, length(t)::BIGINT AS bytes, xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: [('0x' || h)::BIGINT << 8, 0, 0, 0, 0, 0, 0, 0])),
  lambda c, e: xor((xor(c, e) << 1) & 65535, 4129 * (xor(c, e) >> 15)), 65535::BIGINT), 65535)::INT AS crc FROM s""",
)
def slice_checksums(spark, sf_dir):
    """A customer's orders as the blocks of a slice."""
    return passes.slice_checksums(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderpriority")


@query(
    "gallery_high_byte_tonemap",
    f"""WITH {_GALLERY}, t AS (SELECT image, x, y, v AS p FROM pic), {_HALF}, m AS (SELECT image, max(bits) * 2 AS top FROM code GROUP BY 1),
s AS (SELECT code.image, x, y, ((bits * 2)::BIGINT << (16 - length(bin(top)))) >> 8 AS high FROM code JOIN m USING (image)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY high) - 1 AS place FROM s), n AS (SELECT image, count(DISTINCT high) - 1 AS last FROM s GROUP BY 1)
SELECT image, x, y, (CASE WHEN last = 0 THEN place ELSE (place * 255 + last // 2) // last END)::INT AS v FROM r JOIN n USING (image)""",
)
def gallery_high_byte_tonemap(spark, sf_dir):
    return passes.high_byte_tonemap(gallery(spark, sf_dir).select("image", "x", "y", "v"), ["image"], ["v"])


_HALVES = ("t.y % 4 < 2", "t.y % 4 >= 2", "t.x % 4 < 2", "t.x % 4 >= 2")
_MEANS = ", ".join(f"(sum({c}) FILTER ({half}) + 4) // 8 AS {c}{k}" for k, half in enumerate(_HALVES) for c in "rgb")


def _gray_distance(k: int) -> str:
    gray = f"trunc((t.r - r{k} + t.g - g{k} + t.b - b{k} + 1) / 3.0)"
    squares = " + ".join(f"(t.{c} - greatest(0, least(255, {c}{k} + {gray}))) ** 2" for c in "rgb")
    return f"sum({squares}) FILTER ({_HALVES[k]})"


@query(
    "gallery_flips",
    f"""WITH {_GALLERY}, t AS (SELECT *, x // 4 AS bx, y // 4 AS by FROM pic), m AS (SELECT image, bx, t.by, count(*) AS n, {_MEANS} FROM t GROUP BY 1, 2, 3),
d AS (SELECT t.image, t.bx, t.by, any_value(n) AS n, {_gray_distance(0)} + {_gray_distance(1)} AS level, {_gray_distance(2)} + {_gray_distance(3)} AS upright
  FROM t JOIN m ON m.image = t.image AND m.bx = t.bx AND m.by = t.by GROUP BY 1, 2, 3)
SELECT image, bx, d.by, CASE WHEN n = 16 THEN level < upright END AS flipped FROM d""",
)
def gallery_flips(spark, sf_dir):
    """Which way each block of 4 x 4 texels is better split."""
    rows = images.blockify(gallery(spark, sf_dir), ["image"], "x", "y", ["r", "g", "b"])
    return rows.select("image", "bx", "by", passes.estimated_flip().alias("flipped"))


_STEP = " + ".join(f"(o.{c} - {{}}.{c}) ** 2" for c in "rgb")


@query(
    "gallery_border_penalty",
    f"""WITH {_GALLERY}, {_COARSE}, e AS (SELECT pic.image, pic.x, pic.y, w.dx, w.dy FROM pic, LATERAL (VALUES (-1, 0, x % 6 = 0), (1, 0, x % 6 = 5), (0, -1, y % 6 = 0), (0, 1, y % 6 = 5)) w(dx, dy, edge) WHERE edge),
m AS (SELECT e.image, e.x // 6 AS bx, e.y // 6 AS by, avg({_STEP.format(*["q"] * 3)}) AS own, avg({_STEP.format(*["c"] * 3)}) AS decoded
  FROM e JOIN pic q ON q.image = e.image AND q.x = e.x AND q.y = e.y JOIN c ON c.image = e.image AND c.x = e.x AND c.y = e.y JOIN pic o ON o.image = e.image AND o.x = e.x + e.dx AND o.y = e.y + e.dy GROUP BY 1, 2, 3),
b AS (SELECT DISTINCT image, x // 6 AS bx, y // 6 AS by FROM pic)
SELECT b.image, b.bx, b.by, round(coalesce(CASE WHEN own > 0 THEN abs((decoded - own) / own) END, 0), 9) AS penalty FROM b LEFT JOIN m ON m.image = b.image AND m.bx = b.bx AND m.by = b.by""",
)
def gallery_border_penalty(spark, sf_dir):
    """Every picture's blocks of 6 x 6 against its coarser copy."""
    found = passes.border_penalty(*_pair(spark, sf_dir), ["image"], ["r", "g", "b"])
    return found.withColumn("penalty", F.round("penalty", 9))


@query(
    "strip_sizes",
    """WITH p AS (SELECT DISTINCT (l_partkey % 500)::INT AS n, l_linenumber % 2 = 1 AS rate, l_linenumber = 7 AS one FROM lineitem WHERE l_partkey IS NOT NULL),
w AS (SELECT *, CASE WHEN one THEN 1 WHEN rate THEN least(32, greatest(1, n // 12, CASE WHEN n >= 16 THEN 8 ELSE 1 END)) ELSE 16 END AS wanted FROM p),
r AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN wanted <= 1 THEN n ELSE greatest(2, n // wanted // 2 * 2) END END AS per FROM w)
SELECT n, rate, one, ceil(n / per)::INT AS strips, per::INT AS rows_per_strip FROM r""",
)
def strip_sizes(spark, sf_dir):
    n = (F.col("l_partkey") % 500).cast("int").alias("n")
    jobs = table(spark, sf_dir, "lineitem").where("l_partkey is not null").select(n, (F.col("l_linenumber") % 2 == 1).alias("rate"), (F.col("l_linenumber") == 7).alias("one")).distinct()
    return jobs.select("n", "rate", "one", *passes.strip_sizes(F.col("n"), F.col("rate"), 16, F.col("one")))


@query(
    "symbol_group_counts",
    """WITH r AS (SELECT user_id, (event_id % 8)::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
g AS (SELECT user_id, k // 3 AS g, sum(s * pow(8, k % 3))::BIGINT AS value FROM r GROUP BY 1, 2)
SELECT value, count(*) AS freq FROM g GROUP BY 1""",
)
def symbol_group_counts(spark, sf_dir):
    """Three symbols of 3 bits at a time, of every user's events, counted for their prefix code."""
    rows = frames(spark, sf_dir).withColumn("s", F.col("event_id") % 8)
    return passes.symbol_group_codes(rows, ["user_id"], ["ts", "event_id"], "s", 3, 3).select("value", "freq")


@query(
    "input_checks",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT % 3 > 0 AND l_partkey % 2 + l_suppkey % 2 + l_orderkey % 2 + l_linenumber % 3 = 0
  ELSE l_quantity::INT % 3 = 0 AND CASE WHEN l_partkey % 2 > 0 THEN l_orderkey % 2 + l_linenumber % 3 = 0 ELSE l_suppkey % 2 = 0 AND l_orderkey % 2 > 0 END END AS consistent FROM lineitem""",
)
def input_checks(spark, sf_dir):
    reads, files = F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int") % 3
    counts = [F.col("l_partkey") % 2, F.col("l_suppkey") % 2, F.col("l_orderkey") % 2, F.col("l_linenumber") % 3]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", passes.consistent_inputs(reads, files, *counts).alias("consistent"))


@query(
    "animation_values",
    """WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents)
SELECT doc_id, """
    + ", ".join(f"CASE WHEN length(x) >= 24 THEN ('0x' || {' || '.join(f'substr(x, {at + 2 * k - 1}, 2)' for k in (4, 3, 2, 1))})::BIGINT END AS {name}" for at, name in ((0, "duration"), (8, "timescale"), (16, "loops")))
    + " FROM h",
)
def animation_values(spark, sf_dir):
    """Bytes of texts as animation values."""
    return table(spark, sf_dir, "documents").select("doc_id", *passes.animation(F.col("text").cast("binary")))


_WHOLE = f"w AS (SELECT image FROM pic GROUP BY image HAVING count(*) = {W * H})"


def _ingested(spark, sf_dir):
    """The gallery's whole pictures, blue and green exchanged, upside down, with mips down to 8 texels a side and alpha slices."""
    pic = gallery(spark, sf_dir).drop("v")
    whole = pic.join(pic.groupBy("image").count().where(F.col("count") == W * H).select("image"), "image", "left_semi")
    return ingest.slices(whole, W, H, ingest.Preparation(swizzle=("r", "b", "g", "a"), flip=True, mips=True, smallest=8))


@query(
    "ingested_texels",
    f"""WITH {_GALLERY}, {_WHOLE}, l0 AS (SELECT image, x, {H - 1} - y AS y, r::DOUBLE AS r, b::DOUBLE AS g, g::DOUBLE AS b, a::DOUBLE AS a FROM pic SEMI JOIN w USING (image)),
l1 AS (SELECT image, x // 2 AS x, y // 2 AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM l0 GROUP BY 1, 2, 3),
l2 AS (SELECT image, x // 2 AS x, y // 2 AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM l1 GROUP BY 1, 2, 3),
every AS (SELECT 0 AS level, 20 AS h, 20 AS wanted, * FROM l0 UNION ALL SELECT 1, 10, 12, * FROM l1 UNION ALL SELECT 2, 5, 8, * FROM l2),
tall AS (SELECT * REPLACE (unnest(CASE WHEN y = h - 1 THEN range(y, wanted) ELSE [y::BIGINT] END) AS y) FROM every),
k AS (SELECT image, level, x, y, floor(r + 0.5)::INT AS r, floor(g + 0.5)::INT AS g, floor(b + 0.5)::INT AS b, floor(a + 0.5)::INT AS a FROM tall)
SELECT image, level, false AS alpha, x, y::INT AS y, r, g, b, 255 AS a FROM k UNION ALL SELECT image, level, true, x, y::INT, a, a, a, 255 FROM k""",
)
def ingested_texels(spark, sf_dir):
    return _ingested(spark, sf_dir)[0]


@query(
    "ingested_slices",
    f"""WITH {_GALLERY}, {_WHOLE}, s(slice_idx, level, alpha, orig_w, orig_h, w, h, nbx, nby, first_block) AS (VALUES (0, 0, false, 32, 20, 32, 20, 8, 5, 0), (1, 0, true, 32, 20, 32, 20, 8, 5, 40),
  (2, 1, false, 16, 10, 16, 12, 4, 3, 80), (3, 1, true, 16, 10, 16, 12, 4, 3, 92), (4, 2, false, 8, 5, 8, 8, 2, 2, 104), (5, 2, true, 8, 5, 8, 8, 2, 2, 108))
SELECT w.image, s.* FROM w, s""",
)
def ingested_slices(spark, sf_dir):
    return _ingested(spark, sf_dir)[1]


@query("gallery_alpha_blocks")
def gallery_alpha_blocks(spark, sf_dir):
    """Alpha of every whole block of the gallery, encoded and decoded: largest and summed squared error."""
    blocks = images.blockify(gallery(spark, sf_dir), ["image"], "x", "y", list("rgba")).where(F.size("texels") == 16)
    flat = blocks.select("image", "bx", "by", F.flatten(F.transform("texels", lambda t: F.array(*[t[c].cast("int") for c in "rgba"]))).alias("texels"))
    rows = blockcodecs.decode_blocks(blockcodecs.encode_blocks(flat, "texels", "EAC_A8"), "block", "EAC_A8", "again")
    off = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("texels", i * 4 + 3) - F.get("again", i * 4 + 3))
    return rows.select("image", "bx", "by", F.array_max(F.transform(off, F.abs)).alias("largest"), F.aggregate(off, F.lit(0), lambda s, x: s + x * x).alias("error"))


@query("gallery_solid_block_errors")
def gallery_solid_block_errors(spark, sf_dir):
    """Every whole block of the gallery as a block of one color: its error, by texels and to the eye, and that of each half."""
    blocks = images.blockify(gallery(spark, sf_dir), ["image"], "x", "y", list("rgba")).where(F.size("texels") == 16)
    flat = blocks.select("image", "bx", "by", F.flatten(F.transform("texels", lambda t: F.array(*[t[c].cast("int") for c in "rgba"]))).alias("texels"))
    rows = blockcodecs.block_error(blockcodecs.encode_blocks(flat, "texels", "ETC1_SOLID"), "block", "texels", "ETC1")
    rows = blockcodecs.block_error(rows, "block", "texels", "ETC1", perceptual=True, name="seen_error")
    for half in (0, 1):
        rows = blockcodecs.block_error(rows, "block", "texels", "ETC1", half=half, name=f"half_{half}")
    return rows.drop("texels", "block")
