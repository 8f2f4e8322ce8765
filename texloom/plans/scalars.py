"""Scalar functions: integers, colors, paths, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import colors, integers, paths
from texloom.plans.carriers import pixels, table
from texloom.registry import query

_PIXELS = "px AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 5 AS r, round(l_tax * 100)::BIGINT * 30 AS g, l_linenumber::BIGINT * 36 AS b, round(l_discount * 100)::BIGINT * 25 AS a FROM lineitem)"


@query(
    "luma",
    f"WITH {_PIXELS} SELECT (13938 * r + 46869 * g + 4729 * b + 32768) >> 16 AS y709, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS y601, count(*) AS n FROM px GROUP BY 1, 2",
)
def luma(spark, sf_dir):
    c = [F.col(x) for x in "rgb"]
    return pixels(spark, sf_dir).groupBy(colors.luma(*c).alias("y709"), colors.luma(*c, colors.LUMA_601).alias("y601")).agg(F.count("*").alias("n"))


@query(
    "ycbcr",
    f"WITH {_PIXELS}, c AS (SELECT r, g, b, 54 * r + 183 * g + 19 * b AS y FROM px) SELECT y, b * 256 - y AS cb, r * 256 - y AS cr, count(*) AS n FROM c GROUP BY ALL",
)
def ycbcr(spark, sf_dir):
    y, cb, cr = colors.ycbcr(*[F.col(x) for x in "rgb"])
    return pixels(spark, sf_dir).groupBy(y.alias("y"), cb.alias("cb"), cr.alias("cr")).agg(F.count("*").alias("n"))


@query(
    "transfer_curves",
    f"""WITH {_PIXELS}, v AS (SELECT DISTINCT r, r / 255.0 AS s FROM px), l AS (SELECT r, s, CASE WHEN s < 0.04045 THEN s / 12.92 ELSE power((s + 0.055) / 1.055, 2.4) END AS lin FROM v)
SELECT r, round(lin, 9) AS linear_light, least(greatest(floor(lin * 255 + 0.5), 0), 255)::INT AS linear_byte,
  least(greatest(floor((CASE WHEN s < 0.0031308 THEN s * 12.92 ELSE 1.055 * power(s, 1 / 2.4) - 0.055 END) * 255 + 0.5), 0), 255)::INT AS srgb_byte, round(lin * 100 + 0.02, 7) AS upconverted FROM l""",
)
def transfer_curves(spark, sf_dir):
    r = F.col("r")
    rows = pixels(spark, sf_dir).select(r.cast("long").alias("r")).distinct()
    return rows.select(
        "r",
        F.round(colors.srgb_to_linear(r / 255.0), 9).alias("linear_light"),
        colors.transform_byte(r, colors.srgb_to_linear).alias("linear_byte"),
        colors.transform_byte(r, colors.linear_to_srgb).alias("srgb_byte"),
        F.round(colors.upconvert(r, 100.0, 0.02), 7).alias("upconverted"),
    )


@query(
    "color_distances",
    f"""WITH {_PIXELS}, d AS (SELECT r - g AS dr, g - b AS dg, b - r AS db, a - r AS da FROM px),
n AS (SELECT *, 14 * dr + 45 * dg + 5 * db AS l, 27 * dr + 92 * dg + 9 * db AS w FROM d)
SELECT ((l * l) >> 5) + ((((64 * dr - l) * (64 * dr - l)) >> 5) * 26 >> 7) + ((((64 * db - l) * (64 * db - l)) >> 5) * 3 >> 7) AS perceptual,
  ((w * w) >> 7) + ((((128 * dr - w) * (128 * dr - w)) >> 7) * 26 >> 7) + ((((128 * db - w) * (128 * db - w)) >> 7) * 3 >> 7) AS wide,
  dr * dr + dg * dg + db * db + da * da AS plain, 3 * dr * dr + 6 * dg * dg + db * db + 2 * da * da AS weighted, count(*) AS n FROM n GROUP BY ALL""",
)
def color_distances(spark, sf_dir):
    d = (F.col("r") - F.col("g"), F.col("g") - F.col("b"), F.col("b") - F.col("r"))
    da = F.col("a") - F.col("r")
    return (
        pixels(spark, sf_dir)
        .groupBy(
            colors.perceptual_distance(d).alias("perceptual"),
            colors.perceptual_distance_wide(d).alias("wide"),
            colors.squared_distance(*d, da).alias("plain"),
            colors.weighted_distance((*d, da), (3, 6, 1, 2)).alias("weighted"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "packed_pixels",
    f"""WITH {_PIXELS} SELECT ((b * 31 + 127) // 255) + (((g * 63 + 127) // 255) << 5) + (((r * 31 + 127) // 255) << 11) AS p565,
  ((b * 15 + 127) // 255) + (((g * 15 + 127) // 255) << 4) + (((r * 15 + 127) // 255) << 8) + (((a * 15 + 127) // 255) << 12) AS p4444,
  ((b * 31 + 127) // 255) + (((g * 31 + 127) // 255) << 5) + (((r * 31 + 127) // 255) << 10) + (((a + 127) // 255) << 15) AS p1555, count(*) AS n FROM px GROUP BY ALL""",
)
def packed_pixels(spark, sf_dir):
    r, g, b, a = (F.col(x) for x in "rgba")
    return (
        pixels(spark, sf_dir)
        .groupBy(
            colors.pack_channels([(b, 5), (g, 6), (r, 5)]).alias("p565"),
            colors.pack_channels([(b, 4), (g, 4), (r, 4), (a, 4)]).alias("p4444"),
            colors.pack_channels([(b, 5), (g, 5), (r, 5), (a, 1)]).alias("p1555"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "integer_hashes",
    """WITH k AS (SELECT o_orderkey AS v FROM orders), m AS (SELECT 4294967295 AS mask),
w1 AS (SELECT v, xor(xor(v, 61), v >> 16) AS x FROM k), w2 AS (SELECT v, (x * 9) & mask AS x FROM w1, m), w3 AS (SELECT v, xor(x, x >> 4) AS x FROM w2),
w4 AS (SELECT v, (x * 668265261) & mask AS x FROM w3, m), w AS (SELECT v, xor(x, x >> 15) AS wang FROM w4),
a1 AS (SELECT v, ((v + 2127912214) + ((v << 12) & mask)) & mask AS x FROM k, m), a2 AS (SELECT v, xor(xor(x, 3345072700), x >> 19) AS x FROM a1),
a3 AS (SELECT v, (((x + 374761393) & mask) + ((x << 5) & mask)) & mask AS x FROM a2, m), a4 AS (SELECT v, xor((x + 3550635116) & mask, (x << 9) & mask) AS x FROM a3, m),
a5 AS (SELECT v, (((x + 4251993797) & mask) + ((x << 3) & mask)) & mask AS x FROM a4, m), a6 AS (SELECT v, xor(xor(x, 3042594569), x >> 16) AS mixed FROM a5)
SELECT v, mixed, wang FROM a6 JOIN w USING (v)""",
)
def integer_hashes(spark, sf_dir):
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(v.alias("v"), integers.mixing_hash(v).alias("mixed"), integers.wang_hash(v).alias("wang"))


@query(
    "bit_functions",
    """WITH k AS (SELECT o_orderkey + 1 AS v FROM orders)
SELECT v, (v >> 3) & 31 AS bits, CASE WHEN v = 0 THEN 32 ELSE 32 - length(bin(v)) END::INT AS zeros, length(bin(v))::INT - 1 AS log2_floor, power(2, CASE WHEN v = 1 THEN 0 ELSE length(bin(v - 1)) END)::BIGINT AS power_of_two,
  least(greatest(v, 10), 500) AS clamped,
  list_reduce([(((v >> k) & 1) << (2 * k)) + (((v * 3 >> k) & 1) << (2 * k + 1)) for k in range(0, 10)], lambda a, b: a + b) AS morton FROM k""",
)
def bit_functions(spark, sf_dir):
    v = F.col("v")
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("v")).select(
        "v",
        integers.bit_field(v, 3, 5).alias("bits"),
        integers.leading_zeros32(v).alias("zeros"),
        integers.floor_log2(v).alias("log2_floor"),
        integers.next_power_of_two(v).alias("power_of_two"),
        integers.clamp(v, 10, 500).alias("clamped"),
        integers.interleave(v * 3, v, 10).alias("morton"),
    )


@query(
    "little_endian_fields",
    """WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE length(text) >= 12)
SELECT doc_id, ('0x' || substr(x, 3, 2) || substr(x, 1, 2))::BIGINT AS u16, ('0x' || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2))::BIGINT AS u32, ('0x' || substr(x, 13, 2))::BIGINT AS u8 FROM h""",
)
def little_endian_fields(spark, sf_dir):
    data = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").where(F.length("text") >= 12)
    return rows.select("doc_id", integers.little_endian(data, 0, 2).alias("u16"), integers.little_endian(data, 2, 4).alias("u32"), integers.little_endian(data, 6, 1).alias("u8"))


@query(
    "path_functions",
    r"""WITH p AS (SELECT page_id, 'img/' || page_id || '/' || coalesce(regexp_replace(url, '[^A-Za-z0-9./:]', '_', 'g'), '') || CASE WHEN page_id % 3 = 0 THEN '.EXR' ELSE '.png' END AS path FROM pages)
SELECT page_id, regexp_extract(path, '\.([^./\\]*)$', 1) AS extension, regexp_extract(path, '^(.*[/\\])', 1) AS directory, regexp_extract(path, '([^/\\]*)$', 1) AS file_name,
  regexp_replace(path, '\.[^./\\]*$', '') AS stem, lower(path) AS lowered, regexp_matches(lower(path), '\.(exr|hdr)$') AS hdr, (instr(path, '/') - 1)::INT AS first_slash, (length(path) - instr(reverse(path), '/'))::INT AS last_slash FROM p""",
)
def path_functions(spark, sf_dir):
    ending = F.when(F.col("page_id") % 3 == 0, ".EXR").otherwise(".png")
    path = F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit("/"), F.coalesce(F.regexp_replace("url", "[^A-Za-z0-9./:]", "_"), F.lit("")), ending)
    p = F.col("path")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select(
        "page_id",
        paths.extension(p).alias("extension"),
        paths.directory(p).alias("directory"),
        paths.file_name(p).alias("file_name"),
        paths.without_extension(p).alias("stem"),
        F.lower(p).alias("lowered"),
        paths.is_hdr_name(p).alias("hdr"),
        paths.find_first(p, "/").alias("first_slash"),
        paths.find_last(p, "/").alias("last_slash"),
    )


@query(
    "text_fields",
    """WITH l AS (SELECT o_orderkey, ' ' || o_orderkey || ' , ' || o_orderpriority || ',x' AS line FROM orders), s AS (SELECT o_orderkey, string_split(line, ',') AS f FROM l)
SELECT o_orderkey, trim(f[1]) AS first_field, len(f)::INT AS n, CASE WHEN trim(f[1])::BIGINT <= 500 THEN trim(f[1])::BIGINT END AS number FROM s""",
)
def text_fields(spark, sf_dir):
    line = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" , "), F.col("o_orderpriority"), F.lit(",x"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", paths.fields(line).alias("f"))
    return rows.select("o_orderkey", F.col("f")[0].alias("first_field"), F.size("f").alias("n"), paths.unsigned(F.col("f")[0], 500).alias("number"))


@query(
    "formatted_values",
    "SELECT o_orderkey, printf('%05d_%s.png', o_orderkey, o_orderstatus) AS name, 'order ' || o_orderkey || ' of ' || o_custkey AS message FROM orders",
)
def formatted_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("%05d_%s.png", "o_orderkey", "o_orderstatus").alias("name"), F.format_string("order %d of %d", "o_orderkey", "o_custkey").alias("message")
    )


@query(
    "key_values",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE c_mktsegment END AS kind, c_nationkey::VARCHAR AS nation FROM customer",
)
def key_values(spark, sf_dir):
    """Insert or replace entries of a key-value list, then look them up."""
    base = F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    change = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("kind"), F.lit("even"))).otherwise(F.expr("map()").cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(change), k))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.map_concat(kept, change).alias("m"))
    return rows.select("c_custkey", F.element_at("m", "kind").alias("kind"), F.element_at("m", "nation").alias("nation"))


@query(
    "reinhard_tonemap",
    "WITH e AS (SELECT unnest([0.25, 1.0, 4.0]) AS exposure) SELECT event_id, exposure, least(greatest(floor(v / (1 + v) * 255 + 0.5), 0), 255)::INT AS ldr FROM (SELECT event_id, exposure::DOUBLE AS exposure, value * exposure::DOUBLE AS v FROM events, e)",
)
def reinhard_tonemap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.explode(F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0))).alias("exposure"))
    v = F.col("value") * F.col("exposure")
    return rows.select("event_id", "exposure", integers.clamp(F.floor(colors.reinhard(v) * 255 + 0.5), 0, 255).cast("int").alias("ldr"))


@query(
    "clean_hdr_pixels",
    "SELECT event_type, round(sum(CASE WHEN isnan(v) OR v < 0 THEN 0 WHEN v > 60 THEN 60 ELSE v END), 4) AS total, bool_or(isnan(v) OR v < 0 OR v > 60) AS changed FROM (SELECT event_type, value - 5 AS v FROM events) GROUP BY 1",
)
def clean_hdr_pixels(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 5).alias("v"))
    return rows.groupBy("event_type").agg(F.round(F.sum(colors.clean_hdr(v, 60.0)), 4).alias("total"), F.bool_or(F.isnan(v) | (v < 0) | (v > 60)).alias("changed"))


@query(
    "perceptual_intensity",
    """WITH v AS (SELECT event_id, value * 20 AS r, value * 10 AS g, value * 5 AS b FROM events),
l AS (SELECT event_id, (1688 * r + 2146 * g + 262 * b) / 4096 AS l, (683 * r + 2951 * g + 462 * b) / 4096 AS m, (99 * r + 309 * g + 3688 * b) / 4096 AS s FROM v),
q AS (SELECT event_id, [power((power(x, 2523.0 / 4096 * 128)), 1) FOR x IN [(power(greatest(least(y / 10000, 1), 0), 2610.0 / 16384) * (2413.0 / 4096 * 32) + 3424.0 / 4096) / (power(greatest(least(y / 10000, 1), 0), 2610.0 / 16384) * (2392.0 / 4096 * 32) + 1) FOR y IN [l, m, s]]] AS p FROM l)
SELECT event_id, round((p[1] + p[2]) / 2, 7) AS i, round((6610 * p[1] - 13613 * p[2] + 7003 * p[3]) / 4096, 7) AS ct, round((17933 * p[1] - 17390 * p[2] - 543 * p[3]) / 4096, 7) AS cp FROM q""",
)
def perceptual_intensity(spark, sf_dir):
    v = F.col("value")
    i, ct, cp = colors.ictcp(v * 20, v * 10, v * 5)
    return table(spark, sf_dir, "events").select("event_id", F.round(i, 7).alias("i"), F.round(ct, 7).alias("ct"), F.round(cp, 7).alias("cp"))


@query(
    "unit_normals",
    f"""WITH {_PIXELS}, v AS (SELECT l_orderkey, l_linenumber, r / 255.0 * 2 - 1 AS x, g / 255.0 * 2 - 1 AS y, b / 255.0 * 2 - 1 AS z FROM px), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v)
SELECT floor((x / n * 0.5 + 0.5) * 255 + 0.5)::INT AS x, floor((y / n * 0.5 + 0.5) * 255 + 0.5)::INT AS y, floor((z / n * 0.5 + 0.5) * 255 + 0.5)::INT AS z, count(*) AS c FROM n GROUP BY 1, 2, 3""",
)
def unit_normals(spark, sf_dir):
    x, y, z = colors.unit_vector(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, sf_dir).groupBy(x.alias("x"), y.alias("y"), z.alias("z")).agg(F.count("*").alias("c"))


@query(
    "quality_parameters",
    """WITH q AS (SELECT DISTINCT l_quantity / 50 AS q FROM lineitem) SELECT round(q, 4) AS q, round(CASE WHEN q >= 1 THEN 0 ELSE 20 * power(1 - q, 1.3) END, 6) AS ldr_lambda, round(CASE WHEN q >= 1 THEN 0 ELSE 50000 * power(1 - q, 1.5) END, 4) AS hdr_lambda FROM q""",
)
def quality_parameters(spark, sf_dir):
    q = integers.clamp(F.col("l_quantity") / 50, 0.0, 1.0)
    curve = lambda top, p: F.when(F.col("q") >= 1, 0.0).otherwise(F.pow(1 - F.col("q"), F.lit(p)) * top)
    rows = table(spark, sf_dir, "lineitem").select(q.alias("q")).distinct()
    return rows.select(F.round("q", 4).alias("q"), F.round(curve(20.0, 1.3), 6).alias("ldr_lambda"), F.round(curve(50000.0, 1.5), 4).alias("hdr_lambda"))


@query(
    "block_bitrates",
    "WITH b AS (SELECT unnest([[4,4],[5,4],[5,5],[6,5],[6,6],[8,5],[8,6],[10,5],[10,6],[8,8],[10,8],[10,10],[12,10],[12,12]]) AS s) SELECT s[1]::INT AS w, s[2]::INT AS h, round(128.0 / (s[1] * s[2]), 6) AS bits_per_texel FROM b",
)
def block_bitrates(spark, sf_dir):
    from texloom.functions.formats import block_sizes

    return block_sizes(spark).select("w", "h", F.round(F.lit(128.0) / (F.col("w") * F.col("h")), 6).alias("bits_per_texel"))


@query(
    "target_formats",
    """WITH f AS (SELECT unnest(['BC', 'ASTC', 'ETC', 'PVRTC', 'RGBA']) AS family), a AS (SELECT unnest([true, false]) AS has_alpha), h AS (SELECT unnest([true, false]) AS is_hdr)
SELECT family, has_alpha, is_hdr, CASE WHEN family = 'BC' AND is_hdr THEN 'BC6H' WHEN family = 'BC' AND has_alpha THEN 'BC3' WHEN family = 'BC' THEN 'BC1' WHEN family = 'ASTC' AND is_hdr THEN 'ASTC_HDR_4x4' WHEN family = 'ASTC' THEN 'ASTC_LDR_4x4'
  WHEN family = 'ETC' AND has_alpha THEN 'ETC2_RGBA' WHEN family = 'ETC' THEN 'ETC1_RGB' WHEN family = 'PVRTC' AND has_alpha THEN 'PVRTC1_4_RGBA' WHEN family = 'PVRTC' THEN 'PVRTC1_4_RGB' WHEN is_hdr THEN 'RGBA_HALF' ELSE 'RGBA32' END AS format FROM f, a, h""",
)
def target_formats(spark, sf_dir):
    from texloom.functions.formats import choose_format

    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ("BC", "ASTC", "ETC", "PVRTC", "RGBA")))).alias("family"))
    flags = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = rows.select("family", flags.alias("has_alpha")).select("family", "has_alpha", flags.alias("is_hdr"))
    return rows.withColumn("format", choose_format(F.col("family"), F.col("has_alpha"), F.col("is_hdr")))


@query("numbered_sequence", "SELECT i::INT AS i, printf('frame_%04d.png', i) AS path FROM range(3, 43) t(i)")
def numbered_sequence(spark, sf_dir):
    from texloom.sources.listing import numbered_files

    return numbered_files(spark, "frame_%04d.png", 3, 40)


@query(
    "parameter_sweep",
    "SELECT b::INT AS block, e::INT AS effort, q::INT AS quality FROM range(0, 14) x(b), (VALUES (0), (3), (6)) y(e), (VALUES (10), (25), (50), (75), (100)) z(q)",
)
def parameter_sweep(spark, sf_dir):
    rows = spark.range(14).select(F.col("id").cast("int").alias("block"))
    rows = rows.withColumn("effort", F.explode(F.array(*map(F.lit, (0, 3, 6)))))
    return rows.withColumn("quality", F.explode(F.array(*map(F.lit, (10, 25, 50, 75, 100)))))


@query(
    "codec_filter",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')",
)
def codec_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")
