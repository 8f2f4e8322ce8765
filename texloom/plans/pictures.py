"""Pictures, blocks, transforms and quantizers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.operators import blockcodecs, images, transforms, vq
from texloom.plans.carriers import table
from texloom.registry import query

W, H = 32, 20
_PIC = f"pic AS (SELECT i % {W} AS x, i // {W} AS y, (i % {W} * 7 + i // {W} * 13) % 256 AS r, (i % {W} * i % {W} + i // {W}) % 256 AS g FROM range(0, {W * H}) t(i))".replace(f"i % {W} * i % {W}", f"(i % {W}) * (i % {W})")


def picture(spark) -> DataFrame:
    """A picture of integer arithmetic: (x, y, r, g)."""
    x, y = F.expr(f"id % {W}"), F.expr(f"id div {W}")
    return spark.range(W * H).select(x.cast("int").alias("x"), y.cast("int").alias("y"), ((x * 7 + y * 13) % 256).alias("r"), ((x * x + y) % 256).alias("g"))


@query("picture_flip", f"WITH {_PIC} SELECT x, {H - 1} - y AS y, r, g FROM pic")
def picture_flip(spark, sf_dir):
    return images.flip_y(picture(spark), H)


@query("picture_crop", f"WITH {_PIC} SELECT x - 5 AS x, y - 3 AS y, r, g FROM pic WHERE x BETWEEN 5 AND 14 AND y BETWEEN 3 AND 8")
def picture_crop(spark, sf_dir):
    return images.crop(picture(spark), 5, 3, 10, 6)


@query(
    "picture_pad",
    f"WITH {_PIC}, grid AS (SELECT i % 36 AS x, i // 36 AS y FROM range(0, 36 * 24) t(i)) SELECT grid.x::INT AS x, grid.y::INT AS y, r, g FROM grid JOIN pic ON pic.x = least(grid.x, {W - 1}) AND pic.y = least(grid.y, {H - 1})",
)
def picture_pad(spark, sf_dir):
    return images.pad(picture(spark), [], W, H, 36, 24)


@query(
    "picture_blit",
    f"WITH {_PIC} SELECT a.x, a.y, coalesce(b.g, a.r) AS r FROM pic a LEFT JOIN pic b ON b.x = a.x - 4 AND b.y = a.y - 2",
)
def picture_blit(spark, sf_dir):
    pic = picture(spark)
    return images.blit(pic.select("x", "y", "r"), pic.select("x", "y", F.col("g").alias("r")), 4, 2, ["r"])


@query("picture_swizzle", f"WITH {_PIC} SELECT x, y, g AS r, r AS g FROM pic")
def picture_swizzle(spark, sf_dir):
    return images.swizzle(picture(spark), ["r", "g"], ["g", "r"])


@query(
    "picture_blocks",
    f"WITH {_PIC} SELECT x // 4 AS bx, y // 4 AS by, array_to_string(list(r ORDER BY y, x), ',') AS texels, count(DISTINCT r) = 1 AS solid FROM pic GROUP BY 1, 2",
)
def picture_blocks(spark, sf_dir):
    rows = images.blockify(picture(spark), [], "x", "y", ["r"])
    values = F.transform("texels", lambda t: t["r"])
    return rows.select("bx", "by", F.array_join(values, ",").alias("texels"), (F.size(F.array_distinct(values)) == 1).alias("solid"))


@query("picture_unblock", f"WITH {_PIC} SELECT x, y, r FROM pic")
def picture_unblock(spark, sf_dir):
    return images.unblock(images.blockify(picture(spark), [], "x", "y", ["r"]), [], ["r"], W, H).withColumn("r", F.col("r"))


@query(
    "picture_halved",
    f"WITH {_PIC} SELECT x // 2 AS x, y // 2 AS y, round(avg(r), 6) AS r, round(avg(g), 6) AS g FROM pic GROUP BY 1, 2",
)
def picture_halved(spark, sf_dir):
    out = images.resample(picture(spark), [], ["r", "g"], W, H, W // 2, H // 2, "box")
    return out.select("x", "y", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


@query(
    "picture_gaussian",
    f"""WITH {_PIC}, raw AS (SELECT k, exp(-(k - 2) * (k - 2) / (2 * 1.2 * 1.2)) AS v FROM range(0, 5) t(k)), wt AS (SELECT k, v / (SELECT sum(v) FROM raw) AS w FROM raw),
hor AS (SELECT a.x, a.y, sum(w * p.r) AS r FROM pic a, wt JOIN pic p ON p.x = least(greatest(a.x + k - 2, 0), {W - 1}) AND p.y = a.y GROUP BY ALL)
SELECT a.x, a.y, round(sum(w * p.r), 6) AS r FROM pic a, wt JOIN hor p ON p.x = a.x AND p.y = least(greatest(a.y + k - 2, 0), {H - 1}) GROUP BY ALL""",
)
def picture_gaussian(spark, sf_dir):
    out = images.convolve(picture(spark).select("x", "y", "r"), [], ["r"], W, H, images.gaussian_weights(5, 1.2))
    return out.select("x", "y", F.round("r", 6).alias("r"))


@query(
    "picture_compare",
    f"""WITH {_PIC}, d AS (SELECT 'r' AS channel, (r - (r + 2) // 4 * 4)::DOUBLE AS d FROM pic UNION ALL SELECT 'g', (g - g)::DOUBLE FROM pic)
SELECT channel, max(abs(d)) AS largest, avg(abs(d)) AS mean, avg(d * d) AS mse, sqrt(avg(d * d)) AS rms,
  CASE WHEN avg(d * d) = 0 THEN 100.0 ELSE least(100.0, greatest(0.0, 20 * log10(255 / sqrt(avg(d * d))))) END AS psnr FROM d GROUP BY 1""",
)
def picture_compare(spark, sf_dir):
    pic = picture(spark)
    return images.compare(pic, pic.withColumn("r", F.expr("(r + 2) div 4 * 4")), ["r", "g"])


@query(
    "picture_bilinear",
    f"""WITH {_PIC}, p AS (SELECT i AS id, i * 0.37 AS px, i * 0.21 AS py FROM range(0, 60) t(i)),
c AS (SELECT id, floor(px) + dx AS x, floor(py) + dy AS y, (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT id, round(sum(w * r), 6) AS r FROM c JOIN pic ON pic.x = least(c.x, {W - 1}) AND pic.y = least(c.y, {H - 1}) GROUP BY id""",
)
def picture_bilinear(spark, sf_dir):
    points = spark.range(60).select("id", (F.col("id") * 0.37).alias("px"), (F.col("id") * 0.21).alias("py"))
    return images.bilinear(picture(spark), points, ["r"], W, H).select("id", F.round("r", 6).alias("r"))


@query("picture_mips", f"WITH l AS (SELECT unnest(range(0, 6))::INT AS level) SELECT level, (greatest({W} >> level, 1) * greatest({H} >> level, 1))::BIGINT AS texels FROM l")
def picture_mips(spark, sf_dir):
    return images.mip_chain(picture(spark), ["r"], W, H).groupBy("level").agg(F.count("*").alias("texels"))


@query("picture_resampled")
def picture_resampled(spark, sf_dir):
    """Every filter, down and up."""
    out = None
    for name in images.FILTERS:
        part = images.resample(picture(spark).select("x", "y", "r"), [], ["r"], W, H, 11, 27, name).withColumn("filter", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("picture_similarity")
def picture_similarity(spark, sf_dir):
    """Structural similarity of the picture and coarser copies."""
    pic, out = picture(spark), None
    for step in (1, 16, 64):
        part = images.ssim(pic, pic.withColumn("r", F.expr(f"r div {step} * {step}")), "r", W, H).withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


@query("picture_visual_psnr")
def picture_visual_psnr(spark, sf_dir):
    pic = images.swirl(spark, 64, 48)
    return transforms.visual_psnr(pic, pic.withColumn("g", F.expr("g div 8 * 8")), "g")


@query("block_formats")
def block_formats(spark, sf_dir):
    """Every block format decoded from all bytes of the benchmark texts: mean channels a format and text."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("data"))
    return blockcodecs.decode_every(rows, "item_id", "data").select("item_id", "mean", "blocks", "fmt")


@query("block_encoders")
def block_encoders(spark, sf_dir):
    """The swirl picture through each encoder and back: mean squared error of the color channels."""
    pic = images.swirl(spark, 64, 64)
    blocks = images.blockify(pic, [], "x", "y", ["r", "g", "b", "a"])
    flat = blocks.select("bx", "by", F.flatten(F.transform("texels", lambda t: F.array(t["r"], t["g"], t["b"], t["a"]))).alias("texels"))
    out = None
    for fmt in ("BC1", "BC3", "BC4", "BC5"):
        rows = blockcodecs.decode_blocks(blockcodecs.encode_blocks(flat, "texels", fmt), "block", fmt, "again")
        d = F.zip_with("texels", "again", lambda p, q: (p - q) * (p - q))
        part = rows.agg(F.avg(F.get(d, 0)).alias("first_texel_mse"), F.avg(F.aggregate(d, F.lit(0), lambda s, x: s + x) / 64.0).alias("mse")).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("container_round_trip")
def container_round_trip(spark, sf_dir):
    """Texts as textures in each container, read back."""
    from collections.abc import Iterator

    import pyarrow as pa

    from texloom.sources import containers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, good, sizes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                h = max(1, -(-len(raw) // 64))
                t = containers.Texture("RGBA32", 16, h, [containers.Image(0, 0, 0, 16, h, raw.ljust(64 * h, b"\0"))])
                files = [containers.write_dds(t), containers.write_ktx2(t), containers.write_ktx2(t, True)]
                back = [containers.read_dds(files[0]), containers.read_ktx2(files[1]), containers.read_ktx2(files[2])]
                ids.append(name)
                good.append(all(b.images[0].data.rstrip(b"\0") == raw.rstrip(b"\0") for b in back))
                sizes.append(len(files[2]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(good), pa.array(sizes, pa.int64())], names=["item_id", "same", "packed"])

    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, same boolean, packed long")


@query("small_floats")
def small_floats(spark, sf_dir):
    """Values as half, bfloat16 and shared-exponent bits, and the half's value by bit arithmetic in the engine."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select("event_id", "value", transforms.half_bits(v).alias("half"), transforms.bfloat_bits(v).alias("bfloat"), transforms.pack_shared_exponent(v, v / 2, v / 4).alias("shared"))
    return rows.withColumn("half_value", transforms.half_as_expression(F.col("half")))


@query("vector_quantizer")
def vector_quantizer(spark, sf_dir):
    """A tree of 16 codes over the embeddings: weight, members and error of each."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v"), (F.col("label") + 1).alias("w"))
    data, leaves = vq.quantize(rows, "v", "w", 16)
    errors = spark.createDataFrame([(i, float(leaf.weight), float(leaf.error), leaf.order, leaf.parent) for i, leaf in enumerate(leaves)], "code int, weight double, error double, made_by int, parent int")
    return errors.join(data.groupBy("code").agg(F.sum("members").alias("members")), "code")


@query("scalable_blocks")
def scalable_blocks(spark, sf_dir):
    """The benchmark texts' bytes as scalable blocks of 6 x 5: how many decode in low range, and their mean."""
    from texloom.operators import astc

    raw = F.col("text").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.expr("(octet_length(text) - 1) div 16").cast("int")), lambda i: F.substring(raw, (i * 16 + 1).cast("int"), F.lit(16)))
    blocks = table(spark, sf_dir, "benchmark").where("octet_length(text) > 0").select("item_id", F.explode(cut).alias("block"))
    # the last block is filled up with zeros
    blocks = blocks.withColumn("block", F.expr("rpad(block, 16, X'00')"))
    rows = astc.decode_blocks(blocks, "block", 6, 5)
    return rows.groupBy("item_id").agg(F.count("*").alias("blocks"), F.count("texels").alias("decoded"), F.avg(F.aggregate("texels", F.lit(0), lambda s, x: s + x) / 120.0).alias("mean"))


@query(
    "partition_hash",
    """WITH t AS (SELECT i // 16 * 25 + 2048 AS seed, i % 4 * 2 AS x, i // 4 % 4 * 2 AS y FROM range(0, 640) t(i)), m AS (SELECT 4294967295 AS k),
h1 AS (SELECT *, xor(seed, seed >> 15) AS v FROM t), h2 AS (SELECT seed, x, y, (v - (v << 17)) & k AS v FROM h1, m), h3 AS (SELECT seed, x, y, (v + (v << 7)) & k AS v FROM h2, m),
h4 AS (SELECT seed, x, y, (v + (v << 4)) & k AS v FROM h3, m), h5 AS (SELECT seed, x, y, xor(v, v >> 5) AS v FROM h4), h6 AS (SELECT seed, x, y, (v + (v << 16)) & k AS v FROM h5, m),
h7 AS (SELECT seed, x, y, xor(v, v >> 7) AS v FROM h6), h8 AS (SELECT seed, x, y, xor(v, v >> 3) AS v FROM h7), h9 AS (SELECT seed, x, y, xor(v, v << 6) & k AS v FROM h8, m), h AS (SELECT seed, x, y, xor(v, v >> 17) AS v FROM h9),
s AS (SELECT *, CASE WHEN seed & 2 <> 0 THEN 4 ELSE 5 END AS a, 6 AS b, [((v >> n) & 15) * ((v >> n) & 15) FOR n IN [0, 4, 8, 12, 16, 20]] AS q FROM h),
u AS (SELECT *, CASE WHEN seed & 1 <> 0 THEN a ELSE b END AS s1, CASE WHEN seed & 1 <> 0 THEN b ELSE a END AS s2 FROM s),
c AS (SELECT seed, x, y, ((q[1] >> s1) * x + (q[2] >> s2) * y + (v >> 14)) & 63 AS p, ((q[3] >> s1) * x + (q[4] >> s2) * y + (v >> 10)) & 63 AS r, ((q[5] >> s1) * x + (q[6] >> s2) * y + (v >> 6)) & 63 AS t FROM u)
SELECT seed - 2048 AS seed, x // 2 AS x, y // 2 AS y, (CASE WHEN p >= r AND p >= t THEN 0 WHEN r >= t THEN 1 ELSE 2 END)::INT AS part FROM c""",
)
def partition_hash(spark, sf_dir):
    from texloom.operators import astc

    rows = spark.range(640).select(F.expr("id div 16 * 25").alias("seed"), F.expr("id % 4").alias("x"), F.expr("id div 4 % 4").alias("y"))
    return rows.withColumn("part", astc.partition_expression(F.col("seed"), F.col("x"), F.col("y"), 3, True))


@query("window_reuse")
def window_reuse(spark, sf_dir):
    """Embeddings as block vectors in id order: own code, or that of one of the 64 blocks before."""
    from texloom.operators import reuse

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return reuse.window_reuse(rows, "vec_id", "v", 64, 0.02, 128, 16)


@query("neighbor_reuse")
def neighbor_reuse(spark, sf_dir):
    """Orders as a grid of blocks: those that take a neighbour's vector at 30 dB."""
    from texloom.operators import reuse
    from texloom.plans.carriers import blocks

    rows = blocks(spark, sf_dir).select("bx", "by", F.array(F.col("q").cast("double"), F.col("endpoint").cast("double") * 10).alias("v"))
    return reuse.neighbor_reuse(rows, "by", "bx", "v", 30.0, 40.0)
