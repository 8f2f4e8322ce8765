"""Codecs, containers, transforms, quantization and streams: round trips, identities and plain Python."""

import math
import shutil
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from texloom.operators import blockcodecs as bc
from texloom.operators import images, ordered, transforms, vq
from texloom.sources import containers, datasource, rasters

RNG = np.random.default_rng(0)


def smooth(n):
    base, slope = RNG.integers(40, 200, (n, 1, 4)), RNG.integers(-3, 4, (n, 1, 4))
    return np.clip(base + slope * np.arange(16)[None, :, None], 0, 255).astype(np.uint8)


@pytest.mark.parametrize("fmt,channels,most", [("BC1", [0, 1, 2], 9), ("BC3", [0, 1, 2, 3], 9), ("BC4", [0], 6), ("BC5", [0, 1], 6)])
def test_encoders_are_close(fmt, channels, most):
    t = smooth(200)
    size, decode = bc.DECODERS[fmt]
    raw = bc.ENCODERS[fmt](t)
    assert raw.shape == (200, size)
    error = (decode(raw)[..., channels].astype(int) - t[..., channels]) ** 2
    assert math.sqrt(error.mean()) < most


def test_solid_colors():
    t = np.repeat(RNG.integers(0, 256, (300, 1, 4)), 16, axis=1).astype(np.uint8)
    assert np.abs(bc.decode_etc1(bc.encode_etc1_solid(t))[..., :3].astype(int) - t[..., :3]).max() <= 8
    assert np.abs(bc.decode_bc1(bc.encode_bc1(t))[..., :3].astype(int) - t[..., :3]).max() <= 4
    assert (bc.decode_bc4_values(bc.encode_bc4(t[..., 0])) == t[..., 0]).all()


def test_bc1_by_hand():
    block = np.frombuffer(struct.pack("<HHI", 0xF800, 0x001F, 0b11100100), np.uint8)[None]
    assert bc.decode_bc1(block)[0, :4].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    clear = np.frombuffer(struct.pack("<HHI", 0x001F, 0xF800, 0b11100100), np.uint8)[None]
    assert bc.decode_bc1(clear)[0, 2:4].tolist() == [[127, 0, 127, 255], [0, 0, 0, 0]]
    assert bc.decode_bc1(clear, always_four=True)[0, 3].tolist() == [170, 0, 85, 255]


def test_eac_and_etc1_by_hand():
    flat = np.array([[100, 0x10, 0, 0, 0, 0, 0, 0]], np.uint8)
    assert (bc.decode_eac_a8_values(flat) == 97).all()
    r11 = np.array([[128, 0, 0, 0, 0, 0, 0, 0]], np.uint8)
    assert (bc.decode_eac_r11(r11)[..., 0] == ((128 * 8 + 4 - 3) * 255 + 1023) // 2047).all()
    etc = np.array([[0x80, 0x80, 0x80, 0, 0, 0, 0, 0]], np.uint8)
    out = bc.decode_etc1(etc)[0].reshape(4, 4, 4)
    assert out[0, 0].tolist() == [138, 138, 138, 255] and out[0, 3].tolist() == [2, 2, 2, 255]


def test_blocks_as_dataframes(spark):
    t = smooth(50)
    df = spark.createDataFrame([(i, x.reshape(-1).tolist()) for i, x in enumerate(t)], "id int, texels array<int>")
    back = bc.decode_blocks(bc.encode_blocks(df, "texels", "BC3"), "block", "BC3", "again").orderBy("id").collect()
    assert all(len(r["block"]) == 16 and math.dist(r["texels"], r["again"]) < 8 * 9 for r in back)
    assert bc.encode_blocks(df.limit(0), "texels", "BC1").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1), st.booleans())
def test_rasters_round_trip(w, h, seed, flat):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 3 if flat else 256, (h, w, 4)).astype(np.uint8)
    for ending in rasters.WRITERS:
        assert (rasters.READERS[ending](rasters.WRITERS[ending](p)) == p).all()


def test_tga_runs_and_bottom_up():
    head = struct.pack("<BBB5sHHHHBB", 0, 0, 10, b"\0" * 5, 0, 0, 4, 2, 24, 0)
    raw = head + bytes([0x83, 1, 2, 3]) + bytes([1, 9, 8, 7, 6, 5, 4]) + bytes([0x81, 0, 0, 0])
    out = rasters.read_tga(raw)
    assert out[1].tolist() == [[3, 2, 1, 255]] * 4 and out[0, :2].tolist() == [[7, 8, 9, 255], [4, 5, 6, 255]]


def test_png_palette_and_filters():
    import zlib

    def chunk(tag, part):
        return struct.pack(">I", len(part)) + tag + part + struct.pack(">I", zlib.crc32(tag + part))

    head = struct.pack(">IIBBBBB", 5, 1, 2, 3, 0, 0, 0)
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\7") + chunk(b"IDAT", zlib.compress(b"\0\x1b\x40")) + chunk(b"IEND", b"")
    assert rasters.read_png(raw)[0].tolist() == [[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255], [3, 4, 5, 255]]
    want = RNG.integers(0, 256, (5, 3)).astype(np.uint8)
    lines = b""
    before = np.zeros(3, int)
    for kind, row in enumerate(want.astype(int)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        paeth = [min((a, b, c), key=lambda x: abs(a + b - c - x)) for a, b, c in zip(left, before, corner)]
        guess = [np.zeros(3, int), left, before, (left + before) // 2, np.array(paeth)][kind]
        lines += bytes([kind]) + bytes(((row - guess) & 255).tolist())
        before = row
    gray = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (rasters.read_png(gray)[..., 0] == want).all()


def test_radiance():
    p = RNG.uniform(0, 50, (4, 9, 3)).astype(np.float32)
    assert np.abs(rasters.read_radiance(rasters.write_radiance(p)) - p).max() < 0.3
    line = b"\2\2\0\x08" + b"".join(bytes([128 + 8, v]) for v in (128, 64, 32, 129))
    coded = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 8\n" + line
    assert np.allclose(rasters.read_radiance(coded)[0, 0], [1.0, 0.5, 0.25])


def texture(fmt, layers=1, faces=1, levels=3, w=12, h=8):
    t = containers.Texture(fmt, w, h, key_values={"a": b"1", "b": b"\0\1"})
    for layer in range(layers):
        for face in range(faces):
            for level in range(levels):
                lw, lh = max(1, w >> level), max(1, h >> level)
                t.images.append(containers.Image(level, layer, face, lw, lh, RNG.bytes(containers.level_size(fmt, lw, lh))))
    return t


def content(t):
    return t.fmt, t.width, t.height, sorted((i.level, i.layer, i.face, i.width, i.height, i.data) for i in t.images)


@pytest.mark.parametrize("fmt", ["RGBA32", "BC1", "BC3", "BC5", "BC7"])
@pytest.mark.parametrize("layers,faces", [(1, 1), (3, 1), (1, 6)])
def test_containers_round_trip(fmt, layers, faces):
    t = texture(fmt, layers, faces)
    assert content(containers.read_dds(containers.write_dds(t))) == content(t)
    for zstd in (False, True):
        back = containers.read_ktx2(containers.write_ktx2(t, zstd))
        assert content(back) == content(t) and back.key_values == t.key_values
    if fmt in containers.GL_FORMATS:
        assert containers.write_ktx(t)[:12] == containers.KTX_MARK


def test_astc_and_slice_file():
    blocks = [containers.make_constant_block((i, 2, 3, 4)) for i in range(6)]
    w, h, bw, bh, back = containers.read_astc(containers.write_astc(11, 7, 4, 4, b"".join(blocks)))
    assert (w, h, bw, bh) == (11, 7, 4, 4) and [containers.constant_block(b)[0] for b in back] == list(range(6))
    raw = containers.write_slice_file({"images": 1, "us_per_frame": 33333}, [({"level": i, "blocks_x": 4}, bytes([i]) * 9) for i in range(3)], b"ends", b"sels", b"tabs")
    head, slices = containers.read_slice_file(raw)
    assert head["us_per_frame"] == 33333 and [s["level"] for s in slices] == [0, 1, 2] and [s["size"] for s in slices] == [9] * 3
    with pytest.raises(ValueError):
        containers.read_slice_file(raw[:-1] + b"x")


def test_source_and_sink(spark, tmp_path):
    pictures = [RNG.integers(0, 256, (4, 6, 4)).astype(np.uint8) for _ in range(3)]
    rows = spark.createDataFrame([(f"p{i}", 6, 4, p.tobytes()) for i, p in enumerate(pictures)], "name string, width int, height int, data binary")
    manifest = datasource.write_images(rows, str(tmp_path / "out"), "png")
    assert manifest.count() == 3
    shutil.rmtree(tmp_path / "out" / "manifest")
    (tmp_path / "out" / "t.ktx2").write_bytes(containers.write_ktx2(texture("BC1", faces=6), True))
    datasource.register(spark)
    found = spark.read.format("texloom").load(str(tmp_path / "out")).collect()
    assert len(found) == 3 + 18 and sorted(bytes(r["data"]) for r in found if r["fmt"] == "RGBA32") == sorted(p.tobytes() for p in pictures)
    again = datasource.decode_files(spark.read.format("binaryFile").load(str(tmp_path / "out" / "*.png")))
    assert sorted(bytes(r["data"]) for r in again.collect()) == sorted(p.tobytes() for p in pictures)


@pytest.mark.parametrize("n", range(2, 13))
def test_transforms_invert(n):
    x = RNG.normal(size=(3, n, n))
    assert np.allclose(transforms.inverse_transform(transforms.forward_transform(x)), x)
    assert np.allclose(transforms.cosine_matrix(n) @ transforms.cosine_matrix(n).T, np.eye(n))


def test_visual_psnr(spark):
    a = images.swirl(spark, 16, 16)
    assert transforms.visual_psnr(a, a, "g").first()["psnr_hvs"] == 100.0
    near = transforms.visual_psnr(a, a.withColumn("g", F.col("g") + 1), "g").first()
    far = transforms.visual_psnr(a, a.withColumn("g", (F.col("g") / 2).cast("int")), "g").first()
    assert 30 < near["psnr_hvs"] < 60 and far["psnr_hvs"] < near["psnr_hvs"] and far["psnr_hvsm"] >= far["psnr_hvs"]


def test_small_floats(spark):
    v = [0.0, 1.0, -2.5, 65504.0, 1e-7, 3.14159, 1e9, float("inf")]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", transforms.half_bits("v").alias("h"), transforms.bfloat_bits("v").alias("b"))
    rows = rows.withColumn("back", transforms.from_half_bits("h")).withColumn("own", transforms.half_as_expression(F.col("h")))
    for r in rows.collect():
        with np.errstate(over="ignore"):
            assert r["back"] == r["own"] == float(np.float16(r["v"]))
        assert math.isinf(r["v"]) or abs(np.array([r["b"] << 16], np.uint32).view(np.float32)[0] - r["v"]) <= abs(r["v"]) / 250
    rgb = RNG.uniform(0, 1000, (200, 3)) * 10.0 ** RNG.integers(-4, 2, (200, 1))
    packed = transforms.shared_exponent(*rgb.T)
    assert packed.max() < 1 << 32 and (np.abs(transforms.from_shared_exponent(packed) - rgb).max(axis=1) <= rgb.max(axis=1) / 500 + 2**-24).all()


def test_quantizer(spark):
    centers = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9.0]])
    points = [(centers[i % 4] + RNG.normal(0, 0.3, 3)).tolist() for i in range(120)] + [[0.0, 0.0, 0.0]] * 5
    df = spark.createDataFrame([(p, 1 + i % 3) for i, p in enumerate(points)], "v array<double>, w int")
    data, leaves = vq.quantize(df, "v", "w", 4)
    rows = data.collect()
    assert len(leaves) == 4 and sum(r["members"] for r in rows) == 125 and len(rows) == 121
    assert sum(leaf.weight for leaf in leaves) == sum(1 + i % 3 for i in range(125))
    for leaf in leaves:
        assert min(np.linalg.norm(centers - leaf.center, axis=1)) < 0.3
    for r in rows:
        assert np.argmin([np.linalg.norm(leaf.center - np.array(r["v"])) for leaf in leaves]) == r["code"]
    one, single = vq.quantize(spark.createDataFrame([([1.0], 1)] * 3, "v array<double>, w int"), "v", "w", 4)
    assert len(single) == 1 and one.count() == 1


def stream_result(spark, df, tmp_path, make, files):
    """Rows of a streaming query fed one file at a time."""
    source = str(tmp_path / "in")
    for i, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"t{abs(hash(str(tmp_path)))}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_skip_blocks_stream_equals_batch(spark, tmp_path):
    from texloom.streaming.frames import skip_blocks

    rng = np.random.default_rng(3)
    rows = [(b, f, str(rng.integers(0, 2))) for f in range(12) for b in range(5)]
    df = spark.createDataFrame(rows, "block long, frame long, sym string")
    found = stream_result(spark, df, tmp_path, lambda s: skip_blocks(s, "block", "frame", "sym"), [df.where((F.col("frame") >= a) & (F.col("frame") < a + 4)) for a in (0, 4, 8)])
    want = ordered.repeats_previous(df, ["block"], ["frame"], "sym").collect()
    assert sorted(map(tuple, found)) == sorted((r["block"], r["frame"], r["sym"], r["skipped"]) for r in want)


def test_lines_stream_equals_batch(spark, tmp_path):
    from texloom.streaming.frames import resample_lines

    rows = [(1, y, [float(y * y), float(y)]) for y in range(8)]
    df = spark.createDataFrame(rows, "image long, y int, line array<double>")
    found = stream_result(spark, df, tmp_path, lambda s: resample_lines(s, "image", "y", "line", 8, 4), [df.where(F.col("y") < 3), df.where(F.col("y") >= 3)])
    matrix = np.zeros((4, 8))
    for i, j, w in images.contributors(8, 4, "tent"):
        matrix[i, j] = w
    want = matrix @ np.array([r[2] for r in rows])
    assert len(found) == 4
    for r in found:
        assert np.allclose(r["values"], want[r["row"]])
