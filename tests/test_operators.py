"""Operators against plain Python and against identities."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from texloom.functions import colors, integers, paths
from texloom.operators import entropy, images, joins, ordered, sets, stats


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60))
def test_code_lengths_make_a_prefix_code(freqs):
    lengths = entropy.code_lengths(freqs, 16)
    used = [n for n in lengths if n]
    assert sum(2.0**-n for n in used) <= 1
    if len(used) > 1:
        total = sum(freqs)
        entropy_bits = -sum(f * math.log2(f / total) for f in freqs if f)
        assert entropy_bits - 1e-6 <= sum(f * n for f, n in zip(freqs, lengths)) < entropy_bits + total
    codes = {(n, c) for n, c in zip(lengths, entropy.canonical_codes(lengths)) if n}
    assert len(codes) == len(used)
    strings = sorted(f"{c:0{n}b}" for n, c in codes)
    assert not any(b.startswith(a) for a, b in zip(strings, strings[1:]))


def test_code_lengths_limit():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = entropy.code_lengths(fib, 8)
    assert max(lengths) <= 8 and sum(2.0**-n for n in lengths) <= 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.binary(max_size=3000), max_size=6))
def test_blobs_round_trip(blobs):
    assert entropy.unpack_blobs(entropy.pack_blobs(blobs)) == blobs


@given(st.integers(0, 1 << 60))
def test_varint(value):
    raw = entropy.varint(value)
    assert entropy.read_varint(raw, 0) == (value, len(raw))


def test_crc16_sees_every_bit():
    raw = bytes(range(40))
    assert len({entropy.crc16_of(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :]) for i in range(40)}) == 40
    assert entropy.crc16_of(b"123456789") == 0xD64E


@pytest.mark.parametrize("name", images.FILTERS)
@pytest.mark.parametrize("boundary", ["clamp", "wrap", "reflect"])
def test_contributors_sum_to_one(name, boundary):
    for n, m in ((16, 7), (7, 16), (1, 3), (9, 1)):
        rows = images.contributors(n, m, name, boundary=boundary)
        for i in range(m):
            assert math.isclose(sum(w for d, _, w in rows if d == i), 1.0, abs_tol=1e-9)
        assert all(0 <= j < n for _, j, _ in rows)


def test_hashes(spark):
    rng = random.Random(1)
    values = [0, 1, 0xFFFFFFFF, *[rng.randrange(1 << 32) for _ in range(50)]]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", integers.mixing_hash(F.col("v")).alias("m"), integers.wang_hash(F.col("v")).alias("w")).collect()

    def wang(v):
        m = 0xFFFFFFFF
        v = (v ^ 61) ^ (v >> 16)
        v = v * 9 & m
        v ^= v >> 4
        v = v * 0x27D4EB2D & m
        return v ^ (v >> 15)

    assert all(r["w"] == wang(r["v"]) for r in rows)
    assert len({r["m"] for r in rows}) == len(values) and all(0 <= r["m"] < 1 << 32 for r in rows)


def test_scalars(spark):
    v = F.col("v")
    rows = spark.createDataFrame([(i,) for i in range(300)], "v long").select(
        "v", integers.leading_zeros32(v).alias("z"), integers.next_power_of_two(v + 1).alias("p"), integers.chunked_bits(v, 4).alias("c"), integers.varint_bytes(v).alias("b"), integers.interleave(v, v, 9).alias("i")
    )
    for r in rows.collect():
        n = r["v"].bit_length()
        assert r["z"] == 32 - n and r["p"] == 1 << r["v"].bit_length() and r["c"] == max(1, -(-n // 4)) * 5
        assert r["b"] == len(entropy.varint(r["v"]))
        assert r["i"] == sum((r["v"] >> k & 1) * (3 << 2 * k) for k in range(9))


def test_paths(spark):
    row = spark.createDataFrame([("a/b.c/d.tar.EXR",)], "p string").select(
        paths.extension(F.col("p")).alias("e"), paths.without_extension(F.col("p")).alias("s"), paths.directory(F.col("p")).alias("d"), paths.is_hdr_name(F.col("p")).alias("h"), paths.find_last(F.col("p"), ".").alias("l")
    ).first()
    assert tuple(row) == ("EXR", "a/b.c/d.tar", "a/b.c/", True, 11)


def test_color_round_trip(spark):
    v = F.col("v")
    rows = spark.range(256).select(F.col("id").alias("v")).select("v", colors.transform_byte(colors.linear_to_srgb(colors.srgb_to_linear(v / 255.0)) * 255.0, lambda x: x).alias("back"))
    assert all(r["v"] == r["back"] for r in rows.collect())


def test_runs_restore_the_stream(spark):
    rng = random.Random(2)
    stream = [(s, i, rng.choice("ab")) for s in range(3) for i in range(50)]
    found = ordered.runs(spark.createDataFrame(stream, "s int, i int, sym string"), ["s"], ["i"], "sym").orderBy("s", "first_at").collect()
    assert [(r["s"], r["sym"]) for r in found for _ in range(r["length"])] == [(s, c) for s, _, c in stream]


def test_tails_small_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 3)], "k string, v double, id int")
    found = {r["k"]: (r["median"], r["low_tail"], r["high_tail"]) for r in stats.tails(rows, ["k"], "v", ["id"]).collect()}
    assert found == {"a": (1.5, 1.0, 2.0), "b": (5.0, 5.0, 5.0)}


def test_psnr_of_equal_rows(spark):
    rows = spark.createDataFrame([(0.0,), (0.0,)], "d double").agg(*stats.compare_stats(F.col("d")))
    assert rows.first()["psnr"] == 100.0
    assert spark.createDataFrame([(120.0,)], "p double").agg(stats.average_psnr(F.col("p")).alias("p")).first()["p"] == 100.0


def test_nearest_code_ties_and_limits(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<double>")
    codes = spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [2.0, 2.0])], "code int, c array<double>")
    assert joins.nearest_code(rows, codes, "id", "v", "code", "c").first()["code"] == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double, id int")
    assert stats.entropy_bits(none, ["k"], "v").count() == 0
    assert ordered.runs(none, ["k"], ["id"], "v").count() == 0
    assert sets.weighted_distinct(none, ["k"], "v").count() == 0


def test_blocks_round_trip(spark):
    picture = images.swirl(spark, 10, 7)
    back = images.unblock(images.blockify(picture, [], "x", "y", ["r", "g"]), [], ["r", "g"], 10, 7)
    # border blocks of a picture that is no multiple of 4 hold fewer texels; pad first for full ones
    padded = images.pad(picture, [], 10, 7, 12, 8)
    full = images.unblock(images.blockify(padded, [], "x", "y", ["r", "g"]), [], ["r", "g"], 10, 7)
    want = {tuple(r) for r in picture.select("x", "y", "r", "g").collect()}
    assert {tuple(r) for r in full.collect()} == want
    assert back.count() <= 70 and padded.count() == 96


def test_geometry(spark):
    picture = images.swirl(spark, 6, 5)
    assert {tuple(r) for r in images.flip_y(images.flip_y(picture, 5), 5).collect()} == {tuple(r) for r in picture.collect()}
    cut = images.crop(picture, 2, 1, 3, 2)
    assert cut.count() == 6 and images.blit(picture, cut, 2, 1, ["r", "g", "b", "a"]).exceptAll(picture.select("x", "y", "r", "g", "b", "a")).isEmpty()


def test_resample_keeps_constants_and_matches_numpy(spark):
    picture = images.swirl(spark, 8, 8)
    same = images.resample(picture.withColumn("r", F.lit(7.0)), [], ["r"], 8, 8, 5, 3, "mitchell").collect()
    assert len(same) == 15 and all(math.isclose(r["r"], 7.0, abs_tol=1e-9) for r in same)
    raw = np.zeros((8, 8))
    for r in picture.collect():
        raw[r["y"], r["x"]] = r["g"]
    matrix = np.zeros((4, 8))
    for i, j, w in images.contributors(8, 4, "lanczos3"):
        matrix[i, j] = w
    want = matrix @ raw @ matrix.T
    for r in images.resample(picture, [], ["g"], 8, 8, 4, 4, "lanczos3").collect():
        assert math.isclose(r["g"], want[r["y"], r["x"]], abs_tol=1e-9)


def test_mips_and_ssim(spark):
    picture = images.swirl(spark, 8, 4)
    chain = images.mip_chain(picture, ["r"], 8, 4)
    sizes = {r["level"]: r["n"] for r in chain.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 32, 1: 8, 2: 2, 3: 1}
    assert math.isclose(images.ssim(picture, picture, "r", 8, 4).first()["ssim"], 1.0, abs_tol=1e-9)
    other = picture.withColumn("r", F.lit(255) - F.col("r"))
    assert images.ssim(picture, other, "r", 8, 4).first()["ssim"] < 0.9
