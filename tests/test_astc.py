"""The scalable block format and reuse passes against plain rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import astc, reuse


@pytest.mark.parametrize("kind", range(21))
def test_sequences_round_trip(kind):
    rng = random.Random(kind)
    for count in (1, 2, 5, 7, 16, 18):
        values = [rng.randrange(astc.LEVELS[kind]) for _ in range(count)]
        bits = astc.encode_sequence(values, kind)
        assert bits < 1 << astc.sequence_bits(count, kind) and astc.decode_sequence(bits, count, kind) == values


def test_digits_cover_all_values():
    assert len(set(astc._DIGITS[5])) == 243 and len(set(astc._DIGITS[3])) == 125


@pytest.mark.parametrize("kind", range(4, 21))
def test_color_levels_spread_evenly(kind):
    found = sorted(astc.color_value(v, kind) for v in range(astc.LEVELS[kind]))
    n = astc.LEVELS[kind] - 1
    assert found[0] == 0 and found[-1] == 255 and len(set(found)) == n + 1
    assert all(abs(x - 255 * i / n) <= 2 for i, x in enumerate(found))


@pytest.mark.parametrize("kind", range(12))
def test_weight_levels_spread_evenly(kind):
    found = sorted(astc.weight_value(v, kind) for v in range(astc.LEVELS[kind]))
    n = astc.LEVELS[kind] - 1
    assert found[0] == 0 and found[-1] == 64 and all(abs(x - 64 * i / n) <= 1.5 for i, x in enumerate(found))


def test_packed_block_decodes_to_its_ramp():
    # 4 x 4 grid, range 0..3 (two bits a weight): bits 1:0 = 1, R = 4
    mode = 0b10 | 2 << 5 | 0 << 7
    w, h, kind, dual = astc._block_mode(mode)
    assert (w, h, dual) == (4, 4, False)
    weights = [i % astc.LEVELS[kind] for i in range(16)]
    raw = astc.pack_block(mode, 8, [0, 255, 10, 200, 20, 100], weights)
    out = astc.decode_block(raw, 4, 4)
    for t in range(16):
        x = astc.weight_value(weights[t], kind)
        for c, (a, b) in enumerate(((0, 255), (10, 200), (20, 100))):
            assert abs(int(out[t, c]) - (a * (64 - x) + b * x) / 64) <= 1
        assert out[t, 3] == 255


def test_endpoint_modes():
    assert astc.endpoints(0, [9, 200]) == ([9, 9, 9, 255], [200, 200, 200, 255])
    assert astc.endpoints(6, [100, 50, 200, 128]) == ([50, 25, 100, 255], [100, 50, 200, 255])
    assert astc.endpoints(8, [200, 0, 200, 0, 100, 50])[0] == [25, 25, 50, 255]
    low, high = astc.endpoints(9, [100, 2, 100, 4, 100, 6])
    assert low == [50, 50, 50, 255] and high == [51, 52, 53, 255]
    assert astc.endpoints(11, [0] * 6) is None


def test_constant_and_reserved_blocks():
    from texloom.sources.containers import make_constant_block

    assert (astc.decode_block(make_constant_block((1, 2, 3, 4)), 6, 6) == [1, 2, 3, 4]).all()
    assert astc.decode_block(bytes(16), 4, 4) is None


def test_random_blocks_never_fail(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.bytes(16)) for i in range(400)]
    found = astc.decode_blocks(spark.createDataFrame(rows, "id int, block binary"), "block", 6, 5).collect()
    assert len(found) == 400 and sum(r["texels"] is not None for r in found) > 5
    assert all(len(r["texels"]) == 120 for r in found if r["texels"] is not None)


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_partition_hash_in_the_engine(spark, parts):
    rows = spark.range(40 * 16).select(F.expr("id div 16 * 25").alias("seed"), F.expr("id % 4").alias("x"), F.expr("id div 4 % 4").alias("y"))
    rows = rows.withColumn("p", astc.partition_expression(F.col("seed"), F.col("x"), F.col("y"), parts, True)).collect()
    assert all(r["p"] == astc.partition_of(r["seed"], r["x"], r["y"], parts, True) for r in rows)
    assert {r["p"] for r in rows} == set(range(parts))


def test_window_reuse(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(3) * 40), float(rng.randrange(2) * 40)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    found = {r["i"]: r for r in reuse.window_reuse(df, "i", "v", 20, 0.5, 64).collect()}
    used = {}
    for i, v in rows:
        best, source = 32.0, i
        for j in range(max(0, i - 20), i):
            total = sum((a - b) ** 2 for a, b in zip(used[j][1], v)) + reuse.match_bits((i - j) * 8) * 0.5
            if total < best:
                best, source = total, used[j][0]
        used[i] = (source, dict(rows)[source])
        assert (found[i]["source"], found[i]["cost"]) == (source, best)
    assert sum(found[i]["source"] != i for i in found) > 30


def test_neighbor_reuse(spark):
    rows = [(x, y, [10.0 * (x // 3), 5.0 * y]) for y in range(4) for x in range(6)]
    found = {(r["bx"], r["by"]): r["taken"] for r in reuse.neighbor_reuse(spark.createDataFrame(rows, "bx int, by int, v array<double>"), "by", "bx", "v", 40.0, 60.0).collect()}
    assert found[0, 0] == "own" and found[1, 0] == found[2, 0] == "left" and found[3, 0] == "own" and found[0, 1] == "own"
