import binascii
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import entropy, images, passes


def test_moved_remainders_are_those_of_zero_bytes():
    for rest in (0, 1, 0xFFFF, 0x8123):
        for n in (0, 1, 2, 17, 4095, 4096, 32767, 70001):
            assert passes.moved_remainders(np.array([rest]), np.array([n]))[0] == binascii.crc_hqx(bytes(n), rest)


def test_slice_checksums_equal_those_of_whole_slices(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, None if k == 3 else rng.bytes(int(rng.integers(0, 40)))) for s in (1, 2, None) for k in range(30)] + [(9, 0, None), (10, 0, b"")]
    found = {r["s"]: (r["bytes"], r["crc"]) for r in passes.slice_checksums(spark.createDataFrame(rows, "s int, k int, data binary").repartition(5), ["s"], ["k"], "data").collect()}
    for s in {r[0] for r in rows}:
        whole = b"".join(r[2] or b"" for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]))
        assert found[s] == (len(whole), entropy.crc16_of(whole))
    assert len(found) == 5


def test_high_byte_tonemap_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(k, x, 0, *map(float, rng.lognormal(k, 2, 2))) for k in range(3) for x in range(40)]
    rows += [(5, 0, 0, 0.0, 0.0), (6, 0, 0, -1.0, 2.0), (6, 1, 0, 1.0, 2.0), (7, 0, 0, None, 2.0), (8, 0, 0, float("nan"), 1.0), (9, 0, 0, 70000.0, 1.0), (10, 0, 0, 3.0, 3.0)]
    found = passes.high_byte_tonemap(spark.createDataFrame(rows, "k int, x int, y int, u double, v double"), ["k"], ["u", "v"]).collect()
    got = {(r["k"], r["x"]): (r["u"], r["v"]) for r in found}
    want = {}
    for k in (0, 1, 2, 5, 10):
        own = [r for r in rows if r[0] == k]
        codes = np.array([r[3:] for r in own]).astype(np.float16).view(np.uint16).astype(int) * 2
        high = codes * 2 ** (16 - int(codes.max()).bit_length()) >> 8 if codes.max() else codes
        used = sorted(set(high.reshape(-1).tolist()))
        spread = {h: (i * 255 + (len(used) - 1) // 2) // max(1, len(used) - 1) if len(used) > 1 else i for i, h in enumerate(used)}
        want |= {(k, r[1]): tuple(spread[int(h)] for h in hs) for r, hs in zip(own, high)}
    assert got == want


def _toward_zero(a, b):
    return int(math.trunc(a / b))


def test_flips_against_loops(spark):
    rng = np.random.default_rng(6)
    pic = {k: np.clip(rng.normal(120, 60, (4, 4, 3)) + (rng.normal(0, 50, (4, 1, 3)) if k % 2 else rng.normal(0, 50, (1, 4, 3))), 0, 255).astype(int) for k in range(30)}
    rows = [(k, x, y, *map(int, p[y, x])) for k, p in pic.items() for y in range(4) for x in range(4)] + [(99, 0, 0, 1, 2, 3)]
    blocks = images.blockify(spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int"), ["k"], "x", "y", ["r", "g", "b"])
    got = {r["k"]: r["f"] for r in blocks.select("k", passes.estimated_flip().alias("f")).collect()}

    def half(texels):
        mean = [(int(sum(t[c] for t in texels)) + 4) // 8 for c in range(3)]
        total = 0
        for t in texels:
            gray = _toward_zero(int(sum(t[c] - mean[c] for c in range(3))) + 1, 3)
            total += sum((int(t[c]) - min(255, max(0, mean[c] + gray))) ** 2 for c in range(3))
        return total

    for k, p in pic.items():
        level = half(p[:2].reshape(-1, 3)) + half(p[2:].reshape(-1, 3))
        assert got[k] == (level < half(p[:, :2].reshape(-1, 3)) + half(p[:, 2:].reshape(-1, 3)))
    assert got[99] is None and {got[k] for k in pic} == {True, False}


def test_border_penalty_against_loops(spark):
    rng = np.random.default_rng(8)
    w, h = 14, 9
    pic = rng.integers(0, 256, (h, w, 2))
    pic[:, :6] = 7
    back = pic // 3 * 3
    table = lambda p: spark.createDataFrame([(1, x, y, *map(int, p[y, x])) for y in range(h) for x in range(w)], "k int, x int, y int, r int, g int")
    got = {(r["bx"], r["by"]): r["penalty"] for r in passes.border_penalty(table(pic), table(back), ["k"], ["r", "g"]).collect()}
    want = {}
    for by in range(2):
        for bx in range(3):
            own = new = 0
            for y in range(by * 6, min(h, by * 6 + 6)):
                for x in range(bx * 6, min(w, bx * 6 + 6)):
                    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                        ox, oy = x + dx, y + dy
                        if 0 <= ox < w and 0 <= oy < h and (ox // 6, oy // 6) != (bx, by):
                            own += ((pic[oy, ox] - pic[y, x]) ** 2).sum()
                            new += ((pic[oy, ox] - back[y, x]) ** 2).sum()
            want[bx, by] = abs((new - own) / own) if own else 0.0
    assert got == pytest.approx(want)
    same = passes.border_penalty(table(pic), table(pic), ["k"], ["r", "g"]).agg(F.max("penalty")).first()[0]
    assert same == 0


def test_strips(spark):
    rows = [(0, True, False), (1, True, False), (15, True, False), (16, True, False), (500, True, False), (500, True, True), (500, False, False), (7, False, False), (None, True, False)]
    df = spark.createDataFrame(rows, "n int, rate boolean, one boolean")
    got = [tuple(r) for r in df.select(*passes.strip_sizes(F.col("n"), F.col("rate"), 16, F.col("one"))).collect()]
    assert got == [(None, None), (1, 1), (1, 15), (8, 2), (36, 14), (1, 500), (17, 30), (4, 2), (None, None)]


def test_symbol_groups_share_one_code(spark):
    rows = [(1, k, s) for k, s in enumerate([1, 2, 3, 1, 2])] + [(2, 0, 1), (2, 1, 2)]
    found = {r["value"]: (r["freq"], r["length"]) for r in passes.symbol_group_codes(spark.createDataFrame(rows, "u int, k int, s int"), ["u"], ["k"], "s", 2, 2).collect()}
    assert found == {1 + 2 * 4: (2, 1), 3 + 1 * 4: (1, 2), 2: (1, 2)}
    with pytest.raises(ValueError):
        passes.symbol_group_codes(spark.createDataFrame(rows, "u int, k int, s int"), ["u"], ["k"], "s", 6, 3)


def test_consistent_inputs(spark):
    rows = [
        ((True, 2, 0, 0, 0, 0), True),
        ((True, 0, 0, 0, 0, 0), False),
        ((True, 2, 1, 0, 0, 0), False),
        ((True, 2, 0, 0, 0, 3), False),
        ((False, 1, 1, 0, 0, 0), False),
        ((False, 0, 1, 2, 0, 0), True),
        ((False, 0, 1, 0, 1, 0), False),
        ((False, 0, 1, 0, 0, 1), False),
        ((False, 0, 0, 0, 1, 1), True),
        ((False, 0, 0, 1, 1, 0), False),
        ((False, 0, 0, 0, 0, 0), False),
        ((None, 0, 1, 0, 0, 0), True),
    ]
    df = spark.createDataFrame([(*a, b) for a, b in rows], "f boolean, n int, a int, b int, c int, d int, want boolean")
    assert all(r[0] == r[1] for r in df.select(passes.consistent_inputs(*map(F.col, "fnabcd")), "want").collect())


def test_animation(spark):
    rows = [(bytes([4, 1, 0, 0, 30, 0, 0, 0, 255, 255, 255, 255]),), (b"short",), (None,), (b"",)]
    assert [tuple(r) for r in spark.createDataFrame(rows, "d binary").select(*passes.animation(F.col("d"))).collect()] == [(260, 30, 2**32 - 1), *[(None,) * 3] * 3]
