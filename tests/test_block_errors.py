import numpy as np
import pytest

from texloom.operators import blockcodecs


def _flat(t):
    return [[int(x) for x in row] for row in t.reshape(len(t), -1)]


def test_alpha_blocks_near_the_best_of_all(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full((3, 16), [[0], [131], [255]]), rng.integers(0, 256, (2, 16)), np.clip(rng.normal(120, 12, (4, 16)), 0, 255).astype(int), rng.choice([0, 255], (2, 16))])
    raw = blockcodecs.encode_eac_a8(v)
    again = blockcodecs.decode_eac_a8_values(raw).astype(int)
    errors = ((again - v) ** 2).sum(axis=1)
    assert (errors[:3] == 0).all()
    for values, error in zip(v, errors):
        best = 1 << 40
        for steps in blockcodecs.EAC_MODIFIERS:
            for mul in range(1, 16):
                levels = np.clip(np.arange(256)[:, None] + steps * mul, 0, 255)
                off = np.abs(values[None, :, None] - levels[:, None]).min(axis=2)
                best = min(best, int((off**2).sum(axis=1).min()))
        assert error <= max(1.25 * best, best + 16)


def test_alpha_blocks_through_tables(spark):
    t = np.random.default_rng(2).integers(60, 90, (20, 16, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(_flat(t))], "k int, texels array<int>")
    rows = blockcodecs.decode_blocks(blockcodecs.encode_blocks(df, "texels", "EAC_A8"), "block", "EAC_A8", "again").collect()
    for r in rows:
        assert np.abs(np.array(r["again"]).reshape(16, 4)[:, 3] - t[r["k"], :, 3]).max() <= 4


@pytest.mark.parametrize("half", [None, 0, 1])
def test_block_errors_against_loops(spark, half):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 256, (40, 16, 4))
    raw = rng.integers(0, 256, (40, 8)).astype(np.uint8)
    decoded = blockcodecs.decode_etc1(raw).astype(int)
    df = spark.createDataFrame([(i, x, bytes(b)) for i, (x, b) in enumerate(zip(_flat(t), raw))], "k int, texels array<int>, block binary")
    plain = {r["k"]: r["error"] for r in blockcodecs.block_error(df, "block", "texels", "ETC1", half=half).collect()}
    seen = {r["k"]: r["error"] for r in blockcodecs.block_error(df, "block", "texels", "ETC1", perceptual=True, half=half).collect()}
    for k in range(40):
        flip = raw[k, 3] & 1
        inside = [i for i in range(16) if half is None or (i // 8 if flip else i % 4 // 2) == half]
        assert plain[k] == sum(int(((t[k, i, :3] - decoded[k, i, :3]) ** 2).sum()) for i in inside)
        total = 0
        for i in inside:
            r, g, b = (int(x) for x in t[k, i, :3] - decoded[k, i, :3])
            luma = 27 * r + 92 * g + 9 * b
            cr, cb = r * 128 - luma, b * 128 - luma
            total += (luma * luma >> 7) + ((cr * cr >> 7) * 26 >> 7) + ((cb * cb >> 7) * 3 >> 7)
        assert seen[k] == total


def test_halves_are_of_one_format(spark):
    df = spark.createDataFrame([(bytes(8), [0] * 64)], "block binary, texels array<int>")
    with pytest.raises(ValueError):
        blockcodecs.block_error(df, "block", "texels", "BC1", half=0)
