import numpy as np
import pytest

from texloom.operators import images, ingest

W, H = 6, 5


def pictures(spark, count, seed, alpha=True):
    rng = np.random.default_rng(seed)
    pics = rng.integers(0, 256, (count, H, W, 4))
    if not alpha:
        pics[..., 3] = 255
    rows = [(k, x, y, *map(int, pics[k, y, x])) for k in range(count) for y in range(H) for x in range(W)]
    return pics, spark.createDataFrame(rows, "image int, x int, y int, r int, g int, b int, a int")


def arrays(texels, w, h):
    out = {}
    for r in texels.collect():
        out.setdefault((r["image"], r["level"], r["alpha"]), np.full((h, w, 4), -1))[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    return out


def test_slices_of_color_and_alpha(spark):
    pics, df = pictures(spark, 2, 1)
    texels, table = ingest.slices(df, W, H, ingest.Preparation(swizzle=("g", "r", "b", "a"), flip=True))
    found = arrays(texels, 8, 8)
    assert found.keys() == {(k, 0, flag) for k in range(2) for flag in (False, True)}
    for k in range(2):
        want = np.pad(pics[k, ::-1], ((0, 3), (0, 2), (0, 0)), mode="edge")
        assert (found[k, 0, False][..., :3] == want[..., [1, 0, 2]]).all() and (found[k, 0, False][..., 3] == 255).all()
        assert (found[k, 0, True] == np.concatenate([want[..., 3:]] * 3 + [np.full((8, 8, 1), 255)], axis=2)).all()
    rows = sorted(tuple(r) for r in table.collect())
    assert rows == [(k, i, 0, bool(i), W, H, 8, 8, 2, 2, 4 * i) for k in range(2) for i in range(2)]


def test_pictures_without_alpha_have_one_slice(spark):
    _, df = pictures(spark, 1, 2, alpha=False)
    texels, table = ingest.slices(df, W, H, ingest.Preparation())
    assert [tuple(r) for r in table.collect()] == [(0, 0, 0, False, W, H, 8, 8, 2, 2, 0)] and texels.count() == 64
    texels, table = ingest.slices(df, W, H, ingest.Preparation(swizzle=("r", "r", "r", "g")))
    assert table.count() == 2


def test_alpha_of_another_picture_and_unsplit_slices(spark):
    _, df = pictures(spark, 2, 3, alpha=False)
    light = spark.createDataFrame([(0, 1, 1, 255, 255, 255), (0, 2, 1, 0, 255, 0)], "image int, x int, y int, r int, g int, b int")
    texels, table = ingest.slices(df, W, H, ingest.Preparation(split_alpha=False), light)
    found = arrays(texels, 8, 8)
    assert found[0, 0, True][1, 1, 3] == 255 and found[0, 0, True][1, 2, 3] == (46869 * 255 + 32768) >> 16 and found[1, 0, True][0, 0, 3] == 0
    assert {(r["image"], r["alpha"]) for r in table.collect()} == {(0, True), (1, True)}


def test_resampled_levels(spark):
    pics, df = pictures(spark, 1, 4)
    texels, table = ingest.slices(df, W, H, ingest.Preparation(size=(8, 8), kernel="tent", mips=True, smallest=2))
    assert [(r["level"], r["orig_w"], r["w"], r["first_block"]) for r in sorted(table.collect(), key=lambda r: r["slice_idx"])] == [
        (0, 8, 8, 0), (0, 8, 8, 4), (1, 4, 4, 8), (1, 4, 4, 9), (2, 2, 4, 10), (2, 2, 4, 11),
    ]
    whole = images.resample(df, ["image"], ["r"], W, H, 8, 8, "tent").collect()
    found = arrays(texels, 8, 8)
    for r in whole:
        assert found[0, 0, False][r["y"], r["x"], 0] == min(255, max(0, int(np.floor(r["r"] + 0.5))))
    assert ingest.level_sizes(32, 5, 1) == [(32, 5), (16, 2), (8, 1), (4, 1), (2, 1), (1, 1)]


def test_no_pictures_and_too_large_ones(spark):
    _, df = pictures(spark, 1, 5)
    texels, table = ingest.slices(df.where("false"), W, H, ingest.Preparation())
    assert texels.count() == table.count() == 0
    with pytest.raises(ValueError):
        images.resample(df, ["image"], ["r"], W, H, images.MOST_SIDE + 1, 4)
