"""Filters by whole pictures and strips: results, and plans that shuffle each texel once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import arithmetic, filters, images, ingest

W, H = 13, 11


def steps_of(df):
    """How often each kind of step stands in the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()
    return {k: plan.count(k) for k in ("MapInArrow", "Join", "Aggregate", "Union", "Generate")}


@pytest.fixture(scope="module")
def odd(spark):
    """Pictures with missing and double texels, texels outside, nulls, NaN and a null key."""
    rng, rows = np.random.default_rng(0), []
    for k in (0, 1, 2, None):
        for x in range(-2, W + 2):
            for y in range(-1, H + 1):
                u, v = rng.random(), float(rng.integers(0, 256))
                if k == 1 and u < 0.5:
                    continue
                rows.append((k, x, y, None if k == 2 and u < 0.3 else v, float("nan") if k == 2 and u > 0.97 else float(rng.normal())))
                if k == 1 and u > 0.8:
                    rows.append((k, x, y, 3.0, 1.0))
    return rows, spark.createDataFrame(rows, "k long, x int, y int, v double, g double")


def rows_of(df):
    near = lambda c: ("nan" if c != c else round(c, 8)) if isinstance(c, float) else c
    return sorted((tuple(near(c) for c in r) for r in df.collect()), key=repr)


def sums(parts):
    """Key -> sums of (key, values), without nulls."""
    out = {}
    for key, values in parts:
        old = out.setdefault(key, [None] * len(values))
        out[key] = [a if b is None else b if a is None else a + b for a, b in zip(old, values, strict=True)]
    return out


def same(df, want):
    got = {tuple(r)[:-2]: list(r)[-2:] for r in df.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values, strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, nan_ok=True)


@pytest.mark.parametrize("unit", [filters.UNIT, 40])
def test_directional_blur(odd, monkeypatch, unit):
    monkeypatch.setattr(filters, "UNIT", unit)
    rows, df = odd
    kernel = arithmetic.directional_weights(30.0, 1.0, 0.5)
    at = sums(((r[0], r[1], r[2]), r[3:]) for r in rows if 0 <= r[1] < W and 0 <= r[2] < H)
    parts = []
    for k, x, y, *_ in rows:
        for dx, dy, weight in kernel if k is not None else ():
            if (values := at.get((k, min(max(x + dx, 0), W - 1), min(max(y + dy, 0), H - 1)))) is not None:
                parts.append(((k, x, y), [None if v is None else v * weight for v in values]))
    out = arithmetic.directional_blur(df, ["k"], ["v", "g"], W, H, 30.0, 1.0, 0.5)
    same(out, sums(parts))
    assert steps_of(out)["Join"] == steps_of(out)["Aggregate"] == 0


@pytest.mark.parametrize("unit", [filters.UNIT, 40])
def test_convolution(odd, monkeypatch, unit):
    monkeypatch.setattr(filters, "UNIT", unit)
    rows, df = odd
    weights = images.gaussian_weights(5, 1.2)
    part = [((r[0], r[1], r[2]), r[3:]) for r in rows if 0 <= r[1] < W and 0 <= r[2] < H]
    for axis, n in ((1, W), (2, H)):
        moved = []
        for key, values in sums(part).items():
            for to in range(n):
                weight = sum(v for k, v in enumerate(weights) if min(max(to + k - 2, 0), n - 1) == key[axis])
                if weight:
                    moved.append(((*key[:axis], to, *key[axis + 1 :]), [None if v is None else v * weight for v in values]))
        part = moved
    out = images.convolve(df, ["k"], ["v", "g"], W, H, weights)
    same(out, sums(part))
    assert steps_of(out)["Join"] == steps_of(out)["Aggregate"] == 0


def test_mips_in_one_pass(odd, monkeypatch):
    _, df = odd
    out = images.mip_chain(df, ["v", "g"], W, H, "box", ["k"])
    found = rows_of(out)
    plan = steps_of(out)
    assert plan["Join"] == plan["Aggregate"] == plan["Union"] == 0 and plan["MapInArrow"] == 2
    one = rows_of(images.resample(df, ["k"], ["v", "g"], W, H, W >> 1, H >> 1, "box"))
    assert [(r[0], *r[2:]) for r in found if r[1] == 1] == one
    assert len([r for r in found if r[1] == 0]) == df.count() and {r[1] for r in found} == {0, 1, 2, 3}
    assert rows_of(images.mip_chain(df, ["v", "g"], W, H, "box", ["k"], 2)) == [r for r in found if r[1] < 2]
    monkeypatch.setattr(filters, "UNIT", 40)
    assert rows_of(images.mip_chain(df, ["v", "g"], W, H, "box", ["k"])) == found


def _slices(spark, parts=True):
    df = spark.range(2 * 6 * 5).select(*[F.expr(e) for e in ("id div 30 image", "int(id % 6) x", "int(id % 30 div 6) y", "id % 251 r", "id * 7 % 256 g", "id * 5 % 256 b", "id * 3 % 256 a")])
    return ingest.slices(df, 6, 5, ingest.Preparation(mips=True, smallest=2, split_alpha=parts))


@pytest.mark.parametrize("parts", [True, False])
def test_texels_of_all_slices_in_one_pass(spark, parts):
    texels, _ = _slices(spark, parts)
    # pass and plan: once each in the physical and in the optimized plan; the split by pictures' own alpha reads twice
    assert steps_of(texels)["MapInArrow"] == (2 if parts else 4) and steps_of(texels)["Union"] == 0
    found = {}
    for r in texels.collect():
        found.setdefault((r["level"], r["alpha"]), []).append(r)
    assert {k: len(v) for k, v in found.items()} == ({(n, a): 2 * t for n, t in ((0, 64), (1, 16), (2, 16)) for a in (False, True)} if parts else {(0, True): 128, (1, True): 32, (2, True): 32})


def test_slice_table_without_a_filter(spark):
    _, table = _slices(spark)
    assert table.count() == 12 and steps_of(table)["MapInArrow"] == 0
