import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import arithmetic, blockcodecs, entropy, frontend, images, vq


def test_half_codes_equal_numpy(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 1.0, -2.5, 65504.0, 65519.9, 65520.0, 1e9, float("inf"), float("-inf"), 2.0**-24, 2.0**-25, 3 * 2.0**-26, 6.1e-5, 2049.0, 2051.0, *map(float, rng.normal(size=500) * 10.0 ** rng.integers(-9, 6, 500))]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(images.half_code(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        want = np.array(values).astype(np.float16).view(np.uint16)
    assert [f & 0x7FFF for f in found] == [int(w) & 0x7FFF for w in want]
    assert all((f >> 15) == (v < 0) for f, v in zip(found, values))
    assert spark.sql("select double('nan') v").select(images.half_code(F.col("v"))).first()[0] == 0x7E00


def test_directional_blur_against_loops(spark):
    rng = np.random.default_rng(1)
    pic = rng.integers(0, 256, (2, 5, 6))
    rows = [(k, x, y, int(pic[k, y, x])) for k in range(2) for y in range(5) for x in range(6)]
    out = arithmetic.directional_blur(spark.createDataFrame(rows, "k int, x int, y int, r int"), ["k"], ["r"], 6, 5, 30.0, 1.0, 0.5)
    weights = arithmetic.directional_weights(30.0, 1.0, 0.5)
    assert math.isclose(sum(w for *_, w in weights), 1.0)
    for r in out.collect():
        want = sum(w * pic[r["k"], min(max(r["y"] + dy, 0), 4), min(max(r["x"] + dx, 0), 5)] for dx, dy, w in weights)
        assert abs(r["r"] - want) < 1e-9
    assert out.count() == 60


def test_similarity_by_key_is_that_of_each_picture(spark):
    pic = images.swirl(spark, 16, 12)
    many = pic.withColumn("k", F.lit(0)).unionByName(pic.withColumn("k", F.lit(1)).withColumn("r", F.expr("r div 64 * 64")))
    plain = pic.crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    found = {r["k"]: r["ssim"] for r in images.ssim(many, plain, "r", 16, 12, ["k"]).collect()}
    coarse = images.ssim(pic.withColumn("r", F.expr("r div 64 * 64")), pic, "r", 16, 12).first()["ssim"]
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(coarse) and coarse < 0.99


def test_palette_keeps_every_symbol(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b", 3), ("b", "a", 3), ("z", "z", 9)], "a string, b string, n long")
    symbols = spark.createDataFrame([("a",), ("b",), ("z",), ("solo",), (None,)], "s string")
    rows = entropy.reorder_palette(pairs, symbols).orderBy("place").collect()
    assert [r["symbol"] for r in rows] == ["a", "b", "solo", "z"]
    assert {r["symbol"] for r in entropy.reorder_palette(pairs).collect()} == {"a", "b", "z"}
    assert [r["symbol"] for r in entropy.reorder_palette(pairs.limit(0), symbols).orderBy("place").collect()] == ["a", "b", "solo", "z"]
    monkeypatch.setattr(entropy, "MOST_PAIRS", 1)
    with pytest.raises(ValueError):
        entropy.reorder_palette(pairs, symbols)


def test_every_byte_is_decoded(spark):
    rng = np.random.default_rng(2)
    values = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 7, 8, 16, 17, 100)]
    df = spark.createDataFrame([*enumerate(values), (8, b""), (9, None)], "k int, data binary")
    found = {(r["k"], r["fmt"]): (r["blocks"], r["mean"]) for r in blockcodecs.decode_every(df, "k", "data").collect()}
    assert {k for k, _ in found} == set(range(len(values)))
    for fmt, (size, decoder) in blockcodecs.DECODERS.items():
        for k, raw in enumerate(values):
            n = -(-len(raw) // size)
            flat = decoder(np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(-1, size))
            assert found[k, fmt] == (n, pytest.approx(flat.reshape(-1).sum() / (64 * n)))


def test_keys(spark):
    rows = [(b"a\0", True), (b"\0", True), (b"", False), (b"a", False), (b"a\0b\0", False), (b"x" * 255 + b"\0", True), (b"x" * 256 + b"\0", False), (None, False)]
    found = spark.createDataFrame(rows, "k binary, want boolean").select(arithmetic.valid_key(F.col("k")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in found)


def test_tonemap_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 0, nan), (1, 1, 0, -3.0), (1, 2, 0, inf), (1, 3, 0, 1e9), (2, 0, 0, 5.0), (2, 1, 0, 5.0)]
    found = arithmetic.half_range_tonemap(spark.createDataFrame(rows, "k int, x int, y int, v double"), ["k"], ["v"]).collect()
    assert {(r["k"], r["x"]): r["v"] for r in found} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 255}


def _colors(base, row):
    return [[min(255, max(0, b + int(m))) for b in base] for m in sorted(blockcodecs.ETC1_MODIFIERS[row])]


def test_endpoints_selectors_and_errors_against_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, *(int(x) for x in np.clip(rng.normal(90 + 20 * k, 8 + 6 * k, 3), 0, 255))) for k in range(5) for i in range(16)]
    texels = spark.createDataFrame(rows, "block int, i int, r int, g int, b int")
    ends = frontend.cluster_endpoints(texels, ["block"])
    chosen = {r["block"]: r for r in ends.collect()}
    vectors = {r["block"]: r for r in frontend.selector_vectors(texels, ends, ["block"]).collect()}
    errors = {r["block"]: r["error"] for r in frontend.block_endpoint_errors(texels, ends, ["block"], "block").collect()}
    for k in range(5):
        own = [r[2:] for r in rows if r[0] == k]
        five = [int(math.floor(np.mean([t[c] for t in own]) * 31 / 255 + 0.5)) for c in range(3)]
        base = [(c << 3) + (c >> 2) for c in five]
        distances = [[[sum((a - b) ** 2 for a, b in zip(t, color)) for color in _colors(base, row)] for t in own] for row in range(8)]
        sums = [sum(min(d) for d in of) for of in distances]
        row = int(np.argmin(sums))
        r = chosen[k]
        assert (r["r5"], r["g5"], r["b5"], r["row"], r["error"], r["texels"]) == (*five, row, sums[row], 16) and errors[k] == sums[row]
        assert vectors[k]["v"] == [float(np.argmin(d)) for d in distances[row]]
        colors = _colors(base, row)
        assert vectors[k]["w"] == max(1, min(4096, sum((a - b) ** 2 for a, b in zip(colors[0], colors[3])) // 300))
    ready = frontend.endpoint_vectors(ends, ["block"]).collect()
    assert len(ready) == 10 and all(len(r["v"]) == 6 and r["w"] == 1 for r in ready)
    labels, book = frontend.hierarchical_codebook(spark.createDataFrame(ready), "v", "w", 4, 2)
    assert {r["parent"] for r in book.collect()} <= {0, 1} and labels.agg(F.sum("members")).first()[0] == 10


def test_remapped_endpoints(spark):
    rows = [(k, i, 10 * k, 5, 200) for k in range(4) for i in range(4)]
    texels = spark.createDataFrame(rows, "cluster int, i int, r int, g int, b int")
    remap = spark.createDataFrame([(0, 7), (1, 7), (2, 9), (3, 9), (4, 11)], "old int, new int")
    ends, ids = frontend.remapped_endpoints(texels, remap, "cluster")
    assert {r["cluster"]: r["texels"] for r in ends.collect()} == {0: 8, 1: 8}
    assert {r["old"]: r["new"] for r in ids.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: None}


def test_quantizer_passes_grow_with_depth(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [([float(x) for x in v], 1) for v in rng.normal(size=(2000, 3))]
    df = spark.createDataFrame(rows, "v array<double>, w int")
    passes = []
    monkeypatch.setattr(vq, "_sums", lambda *a, own=vq._sums: (passes.append(1), own(*a))[1])
    data, leaves = vq.quantize(df, "v", "w", 64)
    assert len(leaves) == 64 and len(passes) < 7 * 20
    found = data.collect()
    assert sum(r["members"] for r in found) == 2000 and {r["code"] for r in found} == set(range(64))
    assert vq.truncated(leaves, 1) == [0] * 64 and vq.truncated(leaves, 64) == list(range(64))
    total = sum(leaf.error for leaf in leaves)
    again = sum(float(((np.array(r["v"]) - leaves[r["code"]].center) ** 2).sum()) for r in found)
    assert abs(total - again) < 1e-6 * total
