import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from texloom import api
from texloom.operators import bitstream, images
from texloom.sources import containers, exr


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=300))
def test_symbol_streams(symbols):
    assert bitstream.decode_symbols(bitstream.encode_symbols(symbols, 61)) == symbols


@given(st.lists(st.integers(0, 16), min_size=1, max_size=400))
def test_length_runs(lengths):
    out = []
    kinds = {k[0]: k for k in (bitstream.ZERO_SHORT, bitstream.ZERO_LONG, bitstream.REPEAT_SHORT, bitstream.REPEAT_LONG)}
    for s, extra, _ in bitstream._runs(lengths):
        out += [0 if s < 19 else out[-1]] * (kinds[s][1] + extra) if s in kinds else [s]
    assert out == lengths


@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 9)), max_size=40))
def test_simple_codes(values):
    w = bitstream.BitWriter()
    sizes = [(w.rice(v, m), w.chunked(v, m), w.truncated(v, 3001)) for v, m in values]
    r = bitstream.BitReader(w.bytes())
    assert [(r.rice(m), r.chunked(m), r.truncated(3001)) for _, m in values] == [(v, v, v) for v, _ in values]
    assert all(a == (v >> m) + 1 + m for (a, _, _), (v, m) in zip(sizes, values))


def test_streams_by_stripe(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("s"), F.expr("id div 3").alias("i"), (F.col("id") * 7 % 11).cast("int").alias("sym"))
    found = bitstream.code_streams(rows, "s", "i", "sym", 11, 100).collect()
    assert len(found) == 12 and all(r["same"] for r in found) and sum(r["symbols"] for r in found) == 1000


@pytest.mark.parametrize("half", [True, False])
@pytest.mark.parametrize("compress", [True, False])
def test_exr(half, compress):
    p = np.random.default_rng(1).uniform(0, 9, (37, 5, 4)).astype(np.float16 if half else np.float32).astype(np.float32)
    assert (exr.read_exr(exr.write_exr(p, half, compress)) == p).all()
    three = exr.read_exr(exr.write_exr(p[..., :3], half, compress))
    assert (three[..., :3] == p[..., :3]).all() and (three[..., 3] == 1).all()


def test_facade(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, (w, h) in enumerate(((5, 7), (8, 4), (1, 1))):
        base = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[..., None] + rng.integers(0, 100, (1, 1, 4))
        rows.append((f"p{i}", "RGBA32", w, h, np.clip(base, 0, 255).astype(np.uint8).tobytes()))
    df = spark.createDataFrame(rows, "name string, fmt string, width int, height int, data binary")
    want = {r[0]: np.frombuffer(r[4], np.uint8).astype(int) for r in rows}
    packed = api.compress(df, "BC3", ["name"])
    assert all(len(r["data"]) == 16 * -(-r["width"] // 4) * -(-r["height"] // 4) for r in packed.collect())
    for r in api.decode_rgba(packed, ["name"]).collect():
        assert np.abs(np.frombuffer(r["data"], np.uint8).astype(int) - want[r["name"]]).mean() < 4
    for r in api.pack(api.transcode(packed, "BC1", ["name"]), "ktx2", ["name"]).collect():
        t = containers.read_ktx2(bytes(r["data"]))
        assert (t.fmt, t.width, t.height) == ("BC1", r["width"], r["height"])
    assert api.transcode(df.limit(0), "BC5", ["name"]).count() == 0


def test_text_grid(spark):
    picture = images.swirl(spark, 7, 5).select("x", "y", "r", "g")
    back = api.from_text_grid(api.text_grid(picture, ["r", "g"]), ["r", "g"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in picture.collect()}
    odd = spark.createDataFrame([(0, "1 2, x 300,  7")], "y int, value string")
    assert [tuple(r) for r in api.from_text_grid(odd, ["r", "g"]).orderBy("x").collect()] == [(0, 0, 1, 2), (1, 0, None, None), (2, 0, 7, None)]
