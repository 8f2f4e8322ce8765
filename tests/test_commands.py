import shutil

import numpy as np

from texloom import __main__ as commands
from texloom import schema
from texloom.sources import containers, rasters


def test_schemas(spark):
    assert "blocks" in schema.names() and schema.schema("training").fieldNames() == ["vec_id", "features", "weight"]
    assert all(schema.schema(n).fields for n in schema.names())


def test_commands(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    base = (np.add.outer(np.arange(8), np.arange(8)) * 8)[..., None] + np.array([0, 20, 40, 255])
    p = np.clip(base, 0, 255).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(rasters.write_png(p))
    (tmp_path / "b.tga").write_bytes(rasters.write_tga(np.clip(p.astype(int) + 4, 0, 255).astype(np.uint8)))
    (tmp_path / "bad.dds").write_bytes(rng.bytes(200))
    (tmp_path / "x.slices").write_bytes(containers.write_slice_file({"images": 1}, [({"orig_width": 8, "orig_height": 4}, b"data")]))
    a, b, bad, sliced = (str(tmp_path / n) for n in ("a.png", "b.tga", "bad.dds", "x.slices"))
    listing = tmp_path / "list.txt"
    listing.write_text(f"# files\n{a}\n\n{b}\n")
    assert commands.main(["info", f"@{listing}", sliced]) == 0
    assert commands.main(["validate", a, bad]) == 1
    assert "not a DDS file" in capsys.readouterr().out
    assert commands.main(["compare", a, b]) == 0 and "psnr" in capsys.readouterr().out
    assert commands.main(["stats", a]) == 0 and commands.main(["sizes", a, b]) == 0
    assert commands.main(["sweep", "--csv", str(tmp_path / "sweep")]) == 0
    assert spark.read.csv(str(tmp_path / "sweep"), header=True).count() == 210
    out = tmp_path / "out"
    assert commands.main(["export", a, "--to", str(out), "--kind", "ktx2", "--format", "BC1"]) == 0
    shutil.rmtree(out / "manifest")
    files = list(out.iterdir())
    assert len(files) == 1 and containers.read_ktx2(files[0].read_bytes()).fmt == "BC1"
    again = tmp_path / "again"
    assert commands.main(["unpack", str(files[0]), "--to", str(again), "--kind", "png"]) == 0
    found = [f for f in again.iterdir() if f.suffix == ".png"]
    assert np.abs(rasters.read_png(found[0].read_bytes()).astype(int) - p).mean() < 6
    assert commands.main(["queries"]) == 0


def test_files_of_one_name_are_kept_apart(spark, tmp_path, capsys):
    for folder, value in (("one", 10), ("two", 60)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.png").write_bytes(rasters.write_png(np.full((3, 5, 4), value, np.uint8)))
    (tmp_path / "one" / "ba.png").write_bytes(rasters.write_png(np.full((3, 5, 4), 200, np.uint8)))
    one, two, other = (str(tmp_path / n) for n in ("one/a.png", "two/a.png", "one/ba.png"))
    assert commands.main(["compare", one, two]) == 0
    out = capsys.readouterr().out
    assert "50.0" in out and "190.0" not in out and "140.0" not in out
    assert commands.main(["compare", one, other]) == 0 and "190.0" in capsys.readouterr().out


def test_float_and_jpeg_sources(spark, tmp_path):
    from texloom.sources import datasource, exr

    rng = np.random.default_rng(3)
    p = rng.random((4, 6, 3)).astype(np.float32)
    (tmp_path / "a.hdr").write_bytes(rasters.write_radiance(p))
    (tmp_path / "b.exr").write_bytes(exr.write_exr(p, half=False))
    datasource.register(spark)
    rows = {r["path"].rpartition("/")[2]: r for r in spark.read.format("texloom").load(str(tmp_path)).collect()}
    for name, near in (("a.hdr", 0.01), ("b.exr", 1e-6)):
        r = rows[name]
        found = np.frombuffer(r["data"], "<f4").reshape(r["height"], r["width"], 4)
        assert r["fmt"] == "RGBA128F" and np.abs(found[..., :3] - p).max() < near and (found[..., 3] == 1).all()
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            image.setRGB(x, y, (200 << 16) | (100 << 8) | 40)
    (tmp_path / "j").mkdir()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "j" / "a.jpg")))
    r = datasource.read_jpegs(spark, str(tmp_path / "j")).first()
    texels = np.frombuffer(r["data"], np.uint8).reshape(8, 16, 4).astype(int)
    assert (r["width"], r["height"], r["fmt"]) == (16, 8, "RGBA32") and np.abs(texels - [200, 100, 40, 255]).max() < 6


def test_first_ktx_round_trip():
    rng = np.random.default_rng(4)
    for fmt, layers, faces in (("RGBA32", 1, 1), ("BC1", 3, 1), ("ETC1", 1, 6), ("BC3", 2, 6)):
        images = []
        for level in range(3):
            w, h = max(10 >> level, 1), max(6 >> level, 1)
            images += [containers.Image(level, a, f, w, h, rng.bytes(containers.level_size(fmt, w, h))) for a in range(layers) for f in range(faces)]
        t = containers.Texture(fmt, 10, 6, images, {"k": b"value", "z": b""})
        raw = containers.write_ktx(t)
        back = containers.read_ktx(raw)
        assert (back.fmt, back.width, back.height, back.key_values) == (fmt, 10, 6, t.key_values)
        key = lambda i: (i.level, i.layer, i.face)
        assert [(key(i), i.data) for i in sorted(back.images, key=key)] == [(key(i), i.data) for i in sorted(images, key=key)]
        for cut in (20, 70, len(raw) - 9):
            try:
                containers.read_ktx(raw[:cut])
            except ValueError:
                continue
            raise AssertionError("a cut file was read")


def test_late_frames_are_marked(spark, tmp_path):
    from tests.test_codecs import stream_result
    from texloom.streaming.frames import skip_blocks

    rows = [(1, 0, "a"), (1, 1, "a"), (1, 5, "b")], [(1, 3, "b"), (1, 6, "b"), (2, 0, "c")]
    df = [spark.createDataFrame(r, "block long, frame long, sym string") for r in rows]
    found = stream_result(spark, df[0], tmp_path, lambda s: skip_blocks(s, "block", "frame", "sym"), df)
    assert {(r["block"], r["frame"]): r["skipped"] for r in found} == {(1, 0): False, (1, 1): True, (1, 5): False, (1, 3): None, (1, 6): True, (2, 0): False}
