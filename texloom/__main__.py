"""Commands over texture files: python -m texloom info|validate|unpack|export|compare|stats|sizes|sweep|queries.

Each command is a DataFrame job over the files; tables go to standard output or, with --csv, to a folder.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom import api
from texloom.operators import entropy, images, stats
from texloom.sources import containers, datasource, listing

REPORT = "path string, kind string, fmt string, width int, height int, levels int, layers int, faces int, problem string"


def report_of(path: str, raw: bytes) -> tuple:
    """One line on a file: what it holds, or why it is not valid."""
    kind = path.rpartition(".")[2].lower()
    try:
        if raw[:2] == b"sB":
            head, slices = containers.read_slice_file(raw)
            levels = max((s["level"] for s in slices), default=-1) + 1
            return path, kind, str(head["tex_format"]), *((slices[0]["orig_width"], slices[0]["orig_height"]) if slices else (0, 0)), levels, head["images"], 1, None
        rows = list(datasource.images_of(path, raw))
        level, layer, face = (max(r[i] for r in rows) + 1 for i in (2, 3, 4))
        return path, kind, rows[0][1], rows[0][5], rows[0][6], level, layer, face, None
    except (ValueError, KeyError, IndexError, OSError) as problem:
        return path, kind, None, None, None, None, None, None, str(problem)[:200]


def report(files: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), *[pa.int32()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [report_of(p, raw) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, REPORT)


#: Texels in one batch of `pixels_of`.
BATCH_TEXELS = 1 << 17


def pixels_of(rows: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b, a) of RGBA rows: each image's bytes are read once and become columns, a batch of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texels = np.frombuffer(data, np.uint8).reshape(h, w, 4)
                lines = max(1, BATCH_TEXELS // max(w, 1))
                for y in range(0, h, lines):
                    part = texels[y : y + lines]
                    n = len(part)
                    columns = [np.tile(np.arange(w, dtype=np.int32), n), np.repeat(np.arange(y, y + n, dtype=np.int32), w), *part.reshape(-1, 4).T.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * (n * w), pa.string()), *map(pa.array, columns)], names=["path", "x", "y", *"rgba"])

    return rows.select("path", "width", "height", "data").mapInArrow(run, "path string, x int, y int, r int, g int, b int, a int")


def is_file(name: str) -> Column:
    """Whether `path` is the file that was named: the whole path, not its end."""
    plain = re.sub("^file:/+", "/", name)
    return F.regexp_replace("path", "^file:/+", "/") == (plain if "://" in plain else os.path.abspath(plain))


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="texloom", description=__doc__)
    parser.add_argument("command", choices=("info", "validate", "unpack", "export", "compare", "stats", "sizes", "sweep", "queries"))
    parser.add_argument("files", nargs="*", help="files, or @list for a listing file")
    parser.add_argument("--to", default="", help="folder of written files")
    parser.add_argument("--kind", default="ktx2", help="file kind to write: png, tga, qoi, dds, ktx, ktx2")
    parser.add_argument("--format", default="RGBA32", help="block format to export to")
    parser.add_argument("--csv", default="", help="folder for the table as CSV")
    o = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    paths = [p for f in o.files for p in ([r["path"] for r in listing.listed_files(spark, f[1:]).orderBy("i").collect()] if f.startswith("@") else [f])]
    files = listing.read_files(spark, paths) if paths else None
    bad = 0
    if o.command == "queries":
        from texloom.registry import queries

        out = spark.createDataFrame([(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(queries().items())], "name string, what string")
    elif o.command == "sweep":
        out = spark.range(14).select(F.col("id").alias("block"), F.explode(F.array(*map(F.lit, (0, 3, 6)))).alias("effort")).select("*", F.explode(F.array(*map(F.lit, (10, 25, 50, 75, 100)))).alias("quality"))
    elif o.command in ("info", "validate"):
        out = report(files)
        bad = out.where("problem is not null").count() if o.command == "validate" else 0
    elif o.command == "sizes":
        out = entropy.deflate_sizes(files.select("path", F.col("content").alias("data")), "path", "data")
    elif o.command in ("unpack", "export"):
        rows = datasource.decode_files(files).withColumn("name", F.concat_ws("-", F.regexp_extract("path", r"([^/\\]*)\.[^.]*$", 1), "level", "layer", "face"))
        if o.command == "unpack":
            out = datasource.write_images(api.decode_rgba(rows, ["name"]), o.to, o.kind if o.kind in ("png", "tga", "qoi") else "png")
        else:
            out = datasource.write_files(api.pack(api.transcode(rows, o.format, ["name"]), o.kind, ["name"]), o.to, o.kind)
    else:
        rows = api.decode_rgba(datasource.decode_files(files).where("level = 0 and layer = 0 and face = 0"), ["path"])
        parts = [pixels_of(rows.where(is_file(p))) for p in paths]
        out = stats.channel_summary(parts[0], list("rgba")) if o.command == "stats" else images.compare(parts[0], parts[1], list("rgba"))
    if o.csv:
        out.write.mode("overwrite").csv(o.csv, header=True)
    else:
        out.show(200, truncate=False)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
