"""Spark sources and sinks of texture files.

`spark.read.format("texloom").load(dir)`: a row an image of each file (DDS, KTX, KTX2, PNG, TGA, QOI, ASTC; Radiance and OpenEXR as
RGBA128F, four 32-bit floats a texel). A partition is a file; a reader sees one file at a time. JPEG files are read by `read_jpegs`
through Spark's own `image` source. `write_images` is the sink: a file a row, written where the rows are, with a manifest of those of
committed tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from texloom.sources import containers, exr, rasters

FLOAT_READERS = {"hdr": rasters.read_radiance, "exr": exr.read_exr}
SCHEMA = "path string, fmt string, level int, layer int, face int, width int, height int, data binary"


def images_of(path: str, raw: bytes) -> Iterator[tuple]:
    """The images of a file by its extension."""
    ending = path.rpartition(".")[2].lower()
    if ending in rasters.READERS:
        picture = rasters.READERS[ending](raw)
        yield path, "RGBA32", 0, 0, 0, picture.shape[1], picture.shape[0], picture.tobytes()
    elif ending in FLOAT_READERS:
        picture = FLOAT_READERS[ending](raw).astype(np.float32)
        if picture.shape[2] == 3:
            picture = np.concatenate([picture, np.ones((*picture.shape[:2], 1), np.float32)], axis=2)
        yield path, "RGBA128F", 0, 0, 0, picture.shape[1], picture.shape[0], picture.astype("<f4").tobytes()
    elif ending in ("dds", "ktx", "ktx2"):
        t = {"dds": containers.read_dds, "ktx": containers.read_ktx, "ktx2": containers.read_ktx2}[ending](raw)
        for i in t.images:
            yield path, t.fmt, i.level, i.layer, i.face, i.width, i.height, i.data
    elif ending == "astc":
        w, h, bw, bh, blocks = containers.read_astc(raw)
        yield path, f"ASTC_{bw}x{bh}", 0, 0, 0, w, h, b"".join(blocks)
    else:
        raise ValueError(f"files named *.{ending} are not read")


class TextureSource(DataSource):
    """Option path: a folder or file, as a URI that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "texloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TextureReader(self.options["path"])


class TextureReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, own = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(own)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and "." in f.base_name]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value, compression=None) as f:
            raw = f.read()
        yield from images_of(partition.value, raw)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextureSource)


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) of any source -> image rows; for stores that only Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.binary()]
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(images_of(path, raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_jpegs(spark: SparkSession, path: str) -> DataFrame:
    """JPEG files (and others that the engine's `image` source decodes) as RGBA image rows."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.binary()]
        for batch in batches:
            for origin, w, h, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out = np.full((h, w, 4), 255, np.uint8)
                # the source keeps colors as blue, green, red
                out[..., :3] = texels[..., 2::-1] if n >= 3 else texels[..., :1]
                if n == 4:
                    out[..., 3] = texels[..., 3]
                row = (origin, "RGBA32", 0, 0, 0, w, h, out.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def _write(files: DataFrame, columns: list[str], folder: str, ending: str, make: Callable[..., bytes]) -> DataFrame:
    """A file a row, named by `name` and the task's attempt; (path, size) of those that committed tasks wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = fs.FileSystem.from_uri(folder)
        system.create_dir(own, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            out = []
            for name, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = make(*parts)
                path = f"{own}/{name}-{attempt}.{ending}"
                with system.open_output_stream(path, compression=None) as f:
                    f.write(raw)
                out.append((path, len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["path", "size"])

    files.select("name", *columns).mapInArrow(run, "path string, size long").write.parquet(f"{folder}/manifest")
    return files.sparkSession.read.schema("path string, size long").parquet(f"{folder}/manifest")


def write_images(images: DataFrame, folder: str, ending: str) -> DataFrame:
    """Rows (name, width, height, data of RGBA texels) as picture files."""
    writer = rasters.WRITERS[ending]
    return _write(images, ["width", "height", "data"], folder, ending, lambda w, h, data: writer(np.frombuffer(data, np.uint8).reshape(h, w, 4)))


def write_files(files: DataFrame, folder: str, ending: str) -> DataFrame:
    """Rows (name, data) as files."""
    return _write(files, ["data"], folder, ending, lambda data: data)
