"""A façade over image rows (path or name, width, height, data): compress, decode, transcode, and text grids.

Rows are independent, so each call is one pass of Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.operators import blockcodecs
from texloom.sources.containers import Image, Texture, write_dds, write_ktx, write_ktx2

CONTAINERS: dict[str, Callable[[Texture], bytes]] = {"dds": write_dds, "ktx": write_ktx, "ktx2": write_ktx2}


def to_blocks(picture: np.ndarray) -> np.ndarray:
    """(h, w, 4) to (n, 16, 4), borders repeated."""
    h, w = picture.shape[:2]
    full = np.pad(picture, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    return full.reshape(full.shape[0] // 4, 4, full.shape[1] // 4, 4, 4).swapaxes(1, 2).reshape(-1, 16, 4)


def from_blocks(blocks: np.ndarray, w: int, h: int) -> np.ndarray:
    across, down = -(-w // 4), -(-h // 4)
    return blocks.reshape(down, across, 4, 4, 4).swapaxes(1, 2).reshape(down * 4, across * 4, 4)[:h, :w]


def _map_images(images: DataFrame, work: Callable[[str, int, int, bytes], tuple[str, bytes]], keep: list[str]) -> DataFrame:
    """Replace fmt and data of each row."""
    source = images.select(*keep, "fmt", "width", "height", "data")
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            rows = [work(*x) for x in zip(*(columns[c].to_pylist() for c in ("fmt", "width", "height", "data")), strict=True)]
            columns["fmt"] = pa.array([f for f, _ in rows], pa.string())
            columns["data"] = pa.array([d for _, d in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return source.mapInArrow(run, source.schema)


def _decode(fmt: str, w: int, h: int, data: bytes) -> np.ndarray:
    if fmt == "RGBA32":
        return np.frombuffer(data, np.uint8).reshape(h, w, 4)
    size, decoder = blockcodecs.DECODERS[fmt]
    return from_blocks(decoder(np.frombuffer(data, np.uint8).reshape(-1, size)), w, h)


def compress(images: DataFrame, fmt: str, keep: list[str]) -> DataFrame:
    """RGBA or block rows as blocks of a format."""
    encoder = blockcodecs.ENCODERS[fmt]
    return _map_images(images, lambda f, w, h, d: (fmt, encoder(to_blocks(_decode(f, w, h, d))).tobytes()), keep)


def decode_rgba(images: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of any format that a decoder reads, as RGBA texels."""
    return _map_images(images, lambda f, w, h, d: ("RGBA32", _decode(f, w, h, d).tobytes()), keep)


def transcode(images: DataFrame, fmt: str, keep: list[str]) -> DataFrame:
    """Rows of one format as another."""
    return decode_rgba(images, keep) if fmt == "RGBA32" else compress(images, fmt, keep)


def pack(images: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """Each row as a file of one image in `data` (dds, ktx, ktx2)."""
    return _map_images(images, lambda f, w, h, d: (f, CONTAINERS[kind](Texture(f, w, h, [Image(0, 0, 0, w, h, d)]))), keep)


def text_grid(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """(y, value): a line a row of the picture, channels of a texel joined by blanks and texels by commas."""
    texel = F.concat_ws(" ", *[F.col(c).cast("string") for c in channels])
    return pixels.groupBy("y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", texel.alias("t")))), lambda s: s["t"]), ", ").alias("value"))


def from_text_grid(lines: DataFrame, channels: list[str]) -> DataFrame:
    """Pixels of lines (y, value); numbers outside 0..255 are null."""
    cells = lines.select("y", F.posexplode(F.split("value", ",")).alias("x", "cell"))
    parts = F.split(F.trim("cell"), r"\s+")
    value = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\d{1,3}$"), F.get(parts, F.lit(i)).try_cast(T.IntegerType()))
    return cells.select("x", "y", *[F.when(value(i) < 256, value(i)).alias(c) for i, c in enumerate(channels)])
