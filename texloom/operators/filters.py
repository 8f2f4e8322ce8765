"""Linear filters of pixel tables by whole pictures: each texel is shuffled once, whatever the kernel's width.

A unit is a picture, or a strip of one of more than UNIT texels. Tasks sort their rows by unit and filter some units at a
time as arrays, so a task's memory depends on UNIT and not on how many pictures there are. A texel that is missing or null
adds nothing; of several at one place the values are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texels of a unit, and about as many are filtered at a time.
UNIT = 1 << 18


class Axis(NamedTuple):
    """How the n places of a line become m: the parts of place i begin at start[i]."""

    n: int
    m: int
    source: np.ndarray
    weight: np.ndarray
    start: np.ndarray


def axis(n: int, m: int, parts: list[tuple[int, int, float]]) -> Axis:
    """parts: (destination, source, weight), each destination at least once."""
    to, source, weight = (np.array(c) for c in zip(*sorted(parts), strict=True))
    return Axis(n, m, source, weight, np.searchsorted(to, np.arange(m)))


def _along(values: np.ndarray, by: Axis | None, dim: int, weighted: bool = True) -> np.ndarray:
    if by is None:
        return values
    shape = [1, 1, 1]
    shape[dim] = -1
    parts = np.take(values, by.source, dim)
    with np.errstate(invalid="ignore"):
        return np.add.reduceat(parts * by.weight.reshape(shape) if weighted else parts, by.start, dim)


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """The number of each row's unit: rows that agree in the named columns and stand together are one."""
    changed = np.zeros(max(len(table) - 1, 0), bool)
    for name in names:
        c = table[name].combine_chunks()
        a, b = c.slice(0, len(changed)), c.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null()))
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        changed |= differ.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(changed)]) if len(table) else np.zeros(0, np.int64)


def _some_units(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units of sorted rows, some at a time, with the number of each row's unit."""
    held, rows, enough = [], 0, UNIT // 2
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        number = _numbers(table, names)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield table.slice(0, cut), number[:cut]
        held, rows = table.slice(cut).to_batches(), len(table) - cut
        enough = max(UNIT // 2, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held)
        yield table, _numbers(table, names)


def _sums(flat: np.ndarray, size: int, column: pa.ChunkedArray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Summed values at each place, and how many of them are known (None: no value is null)."""
    values = pc.fill_null(column, 0.0).to_numpy()[inside]
    if not column.null_count:
        return np.bincount(flat, values, size), None
    known = column.is_valid().to_numpy()[inside]
    return np.bincount(flat, values, size), np.bincount(flat[known], minlength=size)


def _by_unit(rows: DataFrame, keys: list[str], schema: T.StructType, run: Callable[[pa.Table, np.ndarray], Iterator[list]]) -> DataFrame:
    """rows have a column __unit; run gets whole units and yields the columns of schema."""
    arrow = to_arrow_schema(schema)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _some_units(batches, [*keys, "__unit"]):
            for columns in run(table, number):
                yield from pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in columns], names=arrow.names).cast(arrow).to_batches(1 << 16)

    at = [*keys, "__unit"]
    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(of_task, schema)


def _place(name: str) -> Column:
    return F.col(name).cast("long").alias(f"__{name}")


def _integers(table: pa.Table, name: str, missing: int) -> np.ndarray:
    return pc.fill_null(table[name], missing).to_numpy()


def filtered(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, steps: list[tuple[Axis | None, Axis | None]], level: str | None = None, strip: tuple[str, int] | None = None) -> DataFrame:
    """([keys], [level], x, y, channels): pictures after the steps, each along x and then along y.

    With level every step's pictures are kept and numbered from 1, and the rows as they came are level 0. strip: (x or y, lines of a unit),
    for pictures that are too large to be a unit and steps that do not mix lines.
    """
    lines, across = strip[1] if strip and strip[0] == "y" else h, strip[1] if strip and strip[0] == "x" else w
    unit = F.lit(0).cast("long") if strip is None else F.floor(F.col(strip[0]) / strip[1]).cast("long")
    rows = pixels.select(*keys, unit.alias("__unit"), _place("x"), _place("y"), *[F.col(c).cast("double").alias(c) for c in channels])
    kinds = {c: pixels.schema[c].dataType for c in ("x", "y")}
    place = [T.StructField(c, T.LongType() if level and kinds[c] == T.LongType() else T.IntegerType()) for c in ("x", "y")]
    numbers = [T.StructField(level, T.IntegerType(), False)] if level else []
    schema = T.StructType([*[pixels.schema[k] for k in keys], *numbers, *place, *[T.StructField(c, T.DoubleType()) for c in channels]])
    if level is None:
        rows = rows.where(F.col("__x").between(0, w - 1) & F.col("__y").between(0, h - 1))
    size = lines * across
    some = max(1, UNIT // max(size, *[max(a.m if a else across, across) * max(b.m if b else lines, lines) for a, b in steps]))

    def run(table: pa.Table, number: np.ndarray) -> Iterator[list]:
        if level:
            yield [*[table[k] for k in keys], pa.array(np.zeros(len(table), np.int32)), table["__x"], table["__y"], *[table[c] for c in channels]]
        for first in range(0, int(number[-1]) + 1, some):
            begin, end = np.searchsorted(number, [first, first + some])
            part, own = table.slice(begin, end - begin), number[begin:end] - first
            yield from pictures(part, own, int(own[-1]) + 1)

    def pictures(part: pa.Table, own: np.ndarray, count: int) -> Iterator[list]:
        heads = np.searchsorted(own, np.arange(count))
        units = part["__unit"].to_numpy()
        x, y = _integers(part, "__x", -1), _integers(part, "__y", -1)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        x0, y0 = (units * across, units * 0) if strip and strip[0] == "x" else (units * 0, units * lines if strip else units * 0)
        flat = ((own * lines + y - y0) * across + x - x0)[inside]
        there = np.bincount(flat, minlength=count * size)
        found = [(there, None if there.all() else there)] + [_sums(flat, count * size, part[c], inside) for c in channels]
        shaped = [tuple(None if a is None else a.reshape(count, lines, across) for a in pair) for pair in found]
        for k, (along_x, along_y) in enumerate(steps, 1):
            both = lambda a, weighted: None if a is None else _along(_along(a, along_x, 2, weighted), along_y, 1, weighted)
            (_, rows_at), *values = shaped
            values = [(both(v, True), both(known, False)) for v, known in values]
            new = values[0][0].shape
            shaped = [(None, both(rows_at, False)), *values]
            if level is None and k < len(steps):
                continue
            g, i, j = np.nonzero(np.ones(new, bool) if rows_at is None else shaped[0][1])
            at = heads[g]
            out = [*[part[c].take(pa.array(at)) for c in keys], *([pa.array(np.full(len(g), k, np.int32))] if level else []), pa.array(j + x0[at]), pa.array(i + y0[at])]
            for v, known in values:
                out.append(pa.array(v[g, i, j], mask=None if known is None else known[g, i, j] == 0))
            yield out

    return _by_unit(rows, keys, schema, run)


def separable(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, along_x: Axis, along_y: Axis) -> DataFrame:
    """(keys, x, y, channels) after a filter along x and one along y; a large picture goes by strips, first of rows, then of columns."""
    if fits(w, h, along_x, along_y):
        return filtered(pixels, keys, channels, w, h, [(along_x, along_y)])
    strips = lambda a: max(1, UNIT // max(a.n, a.m))
    wide = filtered(pixels, keys, channels, w, h, [(along_x, None)], strip=("y", strips(along_x)))
    return filtered(wide, keys, channels, along_x.m, h, [(None, along_y)], strip=("x", strips(along_y)))


def fits(w: int, h: int, along_x: Axis, along_y: Axis) -> bool:
    """Whether a picture is a unit."""
    return max(w, along_x.m) * max(h, along_y.m) <= UNIT


def weighted_neighbors(pixels: DataFrame, keys: list[str], channels: list[str], w: int, h: int, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """(keys, x, y, channels): at the place of every texel the sums of its neighbours at (dx, dy), clamped to the picture, times
    their weights. Large pictures go by strips of rows, to which the rows that the kernel reaches are added."""
    reach = max(abs(dy) for _, dy, _ in kernel)
    lines = h if w * h <= UNIT else min(h, max(1, 2 * reach, UNIT // w))
    last = (h - 1) // lines
    clamped = F.greatest(F.lit(0), F.least(F.lit(h - 1), F.col("__y")))
    rows = pixels.select(*keys, _place("x"), _place("y"), *[F.col(c).cast("double").alias(c) for c in channels])
    rows = rows.dropna(subset=[*keys, "__x", "__y"]).withColumn("__own", F.floor(clamped / lines).cast("long"))
    if last:
        strips = F.sequence(F.greatest(F.lit(0), F.floor((clamped - reach) / lines)), F.least(F.lit(last), F.floor((clamped + reach) / lines)))
        inside = F.col("__x").between(0, w - 1) & F.col("__y").between(0, h - 1)
        rows = rows.withColumn("__unit", F.explode(F.when(inside, strips).otherwise(F.array("__own"))))
    else:
        rows = rows.withColumn("__unit", F.col("__own"))
    schema = T.StructType([*[pixels.schema[k] for k in keys], pixels.schema["x"], pixels.schema["y"], *[T.StructField(c, T.DoubleType()) for c in channels]])
    held = min(h, lines + 2 * reach)
    some = max(1, UNIT // (held * w))

    def run(table: pa.Table, number: np.ndarray) -> Iterator[list]:
        for first in range(0, int(number[-1]) + 1, some):
            begin, end = np.searchsorted(number, [first, first + some])
            yield from pictures(table.slice(begin, end - begin), number[begin:end] - first)

    def pictures(part: pa.Table, own: np.ndarray) -> Iterator[list]:
        x, y, units = (part[c].to_numpy() for c in ("__x", "__y", "__unit"))
        top = np.clip(units * lines - reach, 0, h - held)
        size = (int(own[-1]) + 1) * held * w
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        flat = ((own * held + y - top) * w + x)[inside]
        there = np.bincount(flat, minlength=size)
        sums = [_sums(flat, size, part[c], inside) for c in channels]
        # the places that texels of this strip have, and how many texels each has
        mine = np.flatnonzero(part["__own"].to_numpy() == units)
        if not len(mine):
            return
        order = mine[np.lexsort((x[mine], y[mine], own[mine]))]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(own[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(x[order]) != 0)
        at, times = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
        columns = {dx: np.clip(x[at] + dx, 0, w - 1) for dx in {dx for dx, _, _ in kernel}}
        starts = {dy: (own[at] * held + np.clip(y[at] + dy, 0, h - 1) - top[at]) * w for dy in {dy for _, dy, _ in kernel}}
        total = [np.zeros(len(at)) for _ in channels]
        known = [np.zeros(len(at), np.int64) if k is not None else None for _, k in sums]
        rows_at = None if there.all() else np.zeros(len(at), np.int64)
        for dx, dy, weight in kernel:
            place = starts[dy] + columns[dx]
            for c, (values, k) in enumerate(sums):
                total[c] += values[place] * weight
                if k is not None:
                    known[c] += k[place]
            if rows_at is not None:
                rows_at += there[place]
        kept = np.ones(len(at), bool) if rows_at is None else rows_at > 0
        taken = pa.array(at[kept])
        out = [part[c].take(taken) for c in (*keys, "__x", "__y")]
        for v, k in zip(total, known, strict=True):
            out.append(pa.array((v * times)[kept], mask=None if k is None else k[kept] == 0))
        yield out

    return _by_unit(rows, keys, schema, run)
