"""Streams of ordered frames: state a block position (or image) keeps between micro-batches.

The same functions have a batch form in operators.ordered; tests hold both to equal results. State is keyed, so it is spread by
block position. Frames are decoded first to last: one that comes in a later micro-batch than its successor is late, keeps the
stream running, and is marked instead of compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def skip_blocks(frames: DataFrame, block: str, order: str, symbol: str) -> DataFrame:
    """(block, order, symbol, skipped): whether each block repeats the one of the frame before, across micro-batches.

    skipped is null for late frames (the dead letters of this stream): they change no state. A micro-batch's frames of one
    block are in memory together; the source's limit a trigger bounds them.
    """
    schema = T.StructType([frames.schema[block], frames.schema[order], frames.schema[symbol], T.StructField("skipped", T.BooleanType())])
    state_schema = T.StructType([frames.schema[order], frames.schema[symbol]])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_order, last = state.get if state.exists else (None, None)
        rows, before = pd.concat(list(parts)).sort_values(order), last_order
        out = []
        for at, value in zip(rows[order], rows[symbol], strict=True):
            if before is not None and at < before:
                out.append((key[0], at, value, None))
                continue
            out.append((key[0], at, value, last_order is not None and value == last))
            last_order, last = at, value
        state.update((int(last_order), last))
        found = pd.DataFrame(out, columns=schema.names)
        yield found.astype({"skipped": "boolean"})

    return frames.select(block, order, symbol).groupBy(block).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def running_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistics so far, kept by the engine."""
    from texloom.operators.stats import running_stats as columns

    return samples.groupBy(*keys).agg(*columns(F.col(value)))


def resample_lines(lines: DataFrame, image: str, row: str, values: str, height: int, new_height: int, name: str = "tent") -> DataFrame:
    """Incremental vertical resampling: (image, row, values) out as soon as all source rows of an output row are there.

    State a picture: the partial sums of output rows still waiting.
    """
    from texloom.operators.images import contributors

    table = contributors(height, new_height, name)
    need: dict[int, int] = {}
    for i, _, _ in table:
        need[i] = need.get(i, 0) + 1
    by_source: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in table:
        by_source.setdefault(j, []).append((i, w))
    schema = T.StructType([lines.schema[image], T.StructField("row", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    state_schema = T.StructType([T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("sums", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[int, tuple[int, list[float]]] = {}
        if state.exists:
            rows, seen, sums = state.get
            waiting = {int(r): (int(n), [float(x) for x in s]) for r, n, s in zip(rows, seen, sums, strict=True)}
        out = []
        for part in parts:
            for at, line in zip(part[row], part[values], strict=True):
                for i, w in by_source.get(int(at), []):
                    n, total = waiting.get(i, (0, [0.0] * len(line)))
                    waiting[i] = (n + 1, [a + w * float(x) for a, x in zip(total, line, strict=True)])
                    if n + 1 == need[i]:
                        out.append((key[0], i, waiting.pop(i)[1]))
        state.update(([*waiting], [n for n, _ in waiting.values()], [s for _, s in waiting.values()]))
        yield pd.DataFrame(out, columns=schema.names)

    return lines.select(image, row, values).groupBy(image).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
