"""Tree-structured vector quantization on DataFrames.

The tree grows best first: the leaf of largest squared error is split by the sign of the projection on its principal axis and
refined by two means. Splits are found for up to BATCH open leaves at once, in passes shared by all of them, and applied in the
order of the errors; so passes over the rows grow with the depth of the tree and with leaves div BATCH, not with leaves. The
driver holds the tree (a few numbers a leaf); rows stay distributed, and equal vectors are one row from the start. In a
pass each task sends one row of partial sums a leaf and side; a row finds its leaf by going down the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS, LEAST_GAIN, LEAST_ERROR = 6, 0.00125, 1e-5
#: Leaves whose splits one series of passes looks for, and the most numbers that a task sends for them.
BATCH, BATCH_VALUES = 256, 1 << 20


@dataclass
class Leaf:
    """center, weight and squared error of a leaf; order: the split that made it; parent: the leaf that was split."""

    center: np.ndarray
    weight: float
    error: float
    order: int
    parent: int


class Tree:
    """Planes and children of the inner nodes; leaf: the code of a node that has no children, else -1. Rows at a plane or
    beyond it go to the second child."""

    def __init__(self, size: int):
        self.normal, self.offset = np.zeros((1, size)), np.zeros(1)
        self.children, self.leaf = np.zeros((1, 2), np.int64), np.zeros(1, np.int64)

    def split(self, code: int, new: int, normal: np.ndarray, offset: float) -> None:
        """The leaf `code` keeps its first side; the second one is the leaf `new`."""
        node, n = int(np.nonzero(self.leaf == code)[0][0]), len(self.leaf)
        self.normal = np.concatenate([self.normal, np.zeros((2, self.normal.shape[1]))])
        self.offset = np.concatenate([self.offset, [0.0, 0.0]])
        self.children = np.concatenate([self.children, np.zeros((2, 2), np.int64)])
        self.leaf = np.concatenate([self.leaf, [code, new]])
        self.normal[node], self.offset[node], self.children[node], self.leaf[node] = normal, offset, (n, n + 1), -1

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, a level of the tree at a time."""
        node = np.zeros(len(vectors), np.int64)
        inner = np.arange(len(vectors)) if self.leaf[0] < 0 else np.zeros(0, np.int64)
        while len(inner):
            at = node[inner]
            beyond = (vectors[inner] * self.normal[at]).sum(axis=1) >= self.offset[at]
            node[inner] = self.children[at, beyond.astype(int)]
            inner = inner[self.leaf[node[inner]] < 0]
        return self.leaf[node]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


Plane = tuple[np.ndarray, float]


def _sums(data: DataFrame, tree: Tree, planes: dict[int, Plane | None], square: bool) -> dict[tuple[int, int], np.ndarray]:
    """Weight, sums, squares and (square) products of the rows of some leaves, by (leaf, side of its plane)."""
    schema = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("side", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            v, w = _vectors(batch.column(0)), np.asarray(batch.column(1))
            leaf = tree.leaf_of(v)
            for code in np.unique(leaf).tolist():
                if code not in planes:
                    continue
                own, plane = leaf == code, planes[code]
                x, y = v[own], w[own]
                side = (x @ plane[0] >= plane[1]).astype(int) if plane else np.zeros(len(x), int)
                for s in np.unique(side).tolist():
                    p, q = x[side == s], y[side == s]
                    parts = [[q.sum(), (q * (p * p).sum(axis=1)).sum()], q @ p] + ([((p * q[:, None]).T @ p).ravel()] if square else [])
                    total[code, s] = total.get((code, s), 0) + np.concatenate(parts)
        if total:
            names = [np.array(x, np.int64) for x in zip(*total, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=schema.names)

    found: dict[tuple[int, int], np.ndarray] = {}
    for code, side, sums in data.select("v", "weight").mapInArrow(run, schema).collect():
        found[code, side] = found.get((code, side), 0) + np.array(sums)
    return found


def _center_error(sums: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    w, q, s = sums[0], sums[1], sums[2 : 2 + size]
    return s / w, float(w), max(0.0, float(q - s @ s / w))


def quantize(rows: DataFrame, vector: str, weight: str, codes: int) -> tuple[DataFrame, list[Leaf]]:
    """(v, weight, members, code) for each distinct vector, and the codebook. Truncating the codebook to leaves with order < k
    and their parents gives the coarser ones. Ties go to the second child; a leaf of one vector is not split."""
    data = rows.groupBy(F.transform(vector, lambda x: x.cast("double")).alias("v")).agg(F.sum(weight).cast("double").alias("weight"), F.count(F.lit(1)).alias("members")).persist()
    head = data.select(F.size("v").alias("n")).first()
    leaves: list[Leaf] = []
    tree = Tree(head["n"] if head is not None else 0)
    if head is not None:
        size = head["n"]
        center, total, error = _center_error(_sums(data, tree, {0: None}, False)[0, 0], size)
        leaves = [Leaf(center, total, error, 0, -1)]
        most = max(1, min(BATCH, BATCH_VALUES // (size * size + size + 2)))
        known: dict[int, tuple | None] = {}
        while len(leaves) < codes:
            open_ = sorted((i for i, leaf in enumerate(leaves) if known.get(i, ()) is not None and leaf.error > LEAST_ERROR), key=lambda i: (-leaves[i].error, i))
            if not open_:
                break
            at = open_[0]
            if at not in known:
                # leaves further down the list will be split too, if there are codes enough
                ahead = [i for i in open_ if i not in known][: min(most, codes - len(leaves))]
                known |= _splits(data, tree, {i: leaves[i] for i in ahead}, size)
                continue
            plane, (a, b) = known.pop(at)
            order = len(leaves)
            tree.split(at, order, *plane)
            leaves[at] = Leaf(*a, leaves[at].order, leaves[at].parent)
            leaves.append(Leaf(*b, order, at))
    schema = T.StructType([*data.schema.fields, T.StructField("code", T.IntegerType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf_of(_vectors(batch.column(0))).astype(np.int32))], names=schema.names)

    found = data.mapInArrow(label, schema)
    data.unpersist()
    return found, leaves


def _splits(data: DataFrame, tree: Tree, leaves: dict[int, Leaf], size: int) -> dict[int, tuple | None]:
    """For each leaf the plane that splits it, and both sides' (center, weight, error); None if all its rows are on one side."""
    planes: dict[int, Plane | None] = {}
    for (code, _), sums in _sums(data, tree, dict.fromkeys(leaves), True).items():
        center = leaves[code].center
        axis = np.linalg.eigh(sums[2 + size :].reshape(size, size) / sums[0] - np.outer(center, center))[1][:, -1]
        axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
        planes[code] = (axis, float(axis @ center))
    best: dict[int, tuple | None] = dict.fromkeys(leaves)
    before: dict[int, float] = {}
    for _ in range(STEPS):
        if not planes:
            break
        sums = _sums(data, tree, planes, False)
        for code in list(planes):
            low, high = sums.get((code, 0)), sums.get((code, 1))
            if low is None or high is None:
                del planes[code]
                continue
            a, b = _center_error(low, size), _center_error(high, size)
            best[code] = planes[code], (a, b)
            now = a[2] + b[2]
            if code in before and before[code] - now < LEAST_GAIN * before[code]:
                del planes[code]
                continue
            before[code] = now
            # rows nearer to b's center, or as near
            planes[code] = (b[0] - a[0], float(b[0] @ b[0] - a[0] @ a[0]) / 2)
    return best


def truncated(leaves: list[Leaf], codes: int) -> list[int]:
    """For each leaf its code in the codebook of only the first `codes` leaves: the nearest leaf of smaller order that it came from."""
    out = []
    for i in range(len(leaves)):
        while i >= codes:
            i = leaves[i].parent
        out.append(i)
    return out
