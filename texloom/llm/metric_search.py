"""Exact top-k by inner product with an M-tree over blocks, best first (operator 7).

An inner product becomes a metric by one more coordinate: with M the largest norm of the table, the vector x gets
sqrt(M^2 - |x|^2) and a query gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vector has the
largest product.

1. Routing: at most PIVOTS rows (those with the smallest hash of their id) are pivots; each row goes to the cell of
   the nearest one. A cell of more than BLOCK rows is dealt into several blocks by hash. Each block becomes
   an M-tree: pages of at most PAGE vectors or children, each with a center, a covering radius and its distance to
   the parent's center. Which rows are pivots changes the work, not the result.
2. Upper level: the blocks' centers and radii, DESCRIPTORS to a row. Packs of queries meet these rows; each query is
   searched first in the block with the smallest lower bound, which gives it a k-th distance.
3. Only pairs of a query and a block whose bound d(query, center) - radius is within that distance are formed and
   searched: pages leave a queue in the order of their lower bound; a page whose bound |d(q, parent) - d(parent,
   center)| - radius exceeds the k-th distance so far is dropped without computing its distance. Pairs travel as
   packs of the queries that need a block. The best k of all blocks are merged.

Bounds are widened by SLACK, scores are integers: the result is exact. Where products might pass 2^53 they are summed
in whole numbers instead of floats.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without an id, take no
part; shorter vectors count as padded with zeros; rows with a query's id are the query's own and no
candidates of it; each repeated query row gives its own rows; ties go to the smaller id; fewer
candidates give fewer rows; components and scores beyond a long are held at its ends; an empty table gives an
empty result; no other column is read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from texloom.llm.common import join_by_key, limit_batches, written

BLOCK, PAGE, QUERIES = 4096, 256, 1024
#: Most pivots, most components of all pivots, and blocks described in one row.
PIVOTS, PIVOT_VALUES, DESCRIPTORS = 4096, 1 << 22, 4096
SLACK = 1e-6
EXACT, LONG = 2.0**53, (1 << 63) - 1

RESULT = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


def raised(vectors: np.ndarray, top: float | None) -> np.ndarray:
    """Points of the metric space: vectors with one more coordinate."""
    points = vectors.astype(np.float64)
    norms = (points**2).sum(axis=1)
    extra = np.sqrt(np.maximum((float(norms.max(initial=0.0)) if top is None else top) - norms, 0.0))
    return np.concatenate([points, extra[:, None]], axis=1)


class MTree:
    """An M-tree over integer vectors, as arrays: page p covers members first[p]..last[p] (a leaf) or children
    first[p]..last[p]; center, radius and distance to the parent's center."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, parts: dict | None = None, top: float | None = None):
        """top: the largest squared norm of the whole table (of these vectors if not given)."""
        if parts is not None:
            self.__dict__.update(parts)
            return
        rng = np.random.default_rng(1)
        points = raised(vectors, top)
        order: list[np.ndarray] = []
        rows = [(0.0, 0.0, True, 0, 0)]
        centers = [points[0] if len(points) else np.zeros(points.shape[1])]
        work = [(0, np.arange(len(points)))]
        filled = 0
        while work:
            p, members = work.pop(0)
            center, to_parent = centers[p], rows[p][1]
            far = np.sqrt(((points[members] - center) ** 2).sum(axis=1)) if len(members) else np.zeros(0)
            radius = float(far.max(initial=0.0))
            if len(members) <= page:
                rows[p] = (radius, to_parent, True, filled, filled + len(members))
                order.append(members)
                filled += len(members)
                continue
            fan = int(min(page, max(2, -(-2 * len(members) // page))))
            pivots = rng.choice(members, fan, replace=False)
            gaps = (points[members] ** 2).sum(axis=1)[:, None] - 2 * points[members] @ points[pivots].T + (points[pivots] ** 2).sum(axis=1)[None, :]
            side = gaps.argmin(axis=1)
            if np.bincount(side, minlength=fan).max() > 0.9 * len(members):  # few distinct points: any even split
                side = np.arange(len(members)) * fan // len(members)
            first = len(rows)
            for c in range(fan):
                own = members[side == c]
                if len(own):
                    pivot = points[pivots[c]] if len(np.unique(side)) > 1 else points[own[0]]
                    centers.append(pivot)
                    rows.append((0.0, float(np.sqrt(((pivot - center) ** 2).sum())), True, 0, 0))
                    work.append((len(rows) - 1, own))
            rows[p] = (radius, to_parent, False, first, len(rows))
        order_ = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.vectors = ids[order_], vectors[order_].astype(np.int64)
        self.radius, self.to_parent = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.leaf = np.array([r[2] for r in rows])
        self.first, self.last = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        self.centers = np.array(centers)
        self.top = np.array([(vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) if top is None else top])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> "MTree":
        with np.load(io.BytesIO(raw)) as parts:
            return MTree(None, None, parts={k: parts[k] for k in parts.files})

    def _scores(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        """Products of the query with members a..b, exact."""
        rows = self.vectors[a:b]
        most = float(np.abs(rows.astype(np.float64)).max(initial=0.0)) * float(np.abs(query.astype(np.float64)).max(initial=0.0)) * max(len(query), 1)
        if most < EXACT:
            return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return np.array([max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(row, query.tolist(), strict=True)))) for row in rows.tolist()], np.int64)

    def distance(self, query: np.ndarray, score: int) -> float:
        """The widened distance of a vector with this score."""
        base = float(query.astype(np.float64) @ query.astype(np.float64)) + float(self.top[0])
        return float(np.sqrt(max(base - 2 * float(score), 0.0))) + SLACK * (1 + np.sqrt(base))

    def search(self, query_id: int, query: np.ndarray, k: int, seen: list | None = None, reach: float = np.inf) -> list[tuple[int, int]]:
        """The k largest (score, id), ids other than the query's; best first. seen: collects the pages that were read.
        reach: members farther than this are not wanted."""
        q = query.astype(np.float64)
        q_aug = np.concatenate([q, [0.0]])
        best: list[tuple[int, int]] = []
        queue = [(0.0, 0, float(np.sqrt(((q_aug - self.centers[0]) ** 2).sum())))]
        while queue:
            bound, p, d_center = heapq.heappop(queue)
            if bound > reach:
                break
            if seen is not None:
                seen.append(p)
            a, b = self.first[p], self.last[p]
            if self.leaf[p]:
                scores = self._scores(a, b, query)
                ids = self.ids[a:b]
                good = ids != query_id
                if len(best) == k:
                    good &= scores >= best[-1][0]
                if good.any():
                    found = scores[good]
                    if len(found) > 4 * k:
                        good[good] = found >= np.partition(found, len(found) - k)[len(found) - k]
                    best += zip(scores[good].tolist(), ids[good].tolist(), strict=True)
                    best.sort(key=lambda x: (-x[0], x[1]))
                    del best[k:]
                    if len(best) == k:
                        reach = min(reach, self.distance(query, best[-1][0]))
                continue
            child = np.arange(a, b)
            child = child[np.abs(d_center - self.to_parent[a:b]) - self.radius[a:b] <= reach]
            d = np.sqrt(((self.centers[child] - q_aug) ** 2).sum(axis=1))
            low = np.maximum(d - self.radius[child], bound)
            for c, lo, dist in zip(child[low <= reach].tolist(), low[low <= reach].tolist(), d[low <= reach].tolist(), strict=True):
                heapq.heappush(queue, (lo, c, dist))
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as parts:
        return {k: parts[k] for k in parts.files}


def _wide(column: pa.Array, width: int) -> np.ndarray:
    found = _matrix(column)
    return np.pad(found, ((0, 0), (0, width - found.shape[1])))


def _gathered(rows: DataFrame, key: str, schema: T.StructType, make: Callable[[int, list[pa.Array]], list[tuple]]) -> DataFrame:
    """Rows of one key at a time, whose columns make() gets after the key: a shuffle by key, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                out = make(held[0].column(0)[0].as_py(), [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns[1:]])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)

        for batch in batches:
            keys = np.asarray(batch.column(0))
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield from finish()
                    held = []
                held.append(batch.slice(a, b - a))
        yield from finish()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _each(rows: DataFrame, schema: T.StructType, make: Callable[..., list[tuple]]) -> DataFrame:
    """make() of each row's values gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = make(*values)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _numbered(blocks: DataFrame, name: str, key: str) -> DataFrame:
    """blocks with dense numbers; only their keys are sorted."""
    return blocks.join(blocks.select(key, (F.row_number().over(W.orderBy(key)) - 1).alias(name)), key).drop(key)


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _trees(rows: DataFrame, top: float, width: int, many: int) -> DataFrame:
    """(id, v) -> (block, center, radius, data): an M-tree for each block."""
    spark = rows.sparkSession
    order = [F.xxhash64("id"), F.col("id"), F.col("v")]
    wanted = max(1, min(PIVOTS, PIVOT_VALUES // max(width, 1), -(-many // BLOCK)))
    pivots = np.zeros((wanted, width), np.int64)
    chosen = rows.orderBy(*order).limit(wanted).collect()
    for i, r in enumerate(chosen):
        pivots[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast(raised(pivots[: len(chosen)], top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        own = (p**2).sum(axis=1)
        for batch in batches:
            points = raised(_wide(batch.column(1), width), top)
            cell = (own[None, :] - 2 * points @ p.T).argmin(axis=1) if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["id", "v", "cell"])

    routed = written(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])), "cells")
    parts = F.broadcast(routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    block = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    dealt = routed.join(parts, "cell").select(block.alias("block"), "id", "v")

    def build(block: int, columns: list[pa.Array]) -> list[tuple]:
        tree = MTree(np.asarray(columns[0]), _wide(columns[1], width), top=top)
        return [(block, tree.centers[0].tolist(), float(tree.radius[0]), tree.dump())]

    return written(_gathered(dealt, "block", _fields("block long, center array<double>, radius double, data binary"), build), "trees")


def _packed_queries(queries: DataFrame, columns: list[str], width: int) -> DataFrame:
    """(block, uid, id, v, more columns) -> (pack, data): up to about QUERIES queries of one block at a time."""
    counts = queries.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / QUERIES))
    keyed = join_by_key(queries, counts, "block").select(F.xxhash64("block", salt).alias("pack"), "block", "uid", "id", "v", *columns)

    def build(pack: int, found: list[pa.Array]) -> list[tuple]:
        block = np.asarray(found[0])
        out = []
        for b in np.unique(block):  # one, unless two packs' names are equal
            own = np.nonzero(block == b)[0]
            arrays = {name: np.asarray(c)[own] for name, c in zip(["uid", "id", *columns], [*found[1:3], *found[4:]], strict=True)}
            out.append((int(b), _pack(vectors=_wide(found[3], width)[own], block=np.full(len(own), b), **arrays)))
        return out

    return _gathered(keyed, "pack", _fields("block long, data binary"), build)


def _with_upper(packs: DataFrame, upper: DataFrame, chunks: int) -> DataFrame:
    """Every pack of queries beside every row of block descriptors: (asked, described)."""
    every = packs.select(F.col("data").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return every.join(upper, "chunk").select("asked", "described")


def _lower_bounds(asked: dict, described: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each query to each block's center, and its least possible distance to the block's members."""
    q = np.pad(asked["vectors"].astype(np.float64), ((0, 0), (0, 1)))
    c = described["centers"]
    square = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * q @ c.T
    scale = np.sqrt(((q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :]))
    far = np.sqrt(np.maximum(square, 0.0))
    return far, np.maximum(far - described["radius"][None, :] - SLACK * (1 + scale), 0.0)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * component) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    whole = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(table: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, formed: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (an expression of `id`), the k best of all other rows.
    formed: collects how many pairs of a query and a block were searched, and how many there are (two counting jobs)."""
    spark = table.sparkSession
    limit_batches(spark)
    rows = integer_vectors(table, id_col, vector_col, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    many, top, width = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not many or k < 1:
        return none
    trees = _trees(rows, float(top), int(width), int(many))
    blocks = trees.count()
    chunks = -(-blocks // DESCRIPTORS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, DESCRIPTORS):
                part = batch.slice(a, DESCRIPTORS)
                centers = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                data = _pack(block=np.asarray(part.column(0)), centers=centers, radius=np.asarray(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([data], pa.binary())], names=["block", "described"])

    lines = trees.select("block", "center", "radius").coalesce(chunks)
    upper = written(lines.mapInArrow(describe, _fields("block long, described binary")), "upper")
    chunks = upper.count()
    upper = written(_numbered(upper, "chunk", "block"), "upper")
    asked = written(rows.where(is_query).select(F.monotonically_increasing_id().alias("uid"), "id", "v"), "queries")

    def nearest(raw: bytes, described: bytes) -> list[tuple]:
        own, block = _unpack(raw), _unpack(described)
        far, low = _lower_bounds(own, block)
        best = np.lexsort((far, low))[:, 0] if far.shape[1] > 1 else np.zeros(len(far), np.int64)
        at = np.arange(len(far))
        return list(zip(own["uid"].tolist(), low[at, best].tolist(), far[at, best].tolist(), block["block"][best].tolist(), strict=True))

    width = int(width)
    strewn = asked.select((F.pmod(F.xxhash64("uid"), F.lit(-(-int(many) // QUERIES)))).alias("block"), "uid", "id", "v")
    met = _each(_with_upper(_packed_queries(strewn, [], width), upper, chunks), _fields("uid long, low double, far double, block long"), nearest)
    home = met.groupBy("uid").agg(F.min(F.struct("low", "far", "block")).alias("best")).select("uid", F.col("best.block").alias("block"))
    homed = written(asked.join(home, "uid").select("block", "uid", "id", "v"), "homes")

    found = "uid long, query_id long, home long, reach double, best array<struct<vec_id: long, score: long>>"

    def first(raw: bytes, data: bytes) -> list[tuple]:
        own, tree, out = _unpack(raw), MTree.load(data), []
        for uid, i, home, q in zip(own["uid"].tolist(), own["id"].tolist(), own["block"].tolist(), own["vectors"], strict=True):
            best = tree.search(i, q, k)
            reach = tree.distance(q, best[-1][0]) if len(best) == k else float("inf")
            out.append((uid, i, home, reach, [{"vec_id": v, "score": s} for s, v in best]))
        return out

    packs = _packed_queries(homed, [], width).withColumnRenamed("data", "asked").join(trees.select("block", "data"), "block")
    begun = written(_each(packs.select("asked", "data"), _fields(found), first), "begun")

    def survive(raw: bytes, described: bytes) -> list[tuple]:
        own, block = _unpack(raw), _unpack(described)
        low = _lower_bounds(own, block)[1]
        wanted = (low <= own["reach"][:, None]) & (block["block"][None, :] != own["block"][:, None])
        out = []
        for b in np.nonzero(wanted.any(axis=0))[0]:
            rows = wanted[:, b]
            out.append((int(block["block"][b]), int(rows.sum()), _pack(**{n: x[rows] for n, x in own.items()})))
        return out

    ready = homed.join(begun.select("uid", "reach"), "uid")
    pairs = _each(_with_upper(_packed_queries(ready, ["reach"], width), upper, chunks), _fields("block long, n long, asked binary"), survive)
    if formed is not None:
        pairs = written(pairs, "pairs")
        queries = asked.count()
        formed += [(pairs.agg(F.sum("n")).first()[0] or 0) + queries, queries * blocks]

    def rest(raw: bytes, data: bytes) -> list[tuple]:
        own, tree, out = _unpack(raw), MTree.load(data), []
        for uid, i, q, reach in zip(own["uid"].tolist(), own["id"].tolist(), own["vectors"], own["reach"].tolist(), strict=True):
            out += [(uid, i, v, s) for s, v in tree.search(i, q, k, reach=reach)]
        return out

    more = _each(pairs.join(trees.select("block", "data"), "block").select("asked", "data"), RESULT, rest)
    own = begun.select("uid", "query_id", F.explode("best").alias("b")).select("uid", "query_id", "b.vec_id", "b.score")
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return own.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
