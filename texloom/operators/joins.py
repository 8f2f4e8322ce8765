"""Join-shaped operators. A codebook is small by construction (its size is a parameter and is checked before it is broadcast)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a codebook that may be broadcast; larger ones are joined by parent.
MOST_CODES = 16128
#: Distinct patterns that neighbours are searched among: all that 16 bits can have.
MOST_PATTERNS = 1 << 16
#: Rows of a block of a band's value, pairs that a task compares (about), and most tasks.
BAND_BLOCK, BAND_PAIRS, MOST_BAND_TASKS = 1 << 13, 1 << 24, 1 << 13


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def nearest_code(rows: DataFrame, codes: DataFrame, row_id: str, v: str, code_id: str, center: str, parent: str | None = None) -> DataFrame:
    """(row_id, code_id, error): the code of least squared distance, ties to the smaller id; with parent, among its children.

    Without parent the codebook, whose size is checked, becomes one broadcast array and each row takes the least over
    it: no pair is ever a row. With parent it is an equi-join; a row whose parent has no code keeps nulls.
    """
    if parent:
        pairs = rows.join(codes, parent, "left").select(row_id, F.struct(squared_distance(F.col(v), F.col(center)).alias("error"), F.col(code_id).alias("code")).alias("x"))
        return pairs.groupBy(row_id).agg(F.min("x").alias("x")).select(row_id, F.col("x.code").alias(code_id), F.col("x.error").alias("error"))
    found = codes.select(code_id, center).limit(MOST_CODES + 1).count()
    if found > MOST_CODES:
        raise ValueError(f"a codebook of more than {MOST_CODES} codes needs parents")
    book = codes.agg(F.array_sort(F.collect_list(F.struct(F.col(code_id).alias("code"), F.col(center).alias("c")))).alias("__book"))
    least = F.array_min(F.transform("__book", lambda s: F.struct(squared_distance(F.col(v), s["c"]).alias("error"), s["code"].alias("code"))))
    return rows.join(F.broadcast(book), F.lit(True)).withColumn("x", least).select(row_id, F.col("x.code").alias(code_id), F.col("x.error").alias("error"))


def previous_frame(slices: DataFrame, frame: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Each slice with the one of the frame before (same keys): columns get the prefix prev_; null where there is none."""
    before = slices.select(*keys, (F.col(frame) + 1).alias(frame), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return slices.join(before, [*keys, frame], "left")


def remap(rows: DataFrame, table: DataFrame, old: str, new: str) -> DataFrame:
    """Replace old ids by new ones; rows without an entry keep theirs."""
    return rows.join(table.select(old, new), old, "left").withColumn(old, F.coalesce(new, old)).drop(new)


def nearest_level(v: Column, levels: list[int]) -> Column:
    """Index of the level nearest to a value, ties to the lower index."""
    entries = F.array(*[F.struct(F.abs(v - x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(levels)])
    return F.array_min(entries)["i"]


def hamming_neighbors(rows: DataFrame, patterns: DataFrame, row_id: str, code: str, pattern_id: str, pattern: str, k: int) -> DataFrame:
    """The k patterns with the fewest differing bits, ties to the smaller id: (row_id, rank, pattern_id, bits).

    The distinct patterns are a checked dimension. Of equal ones the k smallest ids are enough; null patterns and
    patterns without an id are no neighbours. Rows stay where they are: a task finds the patterns of each code once.
    """
    place = F.row_number().over(W.partitionBy(pattern).orderBy(pattern_id))
    least = patterns.select(pattern_id, pattern).where(F.col(pattern).isNotNull() & F.col(pattern_id).isNotNull()).withColumn("__k", place).where(F.col("__k") <= k)
    found = least.limit(MOST_PATTERNS * k + 1).toArrow().sort_by([(pattern_id, "ascending")])
    groups: dict[int, list] = {}
    for i, p in zip(found[pattern_id].to_pylist(), found[pattern].to_pylist(), strict=True):
        groups.setdefault(p, []).append(i)
    if len(found) > MOST_PATTERNS * k or len(groups) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} distinct patterns")
    # patterns in the order of their smallest ids: the first k of equal distance hold the k smallest ids
    book, ids = np.array([*groups], np.int64), [*groups.values()]
    source = rows.select(row_id, F.col(code).cast("long").alias(code))
    kinds = [source.schema[row_id], T.StructField("rank", T.IntegerType()), T.StructField(pattern_id, patterns.schema[pattern_id].dataType), T.StructField("bits", T.IntegerType())]
    schema = T.StructType(kinds)
    arrow = to_arrow_schema(schema)

    def nearest(value: int | None) -> list[tuple]:
        bits = np.bitwise_count((book ^ value).view(np.uint64)) if value is not None else np.zeros(len(book), np.uint8)
        best: list[int] = []
        for distance in range(65):
            if len(best) >= min(k, len(book)):
                break
            best += np.flatnonzero(bits == distance)[: k - len(best)].tolist()
        pairs = sorted((int(bits[b]), i) for b in best for i in ids[b])[:k]
        return [(i, b if value is not None else None) for b, i in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int | None, list[tuple]] = {}
        for batch in batches:
            at, out = [], []
            for n, value in enumerate(batch.column(1).to_pylist()):
                if value not in known:
                    if len(known) >= MOST_PATTERNS:
                        known.clear()
                    known[value] = nearest(value)
                for rank, (i, b) in enumerate(known[value], 1):
                    at.append(n)
                    out.append((rank, i, b))
            columns = [pa.array([r[c] for r in out], arrow.field(c + 1).type) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def band_candidates(rows: DataFrame, row_id: str, bits: Column, bands: int, width: int) -> DataFrame:
    """Pairs that agree in a band of bits: each pair once, by an equi-join on (band, value).

    A pair belongs to the first band and value that it shares, so no pair is held to find it again. Groups of more than
    BAND_BLOCK rows are compared block by block, and tasks grow in number with the pairs: what a task holds does not grow.
    """
    mask = (1 << width) - 1
    shared = lambda code: F.array(*[F.shiftright(code, b * width).bitwiseAND(F.lit(mask)).cast("long") + (b << width) for b in range(bands)])
    named = rows.select(F.col(row_id).alias("id"), bits.cast("long").alias("code")).dropna()
    codes = named.groupBy("id").agg(F.collect_set("code").alias("codes"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("codes", shared))))
    # an id with several codes carries all it has of bands and values
    ids = codes.select("id", F.get("codes", F.lit(0)).alias("code"), F.when(F.size("codes") > 1, keys).alias("many"), F.explode(keys).alias("key"))
    counts = named.select("id", F.explode(shared(F.col("code"))).alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pairs, most = counts.agg(F.sum(F.col("n").cast("double") ** 2), F.max("n")).first()
    at = ["key"]
    if (most or 0) > BAND_BLOCK:
        blocks = counts.where(F.col("n") > BAND_BLOCK).select("key", F.ceil(F.col("n") / BAND_BLOCK).alias("blocks"))
        ids = ids.join(F.broadcast(blocks), "key", "left").withColumn("block", F.expr("pmod(xxhash64(id), coalesce(blocks, 1))"))
        left = ids.select("*", F.col("block").alias("first"), F.explode(F.expr("sequence(block, coalesce(blocks, 1) - 1)")).alias("second"))
        right = ids.select("*", F.explode(F.expr("sequence(0L, block)")).alias("first"), F.col("block").alias("second"))
        at += ["first", "second"]
    else:
        left = right = ids
    tasks = min(MOST_BAND_TASKS, math.ceil((pairs or 0) / BAND_PAIRS))
    deal = lambda d: d.repartition(tasks, *at) if tasks > 1 else d
    left = deal(left.select(*at, "id", "code", "many"))
    right = deal(right.select(*at, *[F.col(c).alias(f"other_{c}") for c in ("id", "code", "many")]))
    differing = F.col("code").bitwiseXOR(F.col("other_code"))
    band = F.shiftright("key", width)
    first = F.lit(True)
    for b in range(bands - 1):
        first = first & ((band <= b) | (F.shiftright(differing, b * width).bitwiseAND(F.lit(mask)) != 0))
    of = lambda side: F.coalesce(F.col(f"{side}many"), shared(F.col(f"{side}code")))
    first = F.when(F.col("many").isNull() & F.col("other_many").isNull(), first).otherwise(F.col("key") == F.array_min(F.array_intersect(of(""), of("other_"))))
    ordered = F.col("id") < F.col("other_id")
    if len(at) > 1:
        ordered = (F.col("first") < F.col("second")) | ordered
    found = left.join(right.hint("merge"), at).where(ordered & first)
    return found.select(F.least("id", "other_id").alias(row_id), F.greatest("id", "other_id").alias("other"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
