"""Ordered operators: runs, differences, neighbours, offsets. All windows are within a slice, never over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, slice_cols: list[str], order: list[str], symbol: str) -> DataFrame:
    """Run-length coding of each slice: (slice, symbol, first position, length)."""
    own = W.partitionBy(*slice_cols).orderBy(*order)
    at = F.row_number().over(own)
    return (
        df.withColumn("__at", at)
        .withColumn("__run", F.col("__at") - F.row_number().over(W.partitionBy(*slice_cols, symbol).orderBy(*order)))
        .groupBy(*slice_cols, symbol, "__run")
        .agg(F.min("__at").alias("first_at"), F.count(F.lit(1)).alias("length"))
        .drop("__run")
    )


def differences(df: DataFrame, slice_cols: list[str], order: list[str], v: str) -> DataFrame:
    """Each value less the one before it in its slice (the first less 0)."""
    own = W.partitionBy(*slice_cols).orderBy(*order)
    return df.withColumn("delta", F.col(v) - F.coalesce(F.lag(v).over(own), F.lit(0)))


def xor_differences(df: DataFrame, slice_cols: list[str], order: list[str], v: str) -> DataFrame:
    own = W.partitionBy(*slice_cols).orderBy(*order)
    return df.withColumn("delta", F.col(v).bitwiseXOR(F.coalesce(F.lag(v).over(own), F.lit(0))))


def band(previous: Column, edges: tuple[int, ...]) -> Column:
    """Context number of a value by its band: how many edges it reaches."""
    return sum((F.when(previous >= e, 1).otherwise(0) for e in edges), F.lit(0))


def pair_counts(df: DataFrame, slice_cols: list[str], order: list[str], symbol: str) -> DataFrame:
    """Symmetric co-occurrence of neighbours: (a, b, n), each adjacent pair once in both directions."""
    after = F.lead(symbol).over(W.partitionBy(*slice_cols).orderBy(*order))
    pairs = df.select(F.col(symbol).alias("a"), after.alias("b")).where("b is not null")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = counted.union(counted.select("b", "a", "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def repeats_previous(df: DataFrame, slice_cols: list[str], order: list[str], symbol: str) -> DataFrame:
    """Conditional replenishment: whether a block equals the same block of the frame before."""
    before = F.lag(symbol).over(W.partitionBy(*slice_cols).orderBy(*order))
    return df.withColumn("skipped", F.coalesce(F.col(symbol) == before, F.lit(False)))


def symbol_groups(df: DataFrame, slice_cols: list[str], order: list[str], symbol: str, k: int) -> DataFrame:
    """Symbols packed k at a time, in order: (slice, group number, symbols)."""
    at = F.row_number().over(W.partitionBy(*slice_cols).orderBy(*order)) - 1
    numbered = df.withColumn("__at", at)
    parts = F.array_sort(F.collect_list(F.struct("__at", symbol)))
    return numbered.groupBy(*slice_cols, F.floor(F.col("__at") / k).alias("group_no")).agg(F.transform(parts, lambda s: s[symbol]).alias("symbols"))


def offsets(df: DataFrame, slice_cols: list[str], order: list[str], size: str) -> DataFrame:
    """Running byte offset: the sizes before a row in its file."""
    before = W.partitionBy(*slice_cols).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def stripes(df: DataFrame, slice_cols: list[str], order: list[str], count: int) -> DataFrame:
    return df.withColumn("stripe", F.ntile(count).over(W.partitionBy(*slice_cols).orderBy(*order)))


#: Ranges of row ids that share a key's places.
ID_BINS = 1024


def stable_places(df: DataFrame, keys: list[str], short: str, row_id: str) -> DataFrame:
    """Each row's place (from 1) in its group by a short key, ties by a whole-number row id; null keys and ids come first.

    A counting sort: rows are counted by (group, short key, range of ids), places before a range are sums of counts, and only
    rows of one range are ordered together. So a group of any size is ranked by many tasks.
    """
    ends = df.agg(F.min(row_id), F.max(row_id)).first()
    width = max(1, -(-((ends[1] or 0) - (ends[0] or 0) + 1) // ID_BINS))
    own = F.coalesce(F.floor((F.col(row_id) - (ends[0] or 0)) / width), F.lit(-1)).cast("int")
    rows = df.withColumn("__bin", own)
    before = W.partitionBy(*keys).orderBy(short, "__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = rows.groupBy(*keys, short, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    bins = bins.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").withColumnsRenamed({c: f"__of_{c}" for c in (*keys, short)}).withColumnRenamed("__bin", "__of_bin")
    same = F.col("__bin") == F.col("__of_bin")
    for c in (*keys, short):
        same &= rows[c].eqNullSafe(bins[f"__of_{c}"])
    inside = F.row_number().over(W.partitionBy(*keys, short, "__bin").orderBy(row_id))
    placed = rows.withColumn("__in", inside).join(bins, same)
    return placed.withColumn("place", (F.col("__before") + F.col("__in")).cast("int")).drop("__bin", "__in", "__before", *[c for c in bins.columns if c.startswith("__of_")])


def mip_levels(df: DataFrame, w: str, h: str) -> DataFrame:
    """A row a mip level, down to 1 x 1."""
    last = F.floor(F.log2(F.greatest(w, h).cast("double"))).cast("int")
    rows = df.withColumn("level", F.explode(F.sequence(F.lit(0), last)))
    shrink = lambda c: F.greatest(F.expr(f"shiftright({c}, level)"), F.lit(1))
    return rows.withColumn("level_w", shrink(w)).withColumn("level_h", shrink(h))


def causal_predictor(blocks: DataFrame, key: list[str], bx: str, by: str, v: str) -> DataFrame:
    """The first of the left, upper and upper-left neighbours with an equal value: 0, 1, 2, or 3 for none.

    Neighbours are equi-joins on the block's place, so a slice may span tasks.
    """
    out = blocks
    for i, (dx, dy) in enumerate(((1, 0), (0, 1), (1, 1))):
        near = blocks.select(*key, (F.col(bx) + dx).alias(bx), (F.col(by) + dy).alias(by), F.col(v).alias(f"__n{i}"))
        out = out.join(near, [*key, bx, by], "left")
    same = F.lit(3)
    for i in (2, 1, 0):
        same = F.when(F.col(f"__n{i}").eqNullSafe(F.col(v)) & F.col(v).isNotNull(), i).otherwise(same)
    return out.withColumn("predictor", same).drop("__n0", "__n1", "__n2")
