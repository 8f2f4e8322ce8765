"""Mixing sources to target weights by weighted fair queueing (operator 10).

Each source queues its documents in a shuffled order, `repeats` times over. A document's virtual finish
time is its source's tokens up to and including it, divided by the source's weight. In the order of finish
times documents are served until the budget is spent: a source with twice the weight gives twice the
tokens, and one that runs out leaves its share to the others by weight.

Nothing is sorted in one task. Running sums come from sums over (source, slice of the shuffled order)
and a window inside each slice, so a source with most of the rows is spread over SLICES tasks. The
cut in the global order is found by range: token sums over BINS ranges of finish time, then over BINS
ranges of the one that holds the cut, until that holds few rows, which alone are sorted. The driver sees
BINS sums a round and LAST rows.

Defined results: a null source is a source of its own, after all others; a size of 0 or null is never
taken and takes nothing; documents are ordered by a keyed hash of their id, then id, then size; equal rows
take one of their places each; an empty table gives an empty result; an input column named like a result
gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texloom.llm.common import written

SLICES, BINS, LAST = 1024, 4096, 2000
WORDS = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), in the engine."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(__source, size) -> source_size, weight and target of each source: shares by weight, none above `repeats` times its
    size, the excess reshared. One row a source."""
    rank = F.row_number().over(W.orderBy(F.col("__source").isNull(), "__source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.orderBy("__level", "__source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("__level", "__source").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("__cap", F.col("source_size") * repeats).withColumn("__level", F.col("__cap") / F.col("weight"))
    rows = (
        rows.withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__spent", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__try", (F.col("__budget") - F.col("__spent")) / F.col("__left"))
        .withColumn("__at", F.row_number().over(W.orderBy("__level", "__source")))
    )
    first = F.min(F.when(F.col("__try") <= F.col("__level"), F.struct("__at", "__try"))).over(everything)
    rows = rows.withColumn("__fill", first.getField("__try"))
    target = F.when(F.col("__fill").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("__fill") * F.col("weight")))
    return rows.select("__source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 23,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append RESULTS: how often the mix takes each row (copies, 0 to repeats), and its tokens times that (taken).

    size: expression of a row's tokens. weights: of the sources in order of code points, repeating. share:
    the budget as a multiple of all tokens.
    """
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    key = F.expr(f"cast(conv(substr(md5(concat('{seed}:', cast(`{id_col}` as string))), 1, 8), 16, 10) as bigint)")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in stay],
        F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{source_col}`").cast("string").alias("__source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.coalesce(key, F.lit(0)).alias("__key"),
    )
    rows = written(rows.withColumn("__slice", F.expr(f"cast(__key div {(1 << 32) // SLICES} as int)")), "mix-rows")
    slices = written(rows.groupBy("__source", "__slice").agg(F.sum("size").alias("__sum")), "mix-slices")
    sizes = slices.groupBy("__source").agg(F.sum("__sum").alias("source_size"))
    sources = source_targets(sizes, weights, share, repeats)
    before = W.partitionBy("__source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    slices = slices.join(sources, slices["__source"].eqNullSafe(sources["__source"])).drop(sources["__source"]).withColumnRenamed("__source", "__s").withColumnRenamed("__slice", "__k")
    order = W.partitionBy("__source", "__slice").orderBy("__key", "__id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("__in", F.sum("size").over(order))
    placed = summed.join(slices, summed["__source"].eqNullSafe(slices["__s"]) & (summed["__slice"] == slices["__k"]))
    placed = written(placed.withColumn("__upto", F.col("__before") + F.col("__in")).drop("__s", "__k", "__sum", "__before", "__in"), "mix-placed")
    cut = _cut(placed, share, repeats)
    if cut is None:
        copies = F.lit(0)
    else:
        time, tie_key, tie_id, epoch = cut
        copies = sum((F.when(_upto(F.lit(e), time, tie_key, tie_id, epoch), 1).otherwise(0) for e in range(repeats)), F.lit(0))
        copies = F.when(F.col("size") > 0, copies).otherwise(0)
    out = placed.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"`{c}`") for c in stay], *RESULTS)


def _finish(epoch: Column) -> Column:
    return (F.col("source_size") * epoch + F.col("__upto")) / F.col("weight")


def _upto(e: Column, time: float, tie_key: int, tie_id, epoch: int) -> Column:
    """Whether occurrence e of a row is served no later than the cut."""
    f = _finish(e)
    same_id = F.col("__id").eqNullSafe(F.lit(tie_id))
    earlier = F.col("__id").isNull() if tie_id is None else F.col("__id").isNull() | (F.col("__id") < F.lit(tie_id))
    tie = (F.col("__key") < tie_key) | ((F.col("__key") == tie_key) & (F.when(same_id, e <= epoch).otherwise(earlier)))
    return (f < time) | ((f == time) & tie)


def _cut(placed: DataFrame, share: float, repeats: int):
    """The last occurrence served, in the order (finish time, key, id, epoch); None if there is none."""
    some = placed.where("size > 0")
    times = some.withColumn("__e", F.explode(F.array(*[F.lit(e) for e in range(repeats)]))).withColumn("__f", _finish(F.col("__e")))
    total, most = some.agg(F.sum("size"), F.max(_finish(F.lit(repeats - 1)))).first()
    if total is None:
        return None
    budget, low, high, spent = share * total, 0.0, float(most), 0
    inside = None
    while True:
        width = (high - low) / BINS
        inside = times.where((F.col("__f") > low) & (F.col("__f") <= high)) if inside is not None else times
        if not width or low + width <= low:
            break
        bin_no = F.least(F.greatest(F.ceil((F.col("__f") - low) / width) - 1, F.lit(0)), F.lit(BINS - 1)).cast("int")
        sums = inside.groupBy(bin_no.alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("__f").alias("lo"), F.max("__f").alias("hi"))
        found, last_before = None, low
        for b, s, n, lo, hi in sorted(sums.collect()):
            if spent + s > budget:
                found = (n, last_before, hi)
                break
            spent, last_before = spent + s, hi
        if found is None:
            return (float(most), 1 << 40, None, repeats)
        n, low, high = found
        if n <= LAST or low >= high:
            break
    inside = times.where((F.col("__f") > low) & (F.col("__f") <= high))
    running = F.sum("size").over(W.orderBy("__f", "__key", "__id", "__e").rowsBetween(W.unboundedPreceding, 0))
    last = (
        inside.withColumn("__run", running + F.lit(spent)).where(F.col("__run") <= budget).orderBy(F.desc("__run")).select("__f", "__key", "__id", "__e").first()
    )
    return (low, 1 << 40, None, repeats) if last is None else tuple(last)
