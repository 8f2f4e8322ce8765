"""Grouped statistics: every function returns aggregate columns, so the engine aggregates partially before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.functions.integers import clamp


def running_stats(v: Column) -> list[Column]:
    """Count, total, mean, sample variance and deviation, extremes."""
    return [
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.var_samp(v).alias("variance"),
        F.stddev_samp(v).alias("deviation"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    ]


def full_stats(v: Column) -> list[Column]:
    """Population moments: with skewness, excess kurtosis, root mean square, range, norm, coefficient of variation."""
    return [
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.sum(v * v).alias("squares"),
        F.avg(v).alias("mean"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.var_pop(v).alias("variance"),
        F.stddev_pop(v).alias("deviation"),
        F.skewness(v).alias("skew"),
        F.kurtosis(v).alias("kurtosis"),
        (F.max(v) - F.min(v)).alias("span"),
        F.sqrt(F.sum(v * v)).alias("norm"),
        F.try_divide(F.stddev_pop(v), F.avg(v)).alias("variation"),
    ]


def mean_absolute_deviation(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Mean distance from the group's mean, joined from a small aggregate."""
    mean = df.groupBy(*keys).agg(F.avg(v).alias("__mean"))
    return df.join(mean, keys).groupBy(*keys).agg(F.avg(F.abs(F.col(v) - F.col("__mean"))).alias("mad"))


def paired_stats(a: Column, b: Column) -> list[Column]:
    """Two columns against each other."""
    d = a - b
    return [
        F.covar_pop(a, b).alias("covariance"),
        F.corr(a, b).alias("pearson"),
        F.avg(d * d).alias("mse"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(F.pow(F.log1p(a) - F.log1p(b), F.lit(2.0)))).alias("rmsle"),
        F.sqrt(F.sum(d * d)).alias("euclid"),
        F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))).alias("cosine"),
        F.min(F.abs(d)).alias("least"),
        F.max(F.abs(d)).alias("most"),
    ]


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in 0..100; 100 where nothing differs."""
    safe = F.when(mse > 0, mse)
    return F.when(safe.isNull(), 100.0).otherwise(clamp(F.log10(F.lit(peak) / F.sqrt(safe)) * 20.0, 0.0, 100.0))


def compare_stats(d: Column) -> list[Column]:
    """Metrics of a difference column: largest, mean, mean square, root of it, PSNR."""
    mse = F.avg(d * d)
    return [F.max(F.abs(d)).alias("largest"), F.avg(F.abs(d)).alias("mean"), mse.alias("mse"), F.sqrt(mse).alias("rms"), psnr(mse).alias("psnr")]


def entropy_bits(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Total bits of the symbols of each group under their own histogram."""
    histogram = df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("__c"))
    c, n = F.col("__c"), F.sum("__c")
    return histogram.groupBy(*keys).agg((n * F.log2(n.cast("double")) - F.sum(c * F.log2(c.cast("double")))).alias("bits"), n.alias("symbols"), F.count(F.lit(1)).alias("alphabet"))


#: Ranges of values that a group is cut into before its values are ranked.
VALUE_BINS = 1024


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null ones too; b's keys go. b has few rows a key, so the engine broadcasts it where it is small."""
    other = b.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return a.join(other, reduce(Column.__and__, [a[k].eqNullSafe(other[f"__of_{k}"]) for k in keys], F.lit(True))).drop(*[f"__of_{k}" for k in keys])


def tails(df: DataFrame, keys: list[str], v: str, ties: list[str] | None = None) -> DataFrame:
    """Median (mean of the middle two) and means of the lowest and highest twentieth: clamp((n + 10) div 20, 1, n) values.

    A group of any size is ranked by many tasks: equal values are counted first, then the values of each of VALUE_BINS ranges
    between the group's ends are ordered by themselves, behind the counts of the ranges before. Nulls rank first and are in
    no mean; NaN ranks last.
    """
    counted = df.groupBy(*keys, F.col(v).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ends = counted.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__c").alias("__n"))
    wide = F.col("__high") - F.col("__low")
    share = F.when(wide > 0, (F.col("__v") - F.col("__low")) / F.when(wide > 0, wide) * VALUE_BINS)
    place = F.when(F.col("__v").isNull(), -1).when(share.isNull() | F.isnan(share), 0).otherwise(F.least(F.floor(share), F.lit(VALUE_BINS - 1)).cast("int"))
    binned = _same(counted, ends, keys).withColumn("__bin", place)
    before = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    upto = W.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = _same(binned, bins, [*keys, "__bin"]).withColumn("__last", F.col("__before") + F.sum("__c").over(upto))
    n, first = F.col("__n"), F.col("__last") - F.col("__c") + 1
    k = clamp(F.floor((n + 10) / 20), 1, n)

    def mean(low: Column, high: Column) -> Column:
        taken = F.greatest(F.least(high, F.col("__last")) - F.greatest(low, first) + 1, F.lit(0))
        taken = F.when((taken > 0) & F.col("__v").isNotNull(), taken)
        return F.sum(F.col("__v") * taken) / F.sum(taken)

    return ranked.groupBy(*keys).agg(
        mean(F.floor((n + 1) / 2), F.floor(n / 2) + 1).alias("median"), mean(F.lit(1), k).alias("low_tail"), mean(n - k + 1, n).alias("high_tail")
    )


def average_psnr(p: Column, lossless: float = 99.0) -> Column:
    """Mean over squared errors: lossless rows add no error but count; within 0..100."""
    error = F.sum(F.when(p < lossless, F.pow(F.lit(10.0), p / -10.0)).otherwise(0.0)) / F.count(p)
    return F.when(error > 0, clamp(F.log10(F.when(error > 0, error)) * -10.0, 0.0, 100.0)).otherwise(100.0)


def sum_of_squares_about_mean(v: Column) -> Column:
    return F.coalesce(F.var_samp(v) * F.count(v), F.lit(0.0))


def weighted_covariance(df: DataFrame, vector: str, weight: str) -> DataFrame:
    """(i, j, covariance) for all components, counted from 1. Rows without a vector or weight are left out; vectors of unequal size
    are an error. A task sends its sums of weights, components and products; the driver holds one matrix."""
    data = df.where(F.col(vector).isNotNull() & F.col(weight).isNotNull()).select(vector, F.col(weight).cast("double"))
    partial = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for n in np.unique(sizes):
                own = pa.array(sizes == n)
                v = np.asarray(batch.column(0).filter(own).flatten(), np.float64).reshape(-1, n)
                w = np.asarray(batch.column(1).filter(own))
                total[int(n)] = total.get(int(n), 0) + np.concatenate([[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()])
        for n, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), n, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=partial.names)

    found = data.mapInArrow(run, partial).groupBy("size", "at").agg(F.sum("s").alias("s")).orderBy("size", "at").toArrow()
    sizes = found["size"].unique().to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sizes}")
    n, sums = (sizes or [0])[0], found["s"].to_numpy()
    mean = sums[1 : n + 1] / sums[0] if n else sums[:0]
    matrix = sums[n + 1 :].reshape(n, n) / sums[0] - np.outer(mean, mean) if n else np.zeros((0, 0))
    cells = [(i + 1, j + 1, float(matrix[i, j])) for i in range(n) for j in range(n)]
    return df.sparkSession.createDataFrame(cells, "i int, j int, covariance double")


def channel_summary(df: DataFrame, channels: list[str]) -> DataFrame:
    """A row a channel: extremes, moments, distinct values, whether constant. One scan; the channels are unpivoted first."""
    long_form = df.select(F.expr(f"stack({len(channels)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in channels) + ") as (channel, v)"))
    return long_form.groupBy("channel").agg(
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.avg("v").alias("mean"),
        F.var_pop("v").alias("variance"),
        F.countDistinct("v").alias("distinct_values"),
        (F.min("v") == F.max("v")).alias("constant"),
    )
