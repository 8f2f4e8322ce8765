"""Distinct, merge and selection operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_distinct(df: DataFrame, columns: list[str], weight: str, row_id: str | None = None) -> DataFrame:
    """Equal vectors as one, with summed weight and how many there were; with row_id, their smallest id names them."""
    name = [F.min(row_id).alias("first_id")] if row_id else []
    return df.groupBy(*columns).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("members"), *name)


def dense_ids(df: DataFrame, column: str, name: str = "new_id") -> DataFrame:
    """Distinct values with dense ids in their order. One task orders the distinct values: a codebook, not rows."""
    return df.select(column).distinct().withColumn(name, F.row_number().over(W.orderBy(column)) - 1)


def ensure_rows(df: DataFrame, needed: DataFrame) -> DataFrame:
    """df and those rows of `needed` that it lacks."""
    return df.unionByName(needed.join(df, df.columns, "left_anti")).distinct()


def worst(df: DataFrame, error: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of largest error."""
    return df.orderBy(F.desc(error), *ties).limit(k)


def shortlist(df: DataFrame, keys: list[str], cost: str, ties: list[str], k: int) -> DataFrame:
    """The k cheapest candidates of each group, ranked."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(cost, *ties))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_equal(clusters: DataFrame, parameters: list[str], cluster_id: str) -> DataFrame:
    """Clusters with equal parameters as one: its id is the smallest, `merged` says how many."""
    return clusters.groupBy(*parameters).agg(F.min(cluster_id).alias(cluster_id), F.count(F.lit(1)).alias("merged"))


def used_entries(entries: DataFrame, rows: DataFrame, entry_id: str, reference: str) -> DataFrame:
    """Entries that some row refers to."""
    return entries.join(rows.select(F.col(reference).alias(entry_id)), entry_id, "left_semi")
