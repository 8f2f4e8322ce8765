"""Driver tables as the engine's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples a and their coarse copies b (multiples of 4)."""
    a = F.col("l_quantity").cast("int")
    b = (F.floor(F.col("l_quantity") / 4 + 0.5) * 4).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", a.alias("a"), b.alias("b"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as video: a user is a block position, time is the frame order, the type is the symbol."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels: three 8-bit channels."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity").cast("int") * 5).alias("r"),
        F.expr("cast(round(l_tax * 100) as int) * 30").alias("g"),
        (F.col("l_linenumber") * 36).alias("b"),
        F.expr("cast(round(l_discount * 100) as int) * 25").alias("a"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as blocks of a grid: order modulo 64 across, order div 64 down, the line of least number of each order.

    Lines without a number come after the others; of lines with equal numbers it is that of least quantity, null last.
    """
    number, q = F.col("l_linenumber"), F.rint("l_quantity").cast("int")
    line = F.struct(number.isNull(), number, q.isNull(), q.alias("q"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(line)["q"].alias("q"))
    return rows.select(F.expr("l_orderkey % 64").alias("bx"), F.expr("l_orderkey div 64").alias("by"), F.expr("q % 4").alias("endpoint"), "q")
