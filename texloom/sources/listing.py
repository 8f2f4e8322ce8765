"""Sources that name files: numbered sequences and listing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_files(spark: SparkSession, pattern: str, first: int, count: int) -> DataFrame:
    """(i, path) of a printf-style sequence."""
    return spark.range(first, first + count).select(F.col("id").cast("int").alias("i"), F.format_string(pattern, "id").alias("path"))


def listed_files(spark: SparkSession, listing: str) -> DataFrame:
    """The non-empty lines of a listing file, in order, without blanks and comment lines."""
    lines = spark.read.text(listing, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "path"))
    path = F.trim("path")
    return lines.select("i", path.alias("path")).where((F.length("path") > 0) & ~F.col("path").startswith("#"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, extension) of files of any kind."""
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1)).alias("extension"))
