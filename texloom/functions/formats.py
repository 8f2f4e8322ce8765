"""Dimension tables of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The block sizes of the variable-footprint block format.
BLOCK_SIZES = ((4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (10, 5), (10, 6), (8, 8), (10, 8), (10, 10), (12, 10), (12, 12))
#: Bytes of a 4x4 block.
BLOCK_BYTES = {"BC1": 8, "BC3": 16, "BC4": 8, "BC5": 16, "ETC1": 8, "EAC_A8": 8, "EAC_R11": 8, "ATC": 8, "ETC2_RGBA": 16}


def block_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLOCK_SIZES, "w int, h int")


def is_block_size(w: Column, h: Column) -> Column:
    return F.concat_ws("x", w, h).isin(*[f"{a}x{b}" for a, b in BLOCK_SIZES])


def choose_format(family: Column, has_alpha: Column, is_hdr: Column) -> Column:
    """The concrete format of a family for an image with or without alpha, in low or high range."""
    return (
        F.when((family == "BC") & is_hdr, "BC6H")
        .when((family == "BC") & has_alpha, "BC3")
        .when(family == "BC", "BC1")
        .when((family == "ASTC") & is_hdr, "ASTC_HDR_4x4")
        .when(family == "ASTC", "ASTC_LDR_4x4")
        .when((family == "ETC") & has_alpha, "ETC2_RGBA")
        .when(family == "ETC", "ETC1_RGB")
        .when((family == "PVRTC") & has_alpha, "PVRTC1_4_RGBA")
        .when(family == "PVRTC", "PVRTC1_4_RGB")
        .when(is_hdr, "RGBA_HALF")
        .otherwise("RGBA32")
    )
