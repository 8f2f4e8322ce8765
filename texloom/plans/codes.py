"""Sizes of codes, code lengths and reordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import integers
from texloom.operators import entropy
from texloom.plans.carriers import frames, table
from texloom.registry import query


@query(
    "code_sizes",
    """WITH k AS (SELECT o_orderkey AS v FROM orders), b AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS n FROM k)
SELECT v, (v >> 3) + 4 AS rice, greatest(ceil(n / 4.0), 1)::BIGINT * 5 AS chunked, greatest(ceil(n / 7.0), 1)::BIGINT AS varint,
  CASE WHEN v % 100 < 28 THEN 6 ELSE 7 END AS truncated_binary,
  12 + CASE WHEN least(v, 32767) < 4 THEN 0 ELSE floor(log2(least(v, 32767) + 0.5))::INT - 1 END + CASE WHEN v < 32768 THEN 0 ELSE floor(log2(v + 0.5))::INT - 14 END AS match_cost FROM b""",
)
def code_sizes(spark, sf_dir):
    v = F.col("v")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v")).select(
        "v",
        integers.rice_bits(v, 3).alias("rice"),
        integers.chunked_bits(v, 4).alias("chunked"),
        integers.varint_bytes(v).alias("varint"),
        integers.truncated_binary_bits(v % 100, F.lit(100)).alias("truncated_binary"),
        integers.match_cost(v).alias("match_cost"),
    )


@query(
    "raw_bits",
    "SELECT l_returnflag, sum(CASE WHEN l_quantity < 1 THEN 0 ELSE length(bin(l_quantity::BIGINT)) END)::BIGINT AS bits FROM lineitem GROUP BY 1",
)
def raw_bits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(integers.bit_length(F.col("l_quantity").cast("long"))).alias("bits"))


@query("huffman_lengths")
def huffman_lengths(spark, sf_dir):
    """Minimum-redundancy code lengths of at most 16 bits, a code table a group."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("sym"))
    return entropy.code_table(rows, ["l_returnflag"], "sym", 16)


@query("huffman_stream_size")
def huffman_stream_size(spark, sf_dir):
    """Bits of each group's symbols under its code table, beside their entropy."""
    from texloom.operators.stats import entropy_bits

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("sym"))
    codes = entropy.code_table(rows, ["l_returnflag"], "sym", 16)
    size = codes.groupBy("l_returnflag").agg(F.sum(F.col("freq") * F.col("length")).alias("code_bits"))
    return size.join(entropy_bits(rows, ["l_returnflag"], "sym"), "l_returnflag")


@query("palette_reorder")
def palette_reorder(spark, sf_dir):
    """Symbols in an order that puts frequent neighbours side by side."""
    from texloom.operators.ordered import pair_counts

    rows = frames(spark, sf_dir)
    return entropy.reorder_palette(pair_counts(rows, ["user_id"], ["ts", "event_id"], "event_type"), rows.select("event_type"))


@query("selector_tour")
def selector_tour(spark, sf_dir):
    """Codes of 16 bits in a greedy tour of least Hamming steps."""
    from texloom.plans.codebooks import _sign_bits

    return entropy.hamming_tour(_sign_bits(spark, sf_dir).select("code").distinct(), "code")


@query("deflated_sizes")
def deflated_sizes(spark, sf_dir):
    """Sizes of the texts as DEFLATE streams, and whether they come back."""
    return entropy.deflate_sizes(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")


@query("blob_container")
def blob_container(spark, sf_dir):
    """Texts by source in tagged blobs, compressed where that saves a 400th, and read back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("data"))
    return entropy.blob_round_trip(rows, "doc_id", "source", "data")


@query(
    "checksums",
    """SELECT doc_id, xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: [('0x' || h)::BIGINT << 8, 0, 0, 0, 0, 0, 0, 0])),
  lambda c, e: xor((xor(c, e) << 1) & 65535, 4129 * (xor(c, e) >> 15)), 65535::BIGINT), 65535)::INT AS crc FROM documents""",
)
def checksums(spark, sf_dir):
    """CRC-16 of each text."""
    return entropy.crc16(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")


@query("symbol_streams")
def symbol_streams(spark, sf_dir):
    """Event types a user as prefix-coded streams with their tables, by stripe, read back."""
    from pyspark.sql import Window as W

    from texloom.operators.bitstream import code_streams

    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kinds = ("click", "error", "purchase", "signup", "view")
    symbol = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")), F.lit(0)).cast("int")
    return code_streams(frames(spark, sf_dir).select("user_id", at.alias("at"), symbol.alias("sym")), "user_id", "at", "sym", 6)


@query(
    "text_grid",
    "WITH f AS (SELECT l_orderkey, max(l_quantity::INT) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey // 64 AS y, string_agg(q || ' ' || q % 4, ', ' ORDER BY l_orderkey % 64) AS value FROM f GROUP BY 1",
)
def text_grid(spark, sf_dir):
    from texloom.api import text_grid as grid

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_quantity").cast("int")).alias("q"))
    return grid(rows.select(F.expr("l_orderkey % 64").alias("x"), F.expr("l_orderkey div 64").alias("y"), F.col("q").alias("r"), (F.col("q") % 4).alias("g")), ["r", "g"])
