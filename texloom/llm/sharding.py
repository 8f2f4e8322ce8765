"""Reproducible shuffle and shards by a Feistel permutation of row numbers (operator 1).

Rows get global numbers in the order of (bucket of the id, id, size, CRC-32 of the text): a window inside
each of a fixed number of buckets, plus the rows of the buckets before, which are counted first. A keyed
Feistel network over two coordinates a * b >= n permutes 0..n-1; a value outside 0..n-1 is permuted again
until it is inside (cycle walking; a * b - n < a, so that is rare). Position p goes to shard p mod k, slot
p div k: shards differ by one row at most, and where a row goes, or which row a slot holds, can be computed
from n alone (`position_of`, `row_at`).

The plan has one shuffle of (id, size, checksum, columns kept) by bucket; texts stay where they are read.
The table of buckets is broadcast; it has BUCKETS rows for input of any size.

Defined results: a null text has size 1 and checksum 0; a null id falls into bucket 0, before other ids;
equal rows are numbered one after the other in any order, which changes no result row; an empty table
gives an empty result; an input column named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS, ROUNDS, STEPS = 1024, 6, 64
RESULTS = ("size", "text_crc32", "shard", "slot")


def _round(value: str, r: int, seed: int) -> str:
    return f"cast(conv(substr(md5(concat('{seed}:{r}:', cast({value} as string))), 1, 8), 16, 10) as bigint)"


def _network(x: str, seed: int) -> str:
    """SQL of one pass of the network over the value x, with its sizes in columns __a and __b."""
    left, right = f"({x} div __b)", f"({x} % __b)"
    for r in range(ROUNDS):
        if r % 2:
            right = f"(({right} + {_round(left, r, seed)}) % __b)"
        else:
            left = f"(({left} + {_round(right, r, seed)}) % __a)"
    return f"({left} * __b + {right})"


def _coordinates(n: int) -> tuple[int, int]:
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def _digest(value: int, r: int, seed: int) -> int:
    return int(hashlib.md5(f"{seed}:{r}:{value}".encode()).hexdigest()[:8], 16)


def position_of(row: int, n: int, seed: int) -> int:
    """Where the permutation of n rows puts a row number."""
    a, b = _coordinates(n)
    while True:
        left, right = divmod(row, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _digest(left, r, seed)) % b
            else:
                left = (left + _digest(right, r, seed)) % a
        row = left * b + right
        if row < n:
            return row


def row_at(position: int, n: int, seed: int) -> int:
    """The row number that the permutation puts at a position."""
    a, b = _coordinates(n)
    while True:
        left, right = divmod(position, b)
        for r in reversed(range(ROUNDS)):
            if r % 2:
                right = (right - _digest(left, r, seed)) % b
            else:
                left = (left - _digest(right, r, seed)) % a
        position = left * b + right
        if position < n:
            return position


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Append RESULTS: size in bytes plus 1, checksum, shard and slot."""
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bucket = F.coalesce(F.expr(f"cast(conv(substr(md5(cast(`{id_col}` as string)), 1, 8), 16, 10) as bigint) % {BUCKETS}"), F.lit(0)).alias("__bucket")
    counts = docs.groupBy(bucket).agg(F.count(F.lit(1)).alias("__rows"))
    every, before = W.orderBy("__bucket"), W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("__rows").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = (
        counts.select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), total.alias("__n"))
        .withColumn("__a", F.ceil(F.sqrt("__n")).cast("long"))
        .withColumn("__b", F.expr("(__n + __a - 1) div __a"))
    )
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{id_col}`").alias("__id"), bucket, size.alias("size"), F.crc32(text).alias("text_crc32"))
    order = W.partitionBy("__bucket").orderBy("__id", "size", "text_crc32")
    numbered = rows.withColumn("__row", F.row_number().over(order).cast("long") - 1)
    placed = numbered.join(F.broadcast(offsets), "__bucket").withColumn("__x", F.col("__before") + F.col("__row"))
    placed = placed.withColumn("__p", F.expr(_network("__x", seed)))
    walk = f"aggregate(sequence(1, {STEPS}), __p, (p, i) -> CASE WHEN p < __n THEN p ELSE {_network('p', seed)} END)"
    placed = placed.withColumn("__q", F.expr(f"CASE WHEN __p < __n THEN __p ELSE {walk} END"))
    placed = placed.withColumn("__q", F.expr("CASE WHEN __q < __n THEN __q ELSE cast(raise_error('cycle walk did not end') as bigint) END"))
    return placed.select(*[F.col(f"`{c}`") for c in stay], "size", "text_crc32", F.expr(f"cast(__q % {shards} as int)").alias("shard"), F.expr(f"__q div {shards}").alias("slot"))

