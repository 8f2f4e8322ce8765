"""Nearest-code joins, neighbours and vector quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import joins
from texloom.plans.carriers import table
from texloom.registry import query


@query(
    "nearest_codeword",
    """WITH cb AS (SELECT vec_id AS code, embedding AS c FROM embeddings WHERE vec_id < 16),
x AS (SELECT e.vec_id, code, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]::DOUBLE) * (embedding[i]::DOUBLE - c[i]::DOUBLE))) AS d FROM embeddings e, cb),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS k FROM x) SELECT vec_id, code, round(d, 6) AS error FROM r WHERE k = 1""",
)
def nearest_codeword(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    codes = rows.where("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("embedding").alias("c"))
    return joins.nearest_code(rows, codes, "vec_id", "embedding", "code", "c").withColumn("error", F.round("error", 6))


@query(
    "nearest_codeword_of_parent",
    """WITH cb AS (SELECT label, vec_id AS code, embedding AS c FROM embeddings WHERE vec_id < 64),
x AS (SELECT e.vec_id, code, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]::DOUBLE) * (embedding[i]::DOUBLE - c[i]::DOUBLE))) AS d FROM embeddings e JOIN cb ON e.label = cb.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS k FROM x) SELECT vec_id, code, round(d, 6) AS error FROM r WHERE k = 1""",
)
def nearest_codeword_of_parent(spark, sf_dir):
    """The codes of a label are those of its rows with vec_id < 64, or else its row of least id: every label has one."""
    rows = table(spark, sf_dir, "embeddings")
    codes = rows.where("vec_id < 64").select("label", F.col("vec_id").alias("code"), F.col("embedding").alias("c"))
    first = rows.groupBy("label").agg(F.min("vec_id").alias("code"), F.min_by("embedding", "vec_id").alias("c"))
    codes = codes.union(first.where("code >= 64"))
    return joins.nearest_code(rows.select("vec_id", "label", "embedding"), codes, "vec_id", "embedding", "code", "c", "label").withColumn("error", F.round("error", 6))


@query(
    "hamming_neighbors",
    """WITH e AS (SELECT vec_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN embedding[i] > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS code FROM embeddings),
x AS (SELECT a.vec_id, b.vec_id AS pattern_id, bit_count(xor(a.code, b.code))::INT AS bits FROM e a, e b WHERE b.vec_id < 100),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY bits, pattern_id)::INT AS rank FROM x) SELECT vec_id, rank, pattern_id, bits FROM r WHERE rank <= 3""",
)
def hamming_neighbors(spark, sf_dir):
    rows = _sign_bits(spark, sf_dir)
    patterns = rows.select(F.col("vec_id").alias("pattern_id"), F.col("code").alias("pattern"))
    return joins.hamming_neighbors(rows, patterns, "vec_id", "code", "pattern_id", "pattern", 3)


def _sign_bits(spark, sf_dir):
    bits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(F.get(F.col("embedding"), i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("code"))


@query(
    "band_candidates",
    """WITH e AS (SELECT vec_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN embedding[i] > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS code FROM embeddings),
k AS (SELECT vec_id, unnest([0, 1])::INT AS band, code FROM e), b AS (SELECT vec_id, band, (code >> (8 * band)) & 255 AS v FROM k)
SELECT DISTINCT x.vec_id, y.vec_id AS other FROM b x JOIN b y ON x.band = y.band AND x.v = y.v AND x.vec_id < y.vec_id""",
)
def band_candidates(spark, sf_dir):
    return joins.band_candidates(_sign_bits(spark, sf_dir), "vec_id", F.col("code"), 2, 8)


@query(
    "nearest_level",
    """WITH l AS (SELECT unnest([0, 11, 23, 36, 50]) AS v, unnest(range(0, 5)) AS i), q AS (SELECT DISTINCT l_quantity::INT AS v FROM lineitem)
SELECT q.v, arg_min(l.i, abs(q.v - l.v) * 100 + l.i)::INT AS level FROM q, l GROUP BY 1""",
)
def nearest_level(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(q.alias("v")).distinct().select("v", joins.nearest_level(F.col("v"), [0, 11, 23, 36, 50]).alias("level"))


@query(
    "best_selectors",
    """WITH e AS (SELECT l_suppkey AS cluster, l_linenumber AS texel, s, sum(abs(l_quantity - 12 * s))::DOUBLE AS err FROM lineitem, (SELECT unnest(range(0, 5))::INT AS s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, texel ORDER BY err, s) AS k FROM e) SELECT cluster, texel, s AS selector, err FROM r WHERE k = 1""",
)
def best_selectors(spark, sf_dir):
    """For each cluster and texel the selector of least summed error, in one aggregate: no row a selector."""
    errors = [F.sum(F.abs(F.col("l_quantity") - 12 * s)).alias(f"e{s}") for s in range(5)]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster"), F.col("l_linenumber").alias("texel")).agg(*errors)
    best = F.array_min(F.array(*[F.struct(F.col(f"e{s}").alias("err"), F.lit(s).alias("s")) for s in range(5)]))
    return rows.select("cluster", "texel", best["s"].alias("selector"), best["err"].alias("err"))
