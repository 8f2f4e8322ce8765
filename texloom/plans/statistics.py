"""Statistics, metrics and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import stats
from texloom.plans.carriers import channel_pairs, frames, pixels, table
from texloom.registry import query

_PAIRS = "p AS (SELECT l_returnflag, l_linestatus, l_quantity::INT AS a, (floor(l_quantity / 4 + 0.5) * 4)::INT AS b FROM lineitem)"
_PIXELS = "px AS (SELECT l_orderkey, l_linenumber, l_quantity::INT * 5 AS r, round(l_tax * 100)::INT * 30 AS g, l_linenumber * 36 AS b, round(l_discount * 100)::INT * 25 AS a FROM lineitem)"


@query(
    "compare_metrics",
    f"""WITH {_PAIRS},
m AS (SELECT l_returnflag, l_linestatus, max(abs(a - b)) AS largest, avg(abs(a - b)) AS mean, avg((a - b) * (a - b)) AS mse FROM p GROUP BY 1, 2),
h AS (SELECT l_returnflag, l_linestatus, a, count(*) AS c FROM p GROUP BY ALL),
e AS (SELECT l_returnflag, l_linestatus, sum(c) * log2(sum(c)) - sum(c * log2(c)) AS bits, sum(c)::BIGINT AS symbols, count(*) AS alphabet FROM h GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, largest, mean, mse, sqrt(mse) AS rms,
  CASE WHEN mse = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 20 * log10(255.0 / sqrt(mse)))) END AS psnr, round(bits, 4) AS bits, symbols, alphabet
FROM m JOIN e USING (l_returnflag, l_linestatus)""",
)
def compare_metrics(spark, sf_dir):
    pairs = channel_pairs(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    metrics = pairs.groupBy(*keys).agg(*stats.compare_stats(F.col("a") - F.col("b")))
    entropy = stats.entropy_bits(pairs, keys, "a").withColumn("bits", F.round("bits", 4))
    return metrics.join(entropy, keys)


@query(
    "running_stats",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean,
  round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 4) AS deviation, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY 1""",
)
def running_stats(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*stats.running_stats(F.col("l_extendedprice")))
    return out.select("l_returnflag", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("deviation", 4).alias("deviation"), "low", "high")


@query(
    "full_stats",
    """WITH m AS (SELECT l_linestatus, avg(l_quantity) AS mu FROM lineitem GROUP BY 1),
d AS (SELECT l.l_linestatus, l_quantity AS v, l_quantity - mu AS x FROM lineitem l JOIN m USING (l_linestatus))
SELECT l_linestatus, count(*) AS n, sum(v) AS total, sum(v * v) AS squares, round(avg(v), 6) AS mean, round(sqrt(avg(v * v)), 6) AS rms,
  round(avg(x * x), 6) AS variance, round(sqrt(avg(x * x)), 6) AS deviation, round(avg(x * x * x) / power(avg(x * x), 1.5), 6) AS skew,
  round(avg(x * x * x * x) / power(avg(x * x), 2) - 3, 6) AS kurtosis, max(v) - min(v) AS span, round(sqrt(sum(v * v)), 4) AS norm,
  round(sqrt(avg(x * x)) / avg(v), 6) AS variation, round(avg(abs(x)), 6) AS mad
FROM d GROUP BY 1""",
)
def full_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    out = rows.groupBy("l_linestatus").agg(*stats.full_stats(F.col("l_quantity"))).join(stats.mean_absolute_deviation(rows, ["l_linestatus"], "l_quantity"), "l_linestatus")
    six = ("mean", "rms", "variance", "deviation", "skew", "kurtosis", "variation", "mad")
    return out.select("l_linestatus", "n", "total", "squares", *[F.round(c, 6).alias(c) for c in six], "span", F.round("norm", 4).alias("norm"))


@query(
    "median_tails",
    """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
t AS (SELECT *, least(greatest((n + 10) // 20, 1), n) AS tail FROM r)
SELECT event_type, round(avg(v) FILTER (k IN ((n + 1) // 2, n // 2 + 1)), 6) AS median, round(avg(v) FILTER (k <= tail), 6) AS low_tail, round(avg(v) FILTER (k > n - tail), 6) AS high_tail
FROM t GROUP BY 1""",
)
def median_tails(spark, sf_dir):
    out = stats.tails(frames(spark, sf_dir), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "low_tail", "high_tail")])


@query(
    "paired_stats",
    f"""WITH {_PAIRS}
SELECT l_returnflag, round(covar_pop(a, b), 6) AS covariance, round(corr(a, b), 6) AS pearson, round(avg((a - b) * (a - b)), 6) AS mse, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse,
  round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg(power(ln(1 + a) - ln(1 + b), 2))), 6) AS rmsle, round(sqrt(sum((a - b) * (a - b))), 6) AS euclid,
  round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine, min(abs(a - b)) AS least, max(abs(a - b)) AS most
FROM p GROUP BY 1""",
)
def paired_stats(spark, sf_dir):
    out = channel_pairs(spark, sf_dir).groupBy("l_returnflag").agg(*stats.paired_stats(F.col("a"), F.col("b")))
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("covariance", "pearson", "mse", "rmse", "mae", "rmsle", "euclid", "cosine")], "least", "most")


@query(
    "histogram_entropy",
    """WITH h AS (SELECT l_quantity::INT AS sym, count(*) AS c FROM lineitem GROUP BY 1)
SELECT round(sum(c) * log2(sum(c)) - sum(c * log2(c)), 4) AS bits, sum(c)::BIGINT AS symbols, count(*) AS alphabet FROM h""",
)
def histogram_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("sym"))
    return stats.entropy_bits(rows, [], "sym").withColumn("bits", F.round("bits", 4))


@query("histogram_total", "SELECT l_quantity::INT AS sym, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_total(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("sym")).agg(F.count("*").alias("n"))


@query(
    "difference_histogram",
    f"WITH {_PAIRS} SELECT a - b AS delta, count(*) AS n FROM p GROUP BY 1",
)
def difference_histogram(spark, sf_dir):
    return channel_pairs(spark, sf_dir).groupBy((F.col("a") - F.col("b")).alias("delta")).agg(F.count("*").alias("n"))


@query(
    "weighted_error_from_histogram",
    f"""WITH {_PAIRS}, h AS (SELECT abs(a - b) AS d, count(*) AS c FROM p GROUP BY 1)
SELECT max(d) AS largest, sum(d * c) / sum(c) AS mean, sum(d * d * c) / sum(c) AS mse FROM h""",
)
def weighted_error_from_histogram(spark, sf_dir):
    bins = channel_pairs(spark, sf_dir).groupBy(F.abs(F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("c"))
    total = F.sum("c")
    return bins.agg(F.max("d").alias("largest"), (F.sum(F.col("d") * F.col("c")) / total).alias("mean"), (F.sum(F.col("d") * F.col("d") * F.col("c")) / total).alias("mse"))


@query(
    "channel_summary",
    f"""WITH {_PIXELS}, u AS (SELECT 'r' AS channel, r::DOUBLE AS v FROM px UNION ALL SELECT 'g', g FROM px UNION ALL SELECT 'b', b FROM px UNION ALL SELECT 'a', a FROM px)
SELECT channel, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS variance, count(DISTINCT v) AS distinct_values, min(v) = max(v) AS constant FROM u GROUP BY 1""",
)
def channel_summary(spark, sf_dir):
    out = stats.channel_summary(pixels(spark, sf_dir), ["r", "g", "b", "a"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 4))


@query(
    "average_psnr",
    """WITH p AS (SELECT l_returnflag, l_linenumber, 20 + l_quantity * 1.7 AS psnr FROM lineitem)
SELECT l_returnflag, round(-10 * log10(sum(CASE WHEN psnr < 99 THEN power(10, -psnr / 10) ELSE 0 END) / count(*)), 6) AS psnr FROM p GROUP BY 1""",
)
def average_psnr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1.7 + 20).alias("p"))
    return rows.groupBy("l_returnflag").agg(F.round(stats.average_psnr(F.col("p")), 6).alias("psnr"))


@query(
    "psnr_report",
    """WITH p AS (SELECT l_linestatus, 20 + l_quantity * 1.7 AS v FROM lineitem), q AS (SELECT * FROM p WHERE v < 99)
SELECT l_linestatus, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, min(v) AS low, max(v) AS high, round(median(v), 6) AS middle FROM q GROUP BY 1""",
)
def psnr_report(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity") * 1.7 + 20).alias("v")).where("v < 99")
    middle = stats.tails(rows, ["l_linestatus"], "v").select(F.col("l_linestatus").alias("status"), F.round("median", 6).alias("middle"))
    found = rows.groupBy("l_linestatus").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high")
    )
    return found.join(middle, found["l_linestatus"].eqNullSafe(middle["status"])).drop("status")


@query(
    "rollup_report",
    "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def rollup_report(spark, sf_dir):
    # the engine broadcasts them by their size, if they are small
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_acctbal").alias("most"))


@query(
    "block_statistics",
    """SELECT l_returnflag AS mode, l_linestatus AS partition_kind, l_linenumber AS grid, count(*) AS n, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, grouping(l_linenumber)::INT AS g3
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())""",
)
def block_statistics(spark, sf_dir):
    return spark.sql(
        """SELECT l_returnflag AS mode, l_linestatus AS partition_kind, l_linenumber AS grid, count(*) AS n,
        cast(grouping(l_returnflag) AS int) AS g1, cast(grouping(l_linestatus) AS int) AS g2, cast(grouping(l_linenumber) AS int) AS g3
        FROM {rows} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())""",
        rows=table(spark, sf_dir, "lineitem"),
    )


@query(
    "covariance_matrix",
    """WITH v AS (SELECT unnest(range(1, 9)) AS i, embedding, label + 1 AS w FROM embeddings),
m AS (SELECT i, sum(w * embedding[i]::DOUBLE) / sum(w) AS mu FROM v GROUP BY 1),
x AS (SELECT a.i, b.i AS j, sum(a.w * a.embedding[a.i]::DOUBLE * a.embedding[b.i]::DOUBLE) / sum(a.w) AS s FROM v a, (SELECT unnest(range(1, 9)) AS i) b GROUP BY ALL)
SELECT x.i::INT AS i, x.j::INT AS j, round(s - p.mu * q.mu, 6) + 0.0 AS covariance FROM x JOIN m p ON p.i = x.i JOIN m q ON q.i = x.j""",
)
def covariance_matrix(spark, sf_dir):
    """Weighted covariance of all components, by one row of partial sums a task and no exploded pairs of rows."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") + 1).alias("w"))
    return stats.weighted_covariance(rows, "embedding", "w").withColumn("covariance", F.round("covariance", 6) + 0.0)


@query(
    "spread_about_mean",
    "SELECT label, round(var_samp(vec_id) * count(*), 3) AS spread, round(avg(vec_id), 6) AS mean FROM embeddings GROUP BY 1",
)
def spread_about_mean(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(stats.sum_of_squares_about_mean(v), 3).alias("spread"), F.round(F.avg(v), 6).alias("mean"))


@query(
    "merge_partial_stats",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1""",
)
def merge_partial_stats(spark, sf_dir):
    """Stripe statistics merged: partial sums by (group, stripe), then by group, as an explicit merge() would."""
    stripe = F.expr("l_orderkey % 16")
    part = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", stripe.alias("stripe")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.sum(F.expr("l_quantity * l_quantity")).alias("q"))
    return part.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


@query("count_key", "SELECT count(*) FILTER (event_type = 'click') AS n FROM events")
def count_key(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("n"))


@query(
    "mean_pixel",
    f"WITH {_PIXELS} SELECT round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, round(avg(a), 6) AS a FROM px",
)
def mean_pixel(spark, sf_dir):
    return pixels(spark, sf_dir).agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgba"])


@query(
    "image_flags",
    f"WITH {_PIXELS} SELECT l_linenumber, bool_or(a < 255) AS has_alpha, bool_and(r = g AND g = b) AS gray, min(r) = max(r) AS constant_r FROM px GROUP BY 1",
)
def image_flags(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("l_linenumber").agg(F.bool_or(F.col("a") < 255).alias("has_alpha"), F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("gray"), (F.min("r") == F.max("r")).alias("constant_r"))
