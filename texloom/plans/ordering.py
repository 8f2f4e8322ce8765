"""Runs, differences, neighbours, offsets, sorts and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.operators import joins, ordered, sets
from texloom.plans.carriers import blocks, frames, pixels, table
from texloom.registry import query

_BLOCKS = "f AS (SELECT l_orderkey, min(l_quantity::INT) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), blk AS (SELECT l_orderkey % 64 AS bx, l_orderkey // 64 AS by, q % 4 AS endpoint, q FROM f)"
_ORDER = ["ts", "event_id"]


@query(
    "run_lengths",
    """WITH b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, min(r)::INT AS first_at, count(*) AS length FROM b GROUP BY user_id, event_type, r - k""",
)
def run_lengths(spark, sf_dir):
    return ordered.runs(frames(spark, sf_dir), ["user_id"], _ORDER, "event_type")


@query(
    "delta_coding",
    """WITH e AS (SELECT user_id, ts, event_id, round(value)::BIGINT AS v FROM events),
d AS (SELECT *, coalesce(lag(v) OVER w, 0) AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT (CASE WHEN prev >= 10 THEN 1 ELSE 0 END) + (CASE WHEN prev >= 22 THEN 1 ELSE 0 END) AS context, v - prev AS delta FROM d)
SELECT context, delta, count(*) AS n FROM x GROUP BY ALL""",
)
def delta_coding(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("v", F.round("value").cast("long"))
    rows = ordered.differences(rows, ["user_id"], _ORDER, "v").withColumn("prev", F.col("v") - F.col("delta"))
    return rows.groupBy(ordered.band(F.col("prev"), (10, 22)).alias("context"), "delta").agg(F.count("*").alias("n"))


@query(
    "xor_delta",
    """WITH d AS (SELECT l_partkey, l_orderkey, l_linenumber, xor(l_suppkey, coalesce(lag(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey), 0)) AS delta FROM lineitem)
SELECT bit_count(delta)::INT AS bits, count(*) AS n FROM d GROUP BY 1""",
)
def xor_delta(spark, sf_dir):
    rows = ordered.xor_differences(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], "l_suppkey")
    return rows.groupBy(F.bit_count("delta").cast("int").alias("bits")).agg(F.count("*").alias("n"))


@query(
    "co_occurrence",
    """WITH x AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), y AS (SELECT * FROM x WHERE b IS NOT NULL)
SELECT a, b, count(*) AS n FROM (SELECT a, b FROM y UNION ALL SELECT b, a FROM y) GROUP BY 1, 2""",
)
def co_occurrence(spark, sf_dir):
    return ordered.pair_counts(frames(spark, sf_dir), ["user_id"], _ORDER, "event_type")


@query(
    "skip_blocks",
    """WITH b AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = p THEN 1 ELSE 0 END)::BIGINT AS skipped FROM b GROUP BY 1""",
)
def skip_blocks(spark, sf_dir):
    rows = ordered.repeats_previous(frames(spark, sf_dir), ["user_id"], _ORDER, "event_type")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"))


@query(
    "causal_neighbors",
    f"""WITH {_BLOCKS}
SELECT b.bx, b.by, b.endpoint, CASE WHEN l.endpoint = b.endpoint THEN 0 WHEN u.endpoint = b.endpoint THEN 1 WHEN d.endpoint = b.endpoint THEN 2 ELSE 3 END AS predictor
FROM blk b LEFT JOIN blk l ON l.bx = b.bx - 1 AND l.by = b.by LEFT JOIN blk u ON u.bx = b.bx AND u.by = b.by - 1 LEFT JOIN blk d ON d.bx = b.bx - 1 AND d.by = b.by - 1""",
)
def causal_neighbors(spark, sf_dir):
    return ordered.causal_predictor(blocks(spark, sf_dir).drop("q"), [], "bx", "by", "endpoint")


@query(
    "previous_frame",
    f"WITH {_BLOCKS} SELECT c.bx, c.by, c.q, p.q AS prev_q FROM blk c LEFT JOIN blk p ON p.bx = c.bx AND p.by = c.by - 1",
)
def previous_frame(spark, sf_dir):
    return joins.previous_frame(blocks(spark, sf_dir).select("bx", "by", "q"), "by", ["bx"], ["q"]).select("bx", "by", "q", "prev_q")


@query(
    "byte_offsets",
    """SELECT o_custkey, o_orderkey, coalesce(sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM orders""",
)
def byte_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("size", F.length("o_orderpriority"))
    return ordered.offsets(rows, ["o_custkey"], ["o_orderkey"], "size").select("o_custkey", "o_orderkey", "offset")


@query(
    "symbol_groups",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT user_id, k // 3 AS group_no, string_agg(event_type, ',' ORDER BY k) AS symbols FROM r GROUP BY 1, 2""",
)
def symbol_groups(spark, sf_dir):
    return ordered.symbol_groups(frames(spark, sf_dir), ["user_id"], _ORDER, "event_type", 3).withColumn("symbols", F.array_join("symbols", ","))


@query(
    "stripe_partition",
    "WITH s AS (SELECT o_custkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stripe FROM orders) SELECT stripe::INT AS stripe, count(*) AS n FROM s GROUP BY 1",
)
def stripe_partition(spark, sf_dir):
    return ordered.stripes(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 4).groupBy("stripe").agg(F.count("*").alias("n"))


@query(
    "mip_sequence",
    """WITH p AS (SELECT p_partkey, p_size AS w, p_size * 3 AS h FROM part), l AS (SELECT *, unnest(range(0, floor(log2(greatest(w, h)))::INT + 1))::INT AS level FROM p)
SELECT p_partkey, level, greatest(w >> level, 1) AS level_w, greatest(h >> level, 1) AS level_h FROM l""",
)
def mip_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS w", "p_size * 3 AS h")
    return ordered.mip_levels(rows, "w", "h").select("p_partkey", "level", "level_w", "level_h")


@query(
    "palette_order",
    "WITH u AS (SELECT DISTINCT l_quantity::INT AS color FROM lineitem) SELECT color, (row_number() OVER (ORDER BY color) - 1)::INT AS new_id FROM u",
)
def palette_order(spark, sf_dir):
    return sets.dense_ids(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("color")), "color")


@query(
    "radix_order",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey)::INT AS place FROM orders",
)
def radix_order(spark, sf_dir):
    """A stable sort by a short key: ties keep the row id's order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ordered.stable_places(rows, ["o_orderstatus"], "o_orderpriority", "o_orderkey").select("o_orderkey", "place")


@query("symbols_by_frequency", "SELECT p_type AS sym, count(*) AS freq FROM part GROUP BY 1 ORDER BY 2, 1")
def symbols_by_frequency(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sym")).agg(F.count("*").alias("freq")).orderBy("freq", "sym")


@query(
    "worst_blocks",
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS error FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25",
)
def worst_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("error", F.col("l_extendedprice"))
    return sets.worst(rows, "error", ["l_orderkey", "l_linenumber", "l_partkey"], 25).select("l_orderkey", "l_linenumber", "error")


@query(
    "candidate_shortlist",
    """WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice AS cost, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM lineitem)
SELECT l_suppkey, rank, l_partkey, cost FROM r WHERE rank <= 4""",
)
def candidate_shortlist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("cost", F.col("l_extendedprice"))
    return sets.shortlist(rows, ["l_suppkey"], "cost", ["l_orderkey", "l_linenumber", "l_partkey"], 4).select("l_suppkey", "rank", "l_partkey", "cost")


@query(
    "best_pair",
    """WITH x AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a, b, n FROM c ORDER BY n DESC, a, b LIMIT 1""",
)
def best_pair(spark, sf_dir):
    after = F.lead("event_type")
    from pyspark.sql import Window as W

    x = frames(spark, sf_dir).select(F.col("event_type").alias("a"), after.over(W.partitionBy("user_id").orderBy(*_ORDER)).alias("b")).where("b is not null")
    return sets.worst(x.groupBy("a", "b").agg(F.count("*").alias("n")), "n", ["a", "b"], 1)


@query(
    "weighted_distinct",
    "SELECT l_quantity, l_tax, sum(l_linenumber)::BIGINT AS weight, count(*) AS members, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1, 2",
)
def weighted_distinct(spark, sf_dir):
    return sets.weighted_distinct(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_linenumber", "l_orderkey")


@query(
    "dedup_codebook",
    "WITH u AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS new_id FROM u",
)
def dedup_codebook(spark, sf_dir):
    return sets.dense_ids(table(spark, sf_dir, "part"), "p_brand")


@query(
    "ensure_codewords",
    "SELECT DISTINCT l_linenumber FROM (SELECT l_linenumber FROM lineitem UNION ALL SELECT unnest([0, 1, 85, 170, 255])::INT)",
)
def ensure_codewords(spark, sf_dir):
    needed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0, 1, 85, 170, 255)])).alias("l_linenumber"))
    return sets.ensure_rows(table(spark, sf_dir, "lineitem").select("l_linenumber").distinct(), needed)


@query("merge_clusters", "SELECT p_brand, p_size, min(p_partkey) AS p_partkey, count(*) AS merged FROM part GROUP BY 1, 2")
def merge_clusters(spark, sf_dir):
    return sets.merge_equal(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey")


@query("used_entries", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def used_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return sets.used_entries(table(spark, sf_dir, "part").select("p_partkey", "p_name"), rows, "p_partkey", "l_partkey")


@query("erase_keys", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def erase_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(gone, "c_custkey", "left_anti")


@query("append_tables", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def append_tables(spark, sf_dir):
    one = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_acctbal AS balance")
    return one.unionByName(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_acctbal AS balance"))


@query("insert_if_absent", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def insert_if_absent(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query(
    "sorted_unique",
    "SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS lines FROM lineitem GROUP BY 1",
)
def sorted_unique(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("lines"))


@query(
    "output_validation",
    "SELECT count(*) AS wrong FROM ((SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 0) UNION ALL (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 0 EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders))",
)
def output_validation(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    b = table(spark, sf_dir, "orders").where("o_totalprice >= 0").select("o_orderkey", "o_custkey")
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("wrong"))


@query(
    "hierarchy_check",
    "SELECT count(*) AS orphans FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IS NULL",
)
def hierarchy_check(spark, sf_dir):
    return joins.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey").agg(F.count("*").alias("orphans"))


@query(
    "uniform_dimensions",
    "SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AND min(length(o_orderpriority)) = max(length(o_orderpriority)) AS uniform FROM orders GROUP BY 1",
)
def uniform_dimensions(spark, sf_dir):
    n = F.length("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(((F.countDistinct("o_orderstatus") == 1) & (F.min(n) == F.max(n))).alias("uniform"))


@query(
    "solid_blocks",
    "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS solid, bool_or(l_discount < 0.05) AS has_alpha FROM lineitem GROUP BY 1",
)
def solid_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return rows.agg((F.min("l_returnflag") == F.max("l_returnflag")).alias("solid"), F.bool_or(F.col("l_discount") < 0.05).alias("has_alpha"))


@query(
    "region_predicate",
    """WITH px AS (SELECT l_orderkey % 64 AS x, l_orderkey // 64 AS y, l_quantity AS v FROM lineitem) SELECT x, y, count(*) AS n, sum(v) AS s FROM px WHERE x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 11 GROUP BY 1, 2""",
)
def region_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 64 AS x", "l_orderkey div 64 AS y", "l_quantity AS v")
    return rows.where("x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 11").groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


@query(
    "mip_halving",
    "SELECT l_orderkey // 2 AS x, round(avg(l_quantity), 6) AS v, count(*) AS n FROM lineitem GROUP BY 1",
)
def mip_halving(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 2").alias("x")).agg(F.round(F.avg("l_quantity"), 6).alias("v"), F.count("*").alias("n"))


@query(
    "invert_clusters",
    "WITH c AS (SELECT l_suppkey AS cluster, list_sort(list(DISTINCT l_partkey)) AS members FROM lineitem GROUP BY 1) SELECT unnest(members) AS member, cluster FROM c",
)
def invert_clusters(spark, sf_dir):
    clusters = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.collect_set("l_partkey").alias("members"))
    return clusters.select(F.explode("members").alias("member"), "cluster")


@query(
    "children_of_parents",
    "SELECT n_regionkey AS parent, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS children FROM nation GROUP BY 1",
)
def children_of_parents(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.array_join(F.array_sort(F.collect_set("n_nationkey")), ",").alias("children"))


@query(
    "remap_ids",
    "WITH m AS (SELECT n_nationkey AS c_nationkey, 100 + n_regionkey AS new_key FROM nation WHERE n_nationkey % 2 = 0) SELECT c_custkey, coalesce(new_key, c.c_nationkey) AS c_nationkey FROM customer c LEFT JOIN m USING (c_nationkey)",
)
def remap_ids(spark, sf_dir):
    moves = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS c_nationkey", "100 + n_regionkey AS new_key")
    return joins.remap(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), moves, "c_nationkey", "new_key")


@query(
    "blocks_of_pixels",
    "WITH px AS (SELECT l_orderkey % 64 AS x, l_orderkey // 64 AS y, max(l_quantity::INT) AS v FROM lineitem GROUP BY 1, 2) SELECT x // 4 AS bx, y // 4 AS by, array_to_string(list(v ORDER BY y, x), ',') AS texels FROM px GROUP BY 1, 2",
)
def blocks_of_pixels(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey % 64").alias("x"), F.expr("l_orderkey div 64").alias("y")).agg(F.max(F.col("l_quantity").cast("int")).alias("v"))
    from texloom.operators.images import blockify

    return blockify(px, [], "x", "y", ["v"]).select("bx", "by", F.array_join(F.transform("texels", lambda t: t["v"]), ",").alias("texels"))


@query(
    "combine_images",
    f'WITH {_BLOCKS}, m AS (SELECT bx + 1 AS bx, "by", q FROM blk) SELECT a.bx, a."by", a.q AS color, m.q AS alpha FROM blk a JOIN m ON a.bx = m.bx AND a."by" = m."by"',
)
def combine_images(spark, sf_dir):
    one = blocks(spark, sf_dir).selectExpr("bx", "by", "q AS color")
    return one.join(blocks(spark, sf_dir).selectExpr("bx + 1 AS bx", "by", "q AS alpha"), ["bx", "by"])


@query("image_pixels_swizzled", "SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_linenumber * 36)::BIGINT AS r, sum(l_quantity::INT * 5)::BIGINT AS b FROM lineitem GROUP BY 1, 2")
def image_pixels_swizzled(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("b").alias("r"), F.col("r").alias("b"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("b").alias("b"))
