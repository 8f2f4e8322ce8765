"""The front end of a codebook encoder on texel tables (keys, block, i, r, g, b): endpoints of clusters, training vectors,
hierarchical codebooks, errors and constraints. All of it aggregates; no step gathers a cluster's texels in one place.

An endpoint is a color of 5 bits a channel and one of eight rows of modifiers; a texel takes the nearest of its four colors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.operators import vq
from texloom.operators.blockcodecs import ETC1_MODIFIERS

COLORS = ("r", "g", "b")


def expanded(c: Column) -> Column:
    """8 bits of a 5-bit channel."""
    return F.shiftleft(c, 3) + F.shiftright(c, 2)


def _modifiers(row: int) -> list[int]:
    return sorted(int(x) for x in ETC1_MODIFIERS[row])


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def _error(base: list[Column], modifier: int) -> Column:
    parts = [F.pow((F.col(c) - _clamped(b + modifier)).cast("double"), F.lit(2.0)) for c, b in zip(COLORS, base, strict=True)]
    return (parts[0] + parts[1] + parts[2]).cast("long")


def cluster_endpoints(texels: DataFrame, cluster: list[str]) -> DataFrame:
    """(cluster, r5, g5, b5, row, error, texels) of each cluster: its mean color in 5 bits, and the row of modifiers under which
    its texels' squared errors are least (ties: the first)."""
    five = [F.floor(F.avg(c) * 31.0 / 255.0 + 0.5).cast("int").alias(f"{c}5") for c in COLORS]
    bases = texels.groupBy(*cluster).agg(*five)
    base = [expanded(F.col(f"{c}5")) for c in COLORS]
    errors = [F.sum(F.least(*[_error(base, m) for m in _modifiers(k)])).alias(f"__e{k}") for k in range(len(ETC1_MODIFIERS))]
    found = texels.join(bases, cluster).groupBy(*cluster, *[f"{c}5" for c in COLORS]).agg(*errors, F.count(F.lit(1)).alias("texels"))
    every = F.array(*[F.col(f"__e{k}") for k in range(len(ETC1_MODIFIERS))])
    return found.select(*cluster, *[f"{c}5" for c in COLORS], (F.array_position(every, F.array_min(every)) - 1).cast("int").alias("row"), F.array_min(every).alias("error"), "texels")


def low_high_colors(endpoints: DataFrame) -> DataFrame:
    """Append the darkest and the brightest color of each endpoint: low and high, arrays of three."""
    large = F.array(*[F.lit(_modifiers(k)[3]) for k in range(len(ETC1_MODIFIERS))])
    base = [expanded(F.col(f"{c}5")) for c in COLORS]
    reach = F.get(large, F.col("row"))
    return endpoints.withColumns({"low": F.array(*[_clamped(b - reach) for b in base]), "high": F.array(*[_clamped(b + reach) for b in base])})


def endpoint_vectors(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, w): a block's low and high colors as six numbers of 0..1, once for each of its two halves."""
    rows = low_high_colors(endpoints)
    return rows.select(*keys, F.transform(F.concat("low", "high"), lambda c: c / 255.0).alias("v"), F.explode(F.array(F.lit(1), F.lit(1))).alias("w"))


def selector_vectors(texels: DataFrame, endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, w): the selectors of a block's 16 texels, and as weight how far its low and high colors are apart, over 300, 1 to 4096."""
    colors = low_high_colors(endpoints)
    base = [expanded(F.col(f"{c}5")) for c in COLORS]
    rows = texels.join(colors, keys)
    by_row = [F.array(*[_error(base, m) for m in _modifiers(k)]) for k in range(len(ETC1_MODIFIERS))]
    errors = F.get(F.array(*by_row), F.col("row"))
    selector = (F.array_position(errors, F.array_min(errors)) - 1).cast("double")
    apart = F.aggregate(F.zip_with("low", "high", lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, x: s + x)
    weight = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(apart / 300.0))).cast("int")
    found = rows.groupBy(*keys, weight.alias("w")).agg(F.array_sort(F.collect_list(F.struct("i", selector.alias("s")))).alias("t"))
    return found.select(*keys, F.transform("t", lambda x: x["s"]).alias("v"), "w")


def hierarchical_codebook(rows: DataFrame, vector: str, weight: str, codes: int, parents: int) -> tuple[DataFrame, DataFrame]:
    """Labels (v, weight, members, code, parent) of distinct vectors, and (code, parent, weight, error) of the codebook.

    The coarse codebook is the fine one's tree cut off after `parents` leaves, so every code has one parent.
    """
    spark = rows.sparkSession
    labelled, leaves = vq.quantize(rows, vector, weight, codes)
    book = spark.createDataFrame([(i, p, leaf.weight, leaf.error) for i, (leaf, p) in enumerate(zip(leaves, vq.truncated(leaves, parents), strict=True))], "code int, parent int, weight double, error double")
    # a codebook has at most `codes` rows
    return labelled.join(book.select("code", "parent"), "code"), book


def block_endpoint_errors(texels: DataFrame, endpoints: DataFrame, block: list[str], cluster: str) -> DataFrame:
    """(block, error): squared errors of each block's texels under the endpoint of the cluster that the block is in."""
    base = [expanded(F.col(f"{c}5")) for c in COLORS]
    by_row = F.array(*[F.least(*[_error(base, m) for m in _modifiers(k)]) for k in range(len(ETC1_MODIFIERS))])
    rows = texels.join(endpoints.select(cluster, *[f"{c}5" for c in COLORS], "row"), cluster)
    return rows.groupBy(*block).agg(F.sum(F.get(by_row, F.col("row"))).alias("error"))


def remapped_endpoints(texels: DataFrame, remap: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Endpoints again after clusters (old) became others (new): those of the new clusters, and (old, new) with dense new ids."""
    rows = texels.join(remap, texels[cluster] == remap["old"]).drop(cluster, "old")
    endpoints = cluster_endpoints(rows, ["new"])
    from pyspark.sql import Window as W

    # ids are those of a codebook: bounded by its size
    dense = endpoints.select("new").withColumn("id", F.row_number().over(W.orderBy("new")) - 1)
    return endpoints.join(dense, "new").withColumnRenamed("id", cluster), remap.join(dense, "new", "left").select("old", F.col("id").alias("new"))


def split_blocks(subblocks: DataFrame, block: list[str], cluster: str) -> DataFrame:
    """Blocks that break the rule that both halves are in one cluster."""
    return subblocks.groupBy(*block).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b")).where("a <> b").select(*block)


#: Stabilizers of a block's similarity for values of 0..1, and the power of its mean term.
BLOCK_C1, BLOCK_C2, MEAN_POWER = 0.01**2, 0.03**2, 1.5


def block_similarity(pairs: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """(keys, similarity) of blocks from their texels' two values (c and c + '2', of 0..1): the product over channels of the terms of
    means, contrasts and structures, each within 0..1."""
    found = None
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    for c in channels:
        p, q = F.col(c), F.col(f"{c}2")
        mp, mq = F.avg(p), F.avg(q)
        vp, vq_ = F.var_pop(p), F.var_pop(q)
        both = F.covar_pop(p, q)
        mean = inside((2 * mp * mq + BLOCK_C1) / (mp * mp + mq * mq + BLOCK_C1))
        contrast = inside((2 * F.sqrt(vp) * F.sqrt(vq_) + BLOCK_C2) / (vp + vq_ + BLOCK_C2))
        structure = inside((both + BLOCK_C2 / 2) / (F.sqrt(vp) * F.sqrt(vq_) + BLOCK_C2 / 2))
        part = F.pow(mean, F.lit(MEAN_POWER)) * contrast * structure
        found = part if found is None else found * part
    return pairs.groupBy(*keys).agg(found.alias("similarity"))
