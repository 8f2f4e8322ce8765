"""Rate-distortion passes in which a block's result feeds the next block's.

Such a pass is sequential inside a stripe of blocks and parallel across stripes; the number of stripes depends on the picture's
size alone, so results do not depend on the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of a stripe.
STRIPE_BLOCKS = 4096


def with_stripes(blocks: DataFrame, order: str, size: int = STRIPE_BLOCKS) -> DataFrame:
    return blocks.withColumn("stripe", F.expr(f"{order} div {size}"))


def match_bits(distance: int) -> int:
    """Estimated bits of a dictionary match: see functions.integers.match_cost."""
    capped = min(distance, 32767)
    return 12 + (capped.bit_length() - 2 if capped >= 4 else 0) + max(0, distance.bit_length() - 15)


def window_reuse(blocks: DataFrame, order: str, vector: str, window: int, rate: float, literal_bits: int, unit: int = 8) -> DataFrame:
    """(order, source, cost): each block keeps its own code or takes that of an earlier block of its stripe within `window`
    blocks, whichever has the least squared error * 1 + bits * rate. A block that took another's offers the taken vector."""
    rows = with_stripes(blocks, order).select("stripe", order, vector)
    schema = T.StructType([rows.schema[order], T.StructField("source", rows.schema[order].dataType), T.StructField("cost", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at, v = pdf[order].to_numpy(), np.array(pdf[vector].tolist(), float)
        used, source, cost = v.copy(), at.copy(), np.full(len(at), literal_bits * rate)
        bits = np.array([match_bits(max(1, d * unit)) for d in range(window + 1)], float)
        for i in range(1, len(at)):
            a = max(0, i - window)
            total = ((used[a:i] - v[i]) ** 2).sum(axis=1) + bits[i - np.arange(a, i)] * rate
            best = int(total.argmin())
            if total[best] < cost[i]:
                used[i], source[i], cost[i] = used[a + best], source[a + best], total[best]
        return pd.DataFrame({order: at, "source": source, "cost": cost})

    return rows.groupBy("stripe").applyInPandas(run, schema)


def neighbor_reuse(blocks: DataFrame, by: str, bx: str, vector: str, least_psnr: float, most_drop: float) -> DataFrame:
    """(bx, by, taken): each block takes its left or else upper neighbour's (already decided) vector if that keeps the block's PSNR at
    `least_psnr` and within `most_drop` decibels of its own code's (8-bit steps of 4)."""
    rows = blocks.withColumn("stripe", F.expr(f"{by} div 16")).select("stripe", bx, by, vector)
    schema = T.StructType([rows.schema[bx], rows.schema[by], T.StructField("taken", T.StringType())])

    def quality(error: float) -> float:
        return 100.0 if error == 0 else min(100.0, 10 * math.log10(255**2 / error))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([by, bx])
        made: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for x, y, v in zip(pdf[bx], pdf[by], pdf[vector], strict=True):
            v = np.asarray(v, float)
            own, taken = np.round(v / 4) * 4, "own"
            base = quality(float(((own - v) ** 2).mean()))
            for name, place in (("left", (x - 1, y)), ("up", (x, y - 1))):
                if place in made:
                    q = quality(float(((made[place] - v) ** 2).mean()))
                    if q >= least_psnr and base - q <= most_drop:
                        own, taken = made[place], name
                        break
            made[x, y] = own
            out.append((x, y, taken))
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy("stripe").applyInPandas(run, schema)
