"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import discard, join_by_key, written


def _order(label: str, turn: int) -> Column:
    """By what a round compares labels: the label itself in even rounds, a hash that is new each time in odd ones."""
    return F.struct(F.xxhash64(F.lit(turn), label) if turn % 2 else F.lit(0).cast("long"), F.col(label).alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of each node's component. Nodes without an edge are left out.

    Each round every node moves to the first of its neighbours and itself, and the edges follow; equal edges
    fall together, so a group with many edges shrinks before any task sees it again. Even rounds compare the
    labels, which takes a star in one round; odd rounds compare fresh hashes of them, after which a path keeps
    a fraction of its nodes whatever their order is. So rounds grow with the logarithm of the largest component.
    Tables are written between rounds and removed when the next ones stand.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found, turn = None, 0
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        best = both.groupBy("node").agg(F.min(_order("near", turn)).alias("near"), F.count(F.lit(1)).alias("n"))
        moves = written(best.select("node", F.least("near", _order("node", turn))["label"].alias("to"), "n"), "moves")
        if found is None:
            found = written(moves.select("node", F.col("to").alias("root")), "roots")
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            roots = written(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(step, "root", "left"), "steps")
            before, found = found, written(join_by_key(found, roots, "root").select("node", F.coalesce("to", "root").alias("root")), "roots")
            discard(before)
            discard(roots)
        ends = 2 * edges.count()
        moved = join_by_key(edges, moves.select(F.col("node").alias("a"), F.col("to").alias("p"), "n"), "a", ends).drop("n")
        moved = join_by_key(moved, moves.select(F.col("node").alias("b"), F.col("to").alias("q"), "n"), "b", ends).where("p <> q")
        before, edges = edges, written(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        discard(before)
        discard(moves)
        turn += 1
        if edges.isEmpty():
            discard(edges)
            break
    if turn == 1:
        return found
    least = written(found.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "roots")
    return join_by_key(found, least, "root").select("node", F.col("least").alias("root"))
