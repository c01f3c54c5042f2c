"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least of u and its neighbours.

    A merge join, of which Spark splits the edges of a hot u over tasks, since no more than one row
    meets them from the other side.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least.hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger u to the smaller v."""
    linked = _with_least(edges)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    h: Column = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: longs ``u, v`` in any direction. Gives ``node, root`` for every node with an edge.

    The root is the least node of the component; the rows other than roots point straight at it. Each
    round is written to the shared folder, so the lineage stays short.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        mark = _mark(now)
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = materialise(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
