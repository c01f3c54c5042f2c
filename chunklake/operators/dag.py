"""Operators on a commit graph: closures, merge bases, bisection, depth limits.

Edges are rows ``child, parent``. Closures go by frontier: each round joins only the nodes found in
the last one, all starts at once, and writes what is new to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Steps along the edges in each round.
HOPS = 4


def ancestors(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, node, depth``: everything reachable from each start, itself included, at its least depth.

    ``starts`` has the column ``start``. Nodes without edges are kept and not expanded. With
    ``depth``, nodes further away are left out.
    """
    edges = materialise(edges.select("child", "parent").where("parent is not null").distinct())  # read again in each round
    frontier = materialise(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    rounds, level = [frontier], 0
    while depth is None or level < depth:
        hops = HOPS if depth is None else min(HOPS, depth - level)
        step, found = frontier, None
        for hop in range(1, hops + 1):
            step = step.join(edges, step["node"] == edges["child"]).select("start", F.col("parent").alias("node"), F.lit(level + hop).alias("depth")).distinct()
            found = step if found is None else found.unionByName(step)
        seen = reduce(DataFrame.unionByName, rounds).select("start", "node")
        new = materialise(found.groupBy("start", "node").agg(F.min("depth").alias("depth")).join(seen, ["start", "node"], "left_anti"))
        rounds.append(new)
        level += hops
        frontier = new.where(F.col("depth") == level)  # nearer ones have been expanded already
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def merge_bases(a: DataFrame, edges: DataFrame) -> DataFrame:
    """Common ancestors of the two starts in ``a`` that no other common ancestor descends from.

    The common set holds its members' ancestors, so a member is dominated exactly if one of its
    children is in the set.
    """
    closure = ancestors(a, edges)
    n = a.select("start").distinct().count()
    common = materialise(closure.groupBy("node").agg(F.count_distinct("start").alias("n")).where(F.col("n") == n).select("node"))
    inner = edges.join(common, edges["child"] == common["node"], "left_semi").select(F.col("parent").alias("node"))
    return common.join(inner, "node", "left_anti")


def merge_base(a: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the least merge base, null without any."""
    return merge_bases(a, edges).agg(F.min("node").alias("merge_base"), F.count("*").alias("n_bases"))


def suspects(bad: DataFrame, good: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``: ancestors of the bad marks that no good mark reaches."""
    sides = bad.select("start", F.lit(True).alias("bad")).unionByName(good.select("start", F.lit(False).alias("bad")))
    reach = materialise(ancestors(sides.select("start"), edges).join(sides, "start"))
    return reach.where("bad").select("node").distinct().join(reach.where("not bad").select("node").distinct(), "node", "left_anti")


def bisect_step(bad: DataFrame, good: DataFrame, skipped: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``state, commit, remaining``: the suspect that best halves the rest, of equals the least.

    Without another candidate than the bad mark the search is done; ``inconclusive`` if only skipped
    ones stood between.
    """
    range_ = materialise(suspects(bad, good, edges))
    inner = edges.join(range_, edges["child"] == range_["node"], "left_semi").join(range_.withColumnRenamed("node", "parent"), "parent", "left_semi")
    counts = ancestors(range_.select(F.col("node").alias("start")), inner).groupBy("start").agg(F.count("*").alias("n"))
    marks = bad.select(F.col("start").alias("node"))
    total, others = range_.count(), range_.join(marks, "node", "left_anti").count()
    only = bad.agg(F.min("start")).first()[0]
    free = counts.withColumnRenamed("start", "node").join(marks, "node", "left_anti").join(skipped.select("node"), "node", "left_anti")
    scored = free.withColumn("score", F.least(F.col("n"), F.lit(total) - F.col("n")))
    best = scored.agg(F.count("*").alias("remaining"), F.min_by("node", F.struct(-F.col("score"), "node")).alias("pick"))
    state = F.when(F.col("remaining") > 0, "step").otherwise("inconclusive" if others else "done")
    return best.select(state.alias("state"), F.coalesce("pick", F.lit(only)).alias("commit"), "remaining")


def shallow_boundary(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``node``: those at the greatest depth that have parents, where a shallow copy is cut."""
    at = ancestors(starts, edges, depth).groupBy("node").agg(F.min("depth").alias("depth")).where(F.col("depth") == depth)
    return at.join(edges.select(F.col("child").alias("node")), "node", "left_semi").select("node", "depth")


def graft(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """The edges without those that leave the boundary."""
    return edges.join(boundary.select(F.col("node").alias("child")), "child", "left_anti")


def first_parents(start: DataFrame, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """``node, step``: the chain of first parents from the one ``start``, of any length, or of ``steps`` at most.

    ``edges`` has ``child, parent, ord``; those with ``ord = 0`` are followed. Each round doubles the
    stretch that a jump covers, so a chain of n commits takes log n rounds.
    """
    jumps = materialise(edges.where("ord = 0").select("child", "parent"))
    chain, reach = materialise(start.select(F.col("start").alias("node"), F.lit(0).alias("step"))), 1
    while steps is None or reach <= steps:
        more = materialise(chain.join(jumps, chain["node"] == jumps["child"]).select(F.col("parent").alias("node"), (F.col("step") + reach).alias("step")))
        if more.isEmpty():
            break
        chain, reach = chain.unionByName(more), 2 * reach
        far = jumps.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        jumps = materialise(jumps.join(far, "parent").select("child", F.col("further").alias("parent")))
    return chain if steps is None else chain.where(F.col("step") <= steps)
