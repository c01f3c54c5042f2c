"""Three-way merges of keyed tables, and what is made of them: cherry-pick and revert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(base: Column, ours: Column, theirs: Column) -> Column:
    """ours, theirs or conflict; null stands for a row that is not there."""
    return F.when(ours.eqNullSafe(theirs), "ours").when(ours.eqNullSafe(base), "theirs").when(theirs.eqNullSafe(base), "ours").otherwise("conflict")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of the three sides with its values and ``decision`` and ``merged``.

    The sides are tagged and grouped by key, one exchange for all three.
    """
    tagged = lambda df, n: df.select(*keys, F.lit(n).alias("side"), F.struct(F.col(value).alias("v")).alias("v"))
    rows = tagged(base, 0).unionByName(tagged(ours, 1)).unionByName(tagged(theirs, 2))
    pick = lambda n: F.max(F.when(F.col("side") == n, F.col("v")))
    rows = rows.groupBy(*keys).agg(pick(0).alias("b"), pick(1).alias("o"), pick(2).alias("t"))
    rows = rows.withColumn("decision", decide(F.col("b"), F.col("o"), F.col("t")))
    merged = F.when(F.col("decision") == "ours", F.col("o.v")).when(F.col("decision") == "theirs", F.col("t.v"))
    return rows.select(*keys, F.col("b.v").alias("base"), F.col("o.v").alias("ours"), F.col("t.v").alias("theirs"), "decision", merged.alias("merged"), F.when(F.col("decision") == "ours", F.col("o").isNotNull()).when(F.col("decision") == "theirs", F.col("t").isNotNull()).alias("present"))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The merged table and the conflicts; the merge holds only if there are no conflicts."""
    rows = three_way(base, ours, theirs, keys, value)
    return rows.where("present").select(*keys, F.col("merged").alias(value)), rows.where("decision = 'conflict'").select(*keys, "base", "ours", "theirs")


def cherry_pick(parent: DataFrame, commit: DataFrame, head: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """What ``commit`` changed against its parent, on top of ``head``."""
    return merge(parent, head, commit, keys, value)


def revert(parent: DataFrame, commit: DataFrame, head: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The opposite of what ``commit`` changed, on top of ``head``."""
    return merge(commit, head, parent, keys, value)
