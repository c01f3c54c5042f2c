"""The driver's tables, edited copies of them, and the commit graph made of order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def edited(df: DataFrame, key: str, changes: dict[str, Column], drop: int = 97, change: int = 53, add: int | None = 89) -> DataFrame:
    """The edited copy: keys that ``drop`` divides go, ``change`` divides change, ``add`` divides come again under another key."""
    k = F.col(key)
    kept = df.where(k % drop != 0).withColumns({c: F.when(k % change == 0, v).otherwise(F.col(c)) for c, v in changes.items()})
    return kept if add is None else kept.unionByName(df.where(k % add == 0).withColumn(key, k + ADDED))


def sql_edited(source: str, key: str, columns: dict[str, str | None], drop: int = 97, change: int = 53, add: int | None = 89) -> str:
    """The same copy as SQL; ``columns``: the other columns, with the changed value of those that change."""
    kept = ", ".join(f"CASE WHEN {key} % {change} = 0 THEN {v} ELSE {c} END AS {c}" if v else c for c, v in columns.items())
    out = f"SELECT {key}, {kept} FROM {source} WHERE {key} % {drop} <> 0"
    return out if add is None else f"{out} UNION ALL SELECT {key} + {ADDED} AS {key}, {', '.join(columns)} FROM {source} WHERE {key} % {add} = 0"


def commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``child, parent``: each order key's commit has the commits of key div 2 and key div 3 as parents; 0 is the root."""
    k = table(spark, sf_dir, "orders", "o_orderkey").where("o_orderkey > 0")
    halves = k.select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent"))
    thirds = k.select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 3").alias("parent"))
    return halves.unionByName(thirds).distinct()


#: The same in SQL.
EDGES = "edges AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0)"
