"""Invertible patches of keyed tables: extract, reverse, guarded apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import keyed_diff


def extract(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Operations that lead from a to b: keys, ``status``, ``base`` and ``value`` (structs of the fields)."""
    return keyed_diff(a, b, keys, fields).select(*keys, F.col("kind").alias("status"), F.col("a").alias("base"), F.col("b").alias("value"))


def reverse(ops: DataFrame) -> DataFrame:
    """Operations that lead back."""
    status = F.when(F.col("status") == "added", "removed").when(F.col("status") == "removed", "added").otherwise(F.col("status"))
    return ops.select(*(F.col(c) for c in ops.columns if c not in ("status", "base", "value")), status.alias("status"), F.col("value").alias("base"), F.col("base").alias("value"))


def _guarded(table: DataFrame, ops: DataFrame, keys: list[str], fields: list[str], force: bool) -> DataFrame:
    now = table.select(*keys, F.struct(*fields).alias("now"))
    rows = now.join(ops.withColumn("op", F.lit(True)), keys, "full")
    return rows.withColumn("fits", F.col("op").isNull() | F.lit(force) | F.col("now").eqNullSafe(F.col("base")))


def apply(table: DataFrame, ops: DataFrame, keys: list[str], fields: list[str], force: bool = False) -> DataFrame:
    """The patched table: an operation is done only where the row is as its base says, or by force."""
    rows = _guarded(table, ops, keys, fields, force)
    out = rows.withColumn("out", F.when(F.col("op").isNotNull() & F.col("fits"), F.col("value")).otherwise(F.col("now")))
    return out.where("out is not null").select(*keys, *(F.col(f"out.{f}").alias(f) for f in fields))


def conflicts(table: DataFrame, ops: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The operations that don't fit, with the row as it is."""
    return _guarded(table, ops, keys, fields, False).where("not fits").select(*keys, "status", "base", "now", "value")
