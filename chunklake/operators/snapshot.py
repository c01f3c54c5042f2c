"""Content-addressed snapshots of tables: objects, trees, Merkle roll-ups, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id, merkle


def manifest(rows: DataFrame, path: list[str], pos: Column, body: Column) -> DataFrame:
    """``path, sig, n``: the hash of each file's entries, position and content id, and their number."""
    entries = rows.select(*path, pos.cast("string").alias("k"), content_id(body).alias("s"))
    return merkle(entries, path, "k", "s")


def tree_hash(files: DataFrame, path: str, sig: str = "sig") -> DataFrame:
    """One row ``tree, n_files``: the hash of the files' paths and hashes."""
    named = files.select(F.col(path).cast("string").alias("k"), F.col(sig).alias("s"))
    return merkle(named, [], "k", "s").select(F.col("sig").alias("tree"), F.col("n").alias("n_files"))


def objects(rows: DataFrame, body: str, key: str) -> DataFrame:
    """Distinct contents: ``id, first_key, n, raw_len``."""
    named = rows.select(content_id(F.col(body)).alias("id"), F.col(key).alias("k"), F.octet_length(body).alias("raw_len"))
    return named.groupBy("id").agg(F.min("k").alias("first_key"), F.count("*").alias("n"), F.max("raw_len").alias("raw_len"))


def missing(wanted: DataFrame, store: DataFrame, on: str) -> DataFrame:
    """Ids that the store lacks."""
    return wanted.select(on).distinct().join(store.select(on), on, "left_anti")


def present(wanted: DataFrame, store: DataFrame, on: str) -> DataFrame:
    return wanted.select(on).distinct().join(store.select(on), on, "left_semi")


def cache_lookup(payloads: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    """``payloads`` with ``hit``: whether the cache knows the content, so that it need not be decoded."""
    known = cache.select(on).distinct().withColumn("__known", F.lit(True))
    return payloads.join(known, on, "left").withColumn("hit", F.coalesce("__known", F.lit(False))).drop("__known")


def fsck(store: DataFrame, reachable: DataFrame, on: str, sound: Column) -> DataFrame:
    """One row: objects checked, corrupt, missing (reachable but not stored), unreachable."""
    a = store.select(on, (~sound).alias("bad")).withColumn("__s", F.lit(1))
    b = reachable.select(on).distinct().withColumn("__r", F.lit(1))
    rows = a.join(b, on, "full")
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(
        count(F.col("__s").isNotNull()).alias("checked"),
        count(F.col("__s").isNotNull() & F.col("bad")).alias("corrupt"),
        count(F.col("__s").isNull()).alias("missing"),
        count(F.col("__r").isNull()).alias("unreachable"),
    )


def gc(store: DataFrame, reachable: DataFrame, on: str) -> DataFrame:
    """One row: objects that a collection keeps and prunes."""
    marked = store.select(on).join(reachable.select(on).distinct().withColumn("__r", F.lit(1)), on, "left")
    return marked.agg(F.count("__r").alias("kept"), F.count(F.when(F.col("__r").isNull(), 1)).alias("pruned"))
