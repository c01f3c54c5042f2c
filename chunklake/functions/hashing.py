"""Content ids: SHA-256 of canonical text or bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(body: Column) -> Column:
    """64 hex digits; null stays null."""
    return F.sha2(body.cast("binary"), 256)


def canonical_row(columns: list[Column], null: str = "~") -> Column:
    """One text for a row, different for different rows: the values in the given order, nulls marked, joined by ``|``.

    A backslash stands before these signs and itself where they belong to a value.
    """
    plain = lambda c: F.regexp_replace(c.cast("string"), rf"([\\|{null}])", r"\\$1")
    return F.concat_ws("|", *(F.coalesce(plain(c), F.lit(null)) for c in columns))


def cents(c: Column) -> Column:
    """A money double as a long, so that hashes don't hang on how an engine prints doubles."""
    return F.round(c * 100).cast("bigint")


def rollup(key: str, sig: str) -> Column:
    """Hash of a group's ``key=sig;`` parts in key order: an aggregate over a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(sig).alias("s"))))
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["k"], F.lit("="), x["s"], F.lit(";"))), ""), 256)


def merkle(rows: DataFrame, group: list[str], key: str, sig: str) -> DataFrame:
    """``group, sig, n``: one hash for the (key, sig) pairs of each group, whatever their order or number.

    The pairs are dealt into 65,536 leaves by the hash of the key, these into 256 branches, these into
    the root, so that no task holds a whole group; ``key`` is a text, unique in its group.
    """
    tree = rows.select(*group, F.substring(F.sha2(key, 256), 1, 4).alias("b"), F.col(key).alias("k"), F.col(sig).alias("s"))
    tree = tree.groupBy(*group, "b").agg(rollup("k", "s").alias("s"), F.count("*").alias("n"))
    tree = tree.groupBy(*group, F.substring("b", 1, 2).alias("c")).agg(rollup("b", "s").alias("s"), F.sum("n").alias("n"))
    return tree.groupBy(*group).agg(rollup("c", "s").alias("sig"), F.sum("n").alias("n"))


def merkle_sql(source: str, group: list[str], name: str) -> str:
    """The same as SQL: common table expressions that end in ``name``; ``source`` has ``k`` and ``s``."""
    g = "".join(f"{c}, " for c in group)
    step = lambda t, b, k, n: f"SELECT {g}{b} AS b, sha256(string_agg({k} || '=' || s || ';', '' ORDER BY {k})) AS s, {n} AS n FROM {t} GROUP BY ALL"
    root = f"SELECT {g}sha256(string_agg(b || '=' || s || ';', '' ORDER BY b)) AS sig, sum(n)::bigint AS n FROM {name}2" + (f" GROUP BY {', '.join(group)}" if group else "")
    second = f"SELECT {g}substr(b, 1, 2) AS b, sha256(string_agg(b || '=' || s || ';', '' ORDER BY b)) AS s, sum(n) AS n FROM {name}1 GROUP BY {g}substr(b, 1, 2)"
    return f"{name}1 AS ({step(source, 'substr(sha256(k), 1, 4)', 'k', 'count(*)')}), {name}2 AS ({second}), {name} AS ({root})"
