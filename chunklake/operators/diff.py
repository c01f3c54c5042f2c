"""Keyed semantic diffs of tables: rows, cells, types, aligned lists, snapshots' files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differs(a: Column, b: Column, floating: bool = False) -> Column:
    """Unlike values: null differs from a value; a NaN differs from everything, itself included."""
    out = ~a.eqNullSafe(b)
    return out | F.coalesce(F.isnan(a), F.lit(False)) if floating else out


def _sides(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], how: str) -> DataFrame:
    """Joined on the keys: ``a`` and ``b``, structs of the fields, null where the side has no row."""
    side = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    return side(a, "a").join(side(b, "b"), keys, how)


def _floating(df: DataFrame, fields: list[str]) -> set[str]:
    return {f for f in fields if df.schema[f].dataType.simpleString() in ("double", "float")}


def _changed(df: DataFrame, fields: list[str]) -> Column:
    nan = _floating(df, fields)
    return reduce(or_, (differs(F.col(f"a.{f}"), F.col(f"b.{f}"), f in nan) for f in fields))


def _kind(changed: Column) -> Column:
    return F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(changed, "modified")


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys, ``kind`` and both versions of every added, removed or modified row."""
    rows = _sides(a, b, keys, fields, "full")
    return rows.withColumn("kind", _kind(_changed(a, fields))).where("kind is not null").select(*keys, "kind", "a", "b")


def where_changed(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Modified rows only: what one side lacks is not reported."""
    return _sides(a, b, keys, fields, "inner").where(_changed(a, fields)).select(*keys, "a", "b")


def node_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each changed cell: keys, ``path, kind, old, new`` (texts).

    The sides are joined once by row; only rows that differ are spread into cells.
    """
    nan = _floating(a, fields)
    rows = _sides(a, b, keys, fields, "full")
    rows = rows.where(F.col("a").isNull() | F.col("b").isNull() | _changed(a, fields))
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    kind = lambda f: F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(differs(F.col(f"a.{f}"), F.col(f"b.{f}"), f in nan), "modified")
    cells = F.array(*(F.struct(F.lit(f).alias("path"), kind(f).alias("kind"), text("a", f).alias("old"), text("b", f).alias("new")) for f in fields))
    return rows.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("kind is not null")


def type_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, tag) -> DataFrame:  # noqa: ANN001
    """Like :func:`keyed_diff` for one value whose type ``tag`` tells: a change of type has its own kind."""
    rows = _sides(a, b, keys, [value], "full")
    old, new = F.col(f"a.{value}"), F.col(f"b.{value}")
    modified = F.when(tag(old) != tag(new), "type_changed").when(differs(old, new), "modified")
    kind = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise(modified)
    return rows.select(*keys, kind.alias("kind"), old.alias("old"), new.alias("new")).where("kind is not null")


def identity_unique(rows: DataFrame, parent: list[str], ident: str) -> DataFrame:
    """Whether a list's entries all have an identity and no two the same one."""
    n, known, distinct = F.count("*"), F.count(ident), F.count_distinct(ident)
    return rows.groupBy(*parent).agg(n.alias("n"), distinct.alias("n_ident"), ((n == known) & (n == distinct)).alias("unique"))


def align_lists(a: DataFrame, b: DataFrame, parent: list[str], ident: str, at: str, value: str) -> DataFrame:
    """Diff of lists: by identity where both sides' are complete and unique, else by position.

    Parents that one side lacks count as empty lists there, hence positional.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*parent)
        unique = (F.count("*").over(w) == F.count(ident).over(w)) & (F.size(F.collect_set(ident).over(w)) == F.count("*").over(w))
        return df.select(*parent, F.col(ident).alias("ident"), F.col(at).alias("at"), F.col(value).alias("value"), unique.alias("unique")).withColumn("side", F.lit(name))

    both = side(a, "a").unionByName(side(b, "b"))
    w = Window.partitionBy(*parent)
    keyed = F.min("unique").over(w) & (F.min("side").over(w) != F.max("side").over(w))
    both = both.withColumn("keyed", keyed).withColumn("slot", F.when(F.col("keyed"), F.concat(F.lit("id:"), F.col("ident"))).otherwise(F.concat(F.lit("["), F.col("at").cast("string"), F.lit("]"))))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    rows = both.groupBy(*parent, "keyed", "slot").agg(F.max((F.col("side") == "a").cast("int")).alias("has_a"), F.max((F.col("side") == "b").cast("int")).alias("has_b"), pick("a", "value").alias("old"), pick("b", "value").alias("new"))
    kind = F.when(F.col("has_b") == 0, "removed").when(F.col("has_a") == 0, "added").when(differs(F.col("old"), F.col("new")), "modified")
    return rows.withColumn("kind", kind).where("kind is not null").select(*parent, "keyed", "slot", "kind", "old", "new")


def status(old: DataFrame, new: DataFrame, path: str, sig: str) -> DataFrame:
    """``path, code``: A, D or M for files whose signatures differ."""
    rows = old.select(path, F.col(sig).alias("a")).join(new.select(path, F.col(sig).alias("b")), path, "full")
    code = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(F.col("a") != F.col("b"), "M")
    return rows.select(path, code.alias("code")).where("code is not null")


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under a total order, with their number ``rn``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)
