"""Operators along an order or a grid: offsets, batches, surfaces, shades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a bucket of the order; a bucket is numbered in one task, the buckets' sums in another.
BUCKET = 65_536


def running(rows: DataFrame, key: str, size: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows before, by ascending ``key`` (a unique integer).

    Rows are summed inside buckets of the key; what lies before a bucket comes from the buckets' sums,
    by the same way where the buckets are many, as with sparse keys. So no task sees more than
    ``bucket`` rows, and four rounds do for any keys of 64 bits.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    rows = rows.withColumns({"__b": F.floor(F.col(key) / bucket), "__s": size.cast("bigint")})
    sums = rows.groupBy("__b").agg(F.sum("__s").alias("__t"))
    if low is not None and (high - low) // bucket > bucket:
        base = running(sums.withColumnRenamed("__b", "__k"), "__k", F.col("__t"), "__before", bucket).select(F.col("__k").alias("__b"), F.col("__before").alias("__base"))
    else:
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__s").over(inside), F.lit(0))).join(base, "__b")
    return rows.withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__s", "__in", "__base")


def fixed_batches(rows: DataFrame, key: str, size: int, name: str = "batch") -> DataFrame:
    """Numbers of batches of ``size`` rows in key order."""
    return running(rows, key, F.lit(1), "__n").withColumn(name, F.floor(F.col("__n") / size)).drop("__n")


def greedy_batches(rows: DataFrame, group: str, key: str, size: str, limit: int) -> DataFrame:
    """``group, key, batch``: a batch is closed once its sizes reach ``limit``; then the sum starts again.

    The reset makes this a fold over each group's rows in key order; groups are lists to push, and a
    list of ids and sizes is small beside its objects.
    """
    import pyarrow as pa

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, key)}

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending"), (size, "ascending")])
        batch, total, out = 0, 0, []
        for n in table.column(size).to_pylist():
            out.append(batch)
            total += n or 0
            if total >= limit:
                batch, total = batch + 1, 0
        return pa.table({group: table.column(group), key: table.column(key), "batch": pa.array(out, pa.int64())})

    return rows.select(group, key, size).groupBy(group).applyInArrow(fold, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, batch bigint")


def topmost(cells: DataFrame, column: list[str], height: str, state: str, ties: list[str], keep: Column | None = None) -> DataFrame:
    """The highest kept cell of each column: ``height`` and ``state``; ties go by the further keys."""
    cells = cells if keep is None else cells.where(keep)
    top = F.max(F.struct(height, *ties, state))
    return cells.groupBy(*column).agg(top.alias("t")).select(*column, F.col(f"t.{height}").alias(height), F.col(f"t.{state}").alias(state))


def north_height(cells: DataFrame, column: str, row: str, height: str) -> DataFrame:
    """``cells`` with ``north``: the height in the row before; null where that row is absent."""
    w = Window.partitionBy(column).orderBy(row)
    return cells.withColumn("north", F.when(F.col(row) - F.lag(row).over(w) == 1, F.lag(height).over(w)))


def map_bounds(cells: DataFrame, x: str, z: str, side: int) -> DataFrame:
    """One row: the bounding box, cut to ``side`` around the middle where it is larger."""
    box = cells.agg(*(f(c).alias(f"{n}_{a}") for c, a in ((x, "x"), (z, "z")) for n, f in (("min", F.min), ("max", F.max))))
    for a in ("x", "z"):
        low, high = F.col(f"min_{a}"), F.col(f"max_{a}")
        large = high - low + 1 > side
        mid = F.floor((low + high) / 2)
        box = box.withColumns({f"from_{a}": F.when(large, mid - side // 2).otherwise(low).cast("bigint"), f"to_{a}": F.when(large, mid - side // 2 + side - 1).otherwise(high).cast("bigint")})
    return box


def nth_latest(log: DataFrame, ref: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n``-th most recent entry of each ref, 0 being the last."""
    w = Window.partitionBy(*ref).orderBy(*order)
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == n + 1).drop("__n")
