"""The tables as worlds: rows become chunks, trees and player files, and the world's own operators read them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import cents
from ..operators import worlds
from ..sources import nbt, region, world
from .diffs import LINE_KEY, _lines
from .tables import table

_CHUNK = "path string, folder string, cx int, cz int, comp tinyint, payload binary"
_INTS = 1 << 31


def _tree(**fields: nbt.Node | None) -> nbt.Node:
    return nbt.COMPOUND, {k: v for k, v in fields.items() if v is not None}


def _chunks(spark: SparkSession, sf_dir: str, folder: str, build: Callable[[dict], nbt.Node], lines: DataFrame | None = None, key: str = "l_orderkey") -> DataFrame:
    """Raw chunks, one for each key, whose tree ``build`` makes of the key's lines in order."""
    rows = _lines(spark, sf_dir) if lines is None else lines
    cells = rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(*LINE_KEY, "flag", "price"))).alias("records"))

    def work(row: dict) -> Iterator[dict]:
        body = region.deflate(region.ZLIB, nbt.write(build(row)), 1)
        yield {"path": f"{folder}/r.0.0.mca", "folder": folder, "cx": row["key"] % _INTS, "cz": 0, "comp": region.ZLIB, "payload": body}

    return world.rows_mapped(cells, _CHUNK, work)


def find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entities that stand at part, order and supplier, named by their flag."""

    def build(row: dict) -> nbt.Node:
        pos = lambda r: (nbt.LIST, [(nbt.DOUBLE, float(r[c])) for c in ("l_partkey", "l_orderkey", "l_suppkey")])
        return _tree(Entities=(nbt.LIST, [_tree(id=(nbt.STRING, f"minecraft:{r['flag'].lower()}"), Pos=pos(r)) for r in row["records"]]))

    found = worlds.find_entities(world.chunks(_chunks(spark, sf_dir, "entities", build)), "r")
    at = lambda i: F.get("pos", F.lit(i)).cast("bigint")
    return found.select(at(1).alias("l_orderkey"), "id", at(0).alias("x"), at(2).alias("z"))


def find_block_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the new name in even orders, else the old one in those that 3 divides; odd lines have no x."""

    def build(row: dict) -> nbt.Node:
        one = lambda r: _tree(id=(nbt.STRING, r["flag"]), x=(nbt.INT, r["l_partkey"]) if r["l_linenumber"] % 2 == 0 else None, y=(nbt.INT, r["l_orderkey"]), z=(nbt.INT, r["l_suppkey"]), Text1=(nbt.STRING, str(r["price"])))
        every = (nbt.LIST, [one(r) for r in row["records"]])
        return _tree(block_entities=every if row["key"] % 2 == 0 else None, TileEntities=every if row["key"] % 3 == 0 else None)

    found = worlds.find_block_entities(world.chunks(_chunks(spark, sf_dir, "region", build)))
    return found.select(F.col("y").cast("bigint").alias("l_orderkey"), "id", F.col("x").cast("bigint").alias("x"), F.col("z").cast("bigint").alias("z"), F.get("text", F.lit(0)).cast("bigint").alias("price"))


def poi_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by line number, each with a list of records."""

    def build(row: dict) -> nbt.Node:
        levels: dict[str, list] = {}
        for r in row["records"]:
            levels.setdefault(str(r["l_linenumber"]), []).append(_tree(type=(nbt.STRING, r["flag"]), pos=(nbt.INTS, [r["l_partkey"], r["l_suppkey"], r["price"]])))
        return _tree(Sections=(nbt.COMPOUND, {k: _tree(Records=(nbt.LIST, v)) for k, v in levels.items()}))

    found = worlds.points_of_interest(world.chunks(_chunks(spark, sf_dir, "poi", build)))
    return found.select("kind", *(F.col(c).cast("bigint").alias(c) for c in "xyz"))


def region_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with the size of their payload and whether it lies outside the region file."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    raw = table(spark, sf_dir, "documents", "doc_id", "text").select(
        (F.col("doc_id") % 32).alias("cx"), F.expr("doc_id div 32").alias("cz"), F.lit(region.ZLIB).alias("comp"), size.alias("bytes"), (size > 20_000).alias("external"), F.lit(0).alias("ts")
    )
    return worlds.region_info(raw).select("x", "z", "bytes", "external")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as player files, the host being customer 0; each 29th can't be read."""
    kind = table(spark, sf_dir, "customer", "c_nationkey").schema["c_nationkey"].dataType.simpleString()
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", cents(F.col("c_acctbal")).alias("health"))

    def work(row: dict) -> Iterator[dict]:
        host = row["c_custkey"] == 0
        pos = (nbt.LIST, [(nbt.DOUBLE, float(v)) for v in (row["c_custkey"], row["c_nationkey"], 0)]) if row["c_custkey"] % 5 else None
        one = _tree(Pos=pos, XpLevel=(nbt.INT, row["c_nationkey"]), Health=(nbt.FLOAT, float(row["health"])))
        root = _tree(Data=_tree(Player=one)) if host else one
        body = b"no tree" if row["c_custkey"] % 29 == 0 and not host else region.deflate(region.GZIP, nbt.write(root))
        yield {"path": "level.dat" if host else f"playerdata/{row['c_name']}.dat", "content": body}

    found = world.players_in(world.rows_mapped(rows, "path string, content binary", work))
    at = lambda i: F.get("pos", F.lit(i)).cast("bigint")
    return found.select("id", at(0).alias("x"), at(1).alias("z"), F.col("xp_level").cast(kind).alias("xp_level"), F.col("health").cast("bigint").alias("health"))


def _inspected(spark: SparkSession, sf_dir: str, lines: DataFrame, points: DataFrame) -> DataFrame:
    """Orders as blocks of a row: sixteen to a chunk, the block tells how many lines, the block entities are the lines.

    ``lines`` hold those of the points at least.
    """
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.lit(0).cast("bigint").alias("price"), F.shiftright("l_orderkey", 4).alias("chunk"))

    def build(row: dict) -> nbt.Node:
        n: dict[int, int] = {}
        for r in row["records"]:
            n[r["l_orderkey"] & 15] = n.get(r["l_orderkey"] & 15, 0) + 1
        names = ["air", *sorted({str(v) for v in n.values()})]
        word = sum(names.index(str(v)) << 4 * x for x, v in n.items())
        states = _tree(palette=(nbt.LIST, [_tree(Name=(nbt.STRING, k)) for k in names]), data=(nbt.LONGS, [word - (1 << 64) if word >> 63 else word] + [0] * 255))
        lines = sorted(row["records"], key=lambda r: (r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["flag"]))
        held = [_tree(id=(nbt.STRING, r["flag"]), x=(nbt.INT, r["l_orderkey"]), y=(nbt.INT, 0), z=(nbt.INT, 0)) for r in lines]
        return _tree(sections=(nbt.LIST, [_tree(Y=(nbt.BYTE, 0), block_states=states)]), block_entities=(nbt.LIST, held))

    raw = _chunks(spark, sf_dir, "region", build, lines, "chunk")
    at = points.select(F.col("l_orderkey").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    found = worlds.inspect_raw(raw, at)
    n = F.when(F.col("block") != "air", F.col("block").cast("bigint"))
    return found.select(F.col("x").cast("bigint").alias("l_orderkey"), F.col("block_entity").alias("flag"), n.alias("n"))


def inspect_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order's lines: the filter reaches the scan; of several the last wins."""
    point = spark.createDataFrame([(42,)], "l_orderkey bigint")
    return _inspected(spark, sf_dir, table(spark, sf_dir, "lineitem").where("l_orderkey = 42"), point)


def inspect_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of points looked up at once; absent ones give nulls."""
    points = spark.createDataFrame([(k * 37,) for k in range(200)], "l_orderkey bigint")
    lines = table(spark, sf_dir, "lineitem")
    near = F.broadcast(points.select(F.shiftright("l_orderkey", 4).alias("chunk")).distinct())
    return _inspected(spark, sf_dir, lines.join(near, F.shiftright("l_orderkey", 4) == F.col("chunk"), "left_semi"), points)
