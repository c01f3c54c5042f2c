"""Worlds as DataFrames: files, raw chunks, decoded trees and typed projections.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reaches will do; Python sees
the bytes in Arrow batches only to take containers and trees apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from . import nbt, region, storage

RAW = "path string, folder string, rx int, rz int, cx int, cz int, comp tinyint, payload binary, bytes int, external boolean, ts int, payload_hash string"
SECTION = "y int, palette array<string>, data array<bigint>, biomes array<string>, biome_data array<bigint>"
POINT = "id string, pos array<double>"
BLOCK_ENTITY = "id string, x int, y int, z int, text array<string>"
POI = "kind string, x int, y int, z int"
DECODED = f"path string, folder string, cx int, cz int, sections array<struct<{SECTION}>>, entities array<struct<{POINT}>>, block_entities array<struct<{BLOCK_ENTITY}>>, poi array<struct<{POI}>>"
PLAYER = "id string, source string, pos array<double>, dimension string, health float, xp_level int"


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_mapped(df: DataFrame, ddl: str, work: Callable[[dict], Iterator[dict]], batch: int = 256) -> DataFrame:
    """Each row to any number of rows of another schema, in Arrow batches of ``batch`` rows."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for k in range(0, b.num_rows, 16):  # a region file is large, its chunks many
                for row in b.slice(k, 16).to_pylist():
                    for out in work(row):
                        held.append(out)
                        if len(held) >= batch:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, ddl)


#: Bytes of a file that Spark's readers hide, beyond which it is not taken through the driver.
MOST_HIDDEN = 64 << 20
LOCK = "session.lock"


def files(spark: SparkSession, root: str, glob: str | None = None, content: bool = True) -> DataFrame:
    """``path`` (relative), ``length`` and ``content`` of the files under ``root``, without any ``session.lock``.

    Spark's readers pass over names that begin with ``_`` or ``.``; :func:`all_files` has these too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    df = df.withColumn("path", F.substring("path", len(storage.qualified(spark, root)) + 2, 1 << 20)).where(F.substring_index("path", "/", -1) != LOCK)
    return df.select("path", "length", *(["content"] if content else []))


def _hidden(path: str) -> bool:
    return any(p[0] in "_." or p.endswith("._COPYING_") for p in path.split("/"))


def all_files(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """``path, content`` of every file under ``root``, and of empty folders with null content.

    ``skip`` is a folder that is left out, such as a repository inside the world. Files with names that
    Spark hides go through the driver one by one; one of more than MOST_HIDDEN bytes is an error.
    """
    base = storage.qualified(spark, root)
    part = storage.qualified(spark, skip)[len(base) + 1 :] if skip and storage.qualified(spark, skip).startswith(f"{base}/") else None
    inside = lambda p: part is not None and (p == part or p.startswith(f"{part}/"))
    found = [x for x in storage.listing(spark, root) if not inside(x[0]) and x[0].rpartition("/")[2] != LOCK]
    full = {p.rpartition("/")[0] for p, _, _ in found}
    rows = [(p, None) for p, _, folder in found if folder and p not in full]
    for path, length, folder in found:
        if not folder and _hidden(path):
            if length > MOST_HIDDEN:
                raise ValueError(f"{path} is too large for a file with a hidden name")
            rows.append((path, bytearray(storage.read_bytes(spark, f"{base}/{path}"))))
    seen = files(spark, root).select("path", "content")
    if part is not None:
        seen = seen.where(~F.col("path").startswith(f"{part}/"))
    return seen.unionByName(spark.createDataFrame(rows, "path string, content binary")) if rows else seen


def raw_chunks(spark: SparkSession, root: str, folders: tuple[str, ...] = ("region", "entities", "poi"), dimension: str | None = None, strict: bool = False, regions: list[tuple[int, int]] | None = None) -> DataFrame:
    """The chunks of all region files under ``root`` (RAW), or of chosen regions, whose files alone are read.

    Files with other names are left out, or fail the query where ``strict``. External bodies join
    from the ``.mcc`` files of the same folder; one that is missing leaves its chunk out, one above
    the bound fails. Only regions with such bodies are read a second time.
    """
    found = files(spark, root, "*.mca")
    folder = F.regexp_extract("path", r"(?:^|/)(region|entities|poi)/[^/]*$", 1)
    found = found.withColumn("folder", folder).where(F.col("folder").isin(*folders))
    if dimension is not None:
        part = coords.dimension_folder(dimension)
        found = found.where(F.col("path").startswith(f"{part}/") if part else ~F.col("path").rlike("^DIM-?1/"))
    rx, rz = coords.region_from_name(F.col("path"))
    if not strict:
        found = found.where(rx.isNotNull())
    if regions is not None:
        found = found.where(F.concat_ws(",", rx, rz).isin([f"{x},{z}" for x, z in regions]))

    def work(row: dict) -> Iterator[dict]:
        x, z = region.region_name(row["path"])
        for c in region.parse(row["path"], row["content"]):
            yield {"path": row["path"], "folder": row["folder"], "rx": x, "rz": z, "cx": c.x, "cz": c.z, "comp": c.compression, "payload": c.payload, "external": c.external, "ts": c.timestamp}

    parsed = lambda df: rows_mapped(df.select("path", "folder", "content"), "path string, folder string, rx int, rz int, cx int, cz int, comp tinyint, payload binary, external boolean, ts int", work)
    both = parsed(found).where("not external")
    outside = external_bodies(spark, root)
    if not outside.isEmpty():
        owners = F.broadcast(outside.select("path").distinct()) if outside.count() <= MOST_OWNERS else outside.select("path")
        large = parsed(found.join(owners, "path", "left_semi")).where("external").drop("payload")
        both = both.unionByName(large.join(outside.withColumnRenamed("body", "payload"), ["path", "cx", "cz"]).select(both.columns))
    return both.select("path", "folder", "rx", "rz", "cx", "cz", "comp", "payload", F.length("payload").alias("bytes"), "external", "ts", F.sha2("payload", 256).alias("payload_hash"))


#: Region files with bodies beside them whose names may be broadcast.
MOST_OWNERS = 100_000


def external_bodies(spark: SparkSession, root: str) -> DataFrame:
    """``path, cx, cz, body``: the bodies beside region files, under the region's path; one above the bound fails."""
    rows = files(spark, root, "c.*.mcc").where("length > 0")
    too_large = F.raise_error(F.concat(F.lit("external chunk above the bound: "), F.col("path")))
    name = r"^(.*?)c\.(-?\d+)\.(-?\d+)\.mcc$"
    cx, cz = (F.regexp_extract("path", name, k).try_cast("int") for k in (2, 3))
    owner = F.concat(F.regexp_extract("path", name, 1), F.lit("r."), F.shiftright(cx, 5), F.lit("."), F.shiftright(cz, 5), F.lit(".mca"))
    body = F.when(F.col("length") > region.MOST_EXTERNAL, too_large).otherwise(F.col("content"))
    return rows.select(owner.alias("path"), cx.alias("cx"), cz.alias("cz"), body.alias("body")).where("path is not null")


def _number(node: nbt.Node | None) -> int | None:
    n = nbt._int(node)  # noqa: SLF001
    return None if n is None else (n + (1 << 31)) % (1 << 32) - (1 << 31)


def _string(node: nbt.Node | None) -> str | None:
    return node[1] if node is not None and node[0] == nbt.STRING else None


def _pos(node: nbt.Node | None) -> list[float] | None:
    if node is None or node[0] != nbt.LIST or len(node[1]) < 3:
        return None
    return [float(x[1]) if x[0] in (nbt.DOUBLE, nbt.FLOAT) else None for x in node[1][:3]]


def block_state(entry: nbt.Node) -> str:
    """``name[k=v,...]`` with the string properties sorted."""
    if entry[0] == nbt.STRING:
        return entry[1]
    props = entry[1].get("Properties") if entry[0] == nbt.COMPOUND else None
    pairs = sorted((k, v[1]) for k, v in props[1].items() if v[0] == nbt.STRING) if props and props[0] == nbt.COMPOUND else []
    name = _string(entry[1].get("Name")) if entry[0] == nbt.COMPOUND else None
    return (name or "") + (f"[{','.join(f'{k}={v}' for k, v in pairs)}]" if pairs else "")


def _items(node: nbt.Node | None) -> list[nbt.Node]:
    return node[1] if node is not None and node[0] == nbt.LIST else []


def _field(root: nbt.Node, *names: str) -> nbt.Node | None:
    """The first of the names at the root, else under the old ``Level``."""
    level = root[1].get("Level")
    for holder in (root, level):
        for n in names:
            if holder is not None and holder[0] == nbt.COMPOUND and n in holder[1]:
                return holder[1][n]
    return None


def _sign_text(v: dict) -> list[str]:
    lines = []
    for side in ("front_text", "back_text"):
        if (s := v.get(side)) is not None and s[0] == nbt.COMPOUND:
            lines += [x[1] for x in _items(s[1].get("messages")) if x[0] == nbt.STRING]
    return lines or [v[k][1] for k in ("Text1", "Text2", "Text3", "Text4") if _string(v.get(k)) is not None]


def _longs(node: nbt.Node | None) -> list[int] | None:
    return node[1] if node is not None and node[0] == nbt.LONGS else None


def project(root: nbt.Node) -> dict:
    """What the queries ask of a chunk, out of its tree."""
    sections = []
    for s in _items(_field(root, "sections", "Sections")):
        v = s[1] if s[0] == nbt.COMPOUND else {}
        blocks, biomes = (x[1] if (x := v.get(k)) is not None and x[0] == nbt.COMPOUND else {} for k in ("block_states", "biomes"))
        sections.append({"y": _number(v.get("Y")), "palette": [block_state(e) for e in _items(blocks.get("palette"))], "data": _longs(blocks.get("data")), "biomes": [e[1] for e in _items(biomes.get("palette")) if e[0] == nbt.STRING], "biome_data": _longs(biomes.get("data"))})
    compounds = lambda *names: [e[1] for e in _items(_field(root, *names)) if e[0] == nbt.COMPOUND]
    entities = [{"id": _string(v.get("id")), "pos": _pos(v.get("Pos"))} for v in compounds("Entities", "entities")]
    block_entities = [{"id": _string(v.get("id")), **{c: _number(v.get(c)) or 0 for c in "xyz"}, "text": _sign_text(v)} for v in compounds("block_entities", "TileEntities")]
    poi = []
    held = _field(root, "Sections")
    if held is not None and held[0] == nbt.COMPOUND:
        for s in held[1].values():
            for r in _items(s[1].get("Records")) if s[0] == nbt.COMPOUND else []:
                p = r[1].get("pos") if r[0] == nbt.COMPOUND else None
                if p is not None and p[0] == nbt.INTS and len(p[1]) >= 3:
                    poi.append({"kind": _string(r[1].get("type")), **dict(zip("xyz", p[1], strict=False))})
    return {"sections": sections, "entities": entities, "block_entities": block_entities, "poi": poi}


def decode(comp: int, payload: bytes) -> nbt.Node:
    return nbt.read(region.inflate(comp, payload))[1]


def chunks(raw: DataFrame) -> DataFrame:
    """Typed projections of raw chunks (DECODED); chunks that can't be decoded are left out."""

    def work(row: dict) -> Iterator[dict]:
        try:
            root = decode(row["comp"], row["payload"])
        except ValueError:
            return
        yield {k: row[k] for k in ("path", "folder", "cx", "cz")} | project(root)

    return rows_mapped(raw.select("path", "folder", "cx", "cz", "comp", "payload"), DECODED, work, 64)


def players(spark: SparkSession, root: str) -> DataFrame:
    """The host from ``level.dat`` and all of ``playerdata``; files that can't be read are left out."""
    return players_in(files(spark, root, "*.dat"))


def players_in(found: DataFrame) -> DataFrame:
    """The players of a world's files (``path, content``)."""
    found = found.where((F.col("path") == "level.dat") | F.col("path").rlike("^playerdata/[^/]+\\.dat$"))

    def work(row: dict) -> Iterator[dict]:
        try:
            root = nbt.read(region.unpack_file(row["content"]))[1]
        except ValueError:
            return
        host = row["path"] == "level.dat"
        node = nbt.get(root, ["Data", "Player"]) if host else root
        if node is None:
            return
        v = node[1]
        health = v.get("Health")
        yield {
            "id": "host" if host else row["path"].rpartition("/")[2].removesuffix(".dat"),
            "source": row["path"],
            "pos": _pos(v.get("Pos")),
            "dimension": _string(v.get("Dimension")),
            "health": float(health[1]) if health is not None and health[0] in (nbt.FLOAT, nbt.DOUBLE) else None,
            "xp_level": _number(v.get("XpLevel")),
        }

    return rows_mapped(found.select("path", "content"), PLAYER, work)
