"""Queries on worlds: find, inspect, changed blocks, surfaces, semantic diffs and patches."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, identity
from ..functions.palette import palette_index
from . import sequence
from ..sources import nbt, region
from ..sources.world import chunks, decode, project, rows_mapped

NODE_CHANGES = "file string, cx int, cz int, path string, kind string, old string, new string, segments string, old_json string, new_json string"


def find_entities(decoded: DataFrame, name: str | None = None) -> DataFrame:
    """``id, pos`` out of both folders that hold entities."""
    rows = decoded.where(F.col("folder").isin("entities", "region")).select(F.explode("entities").alias("e")).select("e.*")
    return rows.where(identity.id_matches(F.col("id"), name))


def find_block_entities(decoded: DataFrame, name: str | None = None) -> DataFrame:
    rows = decoded.where("folder = 'region'").select(F.explode("block_entities").alias("e")).select("e.*")
    return rows.where(identity.id_matches(F.col("id"), name))


def find_signs(decoded: DataFrame) -> DataFrame:
    return find_block_entities(decoded).where(F.col("id").contains("sign"))


def points_of_interest(decoded: DataFrame) -> DataFrame:
    return decoded.where("folder = 'poi'").select(F.explode("poi").alias("p")).select("p.*")


def region_info(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("cx").alias("x"), F.col("cz").alias("z"), F.col("comp").alias("compression"), "bytes", "external", F.col("ts").alias("timestamp"))


def sections(decoded: DataFrame) -> DataFrame:
    """``path, cx, cz, y`` and the section; of two with the same level in a chunk the first counts."""
    rows = decoded.where("folder = 'region'").select("path", "cx", "cz", F.posexplode("sections").alias("at", "s"))
    first = rows.groupBy("path", "cx", "cz", F.col("s.y").alias("y")).agg(F.min_by("s", "at").alias("s"))
    return first.where("y is not null")


def _state(section: str, at: Column) -> Column:
    """The block at a cell; null where data or palette do not reach."""
    p, d = F.col(f"{section}.palette"), F.col(f"{section}.data")
    return F.get(p, palette_index(d, F.size(p), 4, at).cast("int"))


def _states(section: str) -> Column:
    """All 4,096 blocks of a section; null if data or palette leave any cell open."""
    every = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda at: _state(section, at))
    return F.when(F.forall(every, lambda x: x.isNotNull()), every)


def _place(at: Column) -> list[Column]:
    """World coordinates of a section's cell."""
    x, y, z = at % 16, F.floor(at / 256).cast("int"), F.floor((at % 256) / 16).cast("int")
    return [(F.col("cx") * 16 + x).alias("x"), (F.col("y") * 16 + y).alias("y"), (F.col("cz") * 16 + z).alias("z")]


def cells(sections_: DataFrame) -> DataFrame:
    """4,096 rows a section: ``x, y, z, state``; a section with any cell that can't be resolved has none."""
    rows = sections_.select("path", "cx", "cz", "y", F.posexplode(_states("s")).alias("at", "state"))
    return rows.select("path", *_place(F.col("at")), "state")


def inspect(decoded: DataFrame, points: DataFrame) -> DataFrame:
    """``x, y, z, block, biome, block_entity`` for each point of ``points``; absent data gives nulls.

    The points' chunks alone are looked at; of several block entities at a place the last counts.
    """
    wanted = points.select("x", "y", "z").distinct().withColumns({"cx": F.shiftright("x", 4), "cz": F.shiftright("z", 4), "sy": F.shiftright("y", 4)})
    chunks = decoded.where("folder = 'region'").join(wanted.select("cx", "cz").distinct(), ["cx", "cz"], "left_semi")
    secs = sections(chunks).select("cx", "cz", F.col("y").alias("sy"), "s")
    inner = lambda c: F.col(c).bitwiseAND(15)
    cell = inner("y") * 256 + inner("z") * 16 + inner("x")
    biome_cell = F.floor(inner("y") / 4) * 16 + F.floor(inner("z") / 4) * 4 + F.floor(inner("x") / 4)
    rows = wanted.join(secs, ["cx", "cz", "sy"], "left")
    biome = F.get("s.biomes", palette_index(F.col("s.biome_data"), F.size("s.biomes"), 1, biome_cell).cast("int"))
    rows = rows.select("x", "y", "z", _state("s", cell).alias("block"), biome.alias("biome"))
    held = chunks.select(F.posexplode("block_entities").alias("at", "e")).select("at", "e.*")
    held = held.groupBy("x", "y", "z").agg(F.max_by("id", "at").alias("block_entity"))
    return rows.join(held, ["x", "y", "z"], "left")


def inspect_raw(raw: DataFrame, points: DataFrame) -> DataFrame:
    """:func:`inspect` on raw chunks, of which only the points' own are decoded."""
    wanted = points.select(F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz")).distinct()
    return inspect(chunks(raw.where("folder = 'region'").join(wanted, ["cx", "cz"], "left_semi")), points)


def changed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Region chunks that both worlds have under different payloads: ``path, cx, cz`` and both sides' ``comp, payload``."""
    a, b = (df.where("folder = 'region'").select("path", "cx", "cz", F.col("comp").alias(f"comp_{n}"), F.col("payload").alias(f"payload_{n}"), F.col("payload_hash").alias(f"hash_{n}")) for df, n in ((old, "a"), (new, "b")))
    return a.join(b, ["path", "cx", "cz"]).where("hash_a <> hash_b").drop("hash_a", "hash_b")


def block_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, cx, cz, x, y, z, old, new`` of blocks that differ, in chunks that both worlds have.

    Chunks with equal payloads are not decoded, and only the cells that differ become rows. A section
    that one side lacks, or can't resolve, gives all cells of the other; a chunk that can't be decoded none.
    """

    def work(row: dict) -> Iterator[dict]:
        sides = []
        for n in "ab":
            found: dict[int, dict] = {}
            for s in project(_tree(row, n))["sections"]:
                if s["y"] is not None:
                    found.setdefault(s["y"], {"palette": s["palette"], "data": s["data"]})  # of two at a level the first counts
            sides.append(found)
        for y in sorted({*sides[0], *sides[1]}):
            if sides[0].get(y) != sides[1].get(y):
                yield {"path": row["path"], "cx": row["cx"], "cz": row["cz"], "y": y, "a": sides[0].get(y), "b": sides[1].get(y)}

    def decoded(row: dict) -> Iterator[dict]:
        try:
            yield from work(row)
        except ValueError:
            return

    part = "struct<palette: array<string>, data: array<bigint>>"
    both = rows_mapped(changed_pairs(old, new), f"path string, cx int, cz int, y int, a {part}, b {part}", decoded, 64)
    both = both.withColumns({n: F.when(F.col(n).isNotNull(), _states(n)) for n in "ab"}).where("a is not null or b is not null")
    differ = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda at: F.struct(at.alias("at"), F.get("a", at).alias("old"), F.get("b", at).alias("new"))), lambda c: ~c["old"].eqNullSafe(c["new"]))
    rows = both.select("path", "cx", "cz", "y", F.explode(differ).alias("c"))
    return rows.select("path", "cx", "cz", *_place(F.col("c.at")), "c.old", "c.new")


def where_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``x, y, z, old, new`` of blocks that differ, from both worlds' raw chunks."""
    return block_edits(old, new).select("x", "y", "z", "old", "new")


#: Heights below which the top block is looked for, where a dimension has a ceiling.
CEILING = {"nether": 120, "the_nether": 120, "minecraft:the_nether": 120, "-1": 120, "DIM-1": 120}


def surface(decoded: DataFrame, least_y: int = -64, most_y: int = 319) -> DataFrame:
    """The top block of each column that is not air, between two heights: ``x, z, y, state``."""
    rows = cells(sections(decoded)).where(F.col("y").between(least_y, most_y))
    return sequence.topmost(rows, ["x", "z"], "y", "state", [], ~color.is_air(F.regexp_replace("state", r"\[.*$", "")))


def pixels(top: DataFrame) -> DataFrame:
    """``x, z, r, g, b`` of a surface, shaded by the height of the block to the north."""
    w = Window.partitionBy("x").orderBy("z")
    rows = top.withColumn("north", F.when(F.col("z") - F.lag("z").over(w) == 1, F.lag("y").over(w))).withColumn("c", color.block_color(F.regexp_replace("state", r"\[.*$", "")))
    return rows.select("x", "z", *(color.shaded(F.col(f"c.{k}"), F.col("y"), F.col("north")).alias(k) for k in "rgb"))


# Semantic diff and patches ------------------------------------------------------------------------------


def _tree(row: dict, side: str) -> nbt.Node:
    return decode(row[f"comp_{side}"], row[f"payload_{side}"])


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """NODE_CHANGES between two worlds' raw chunks, whole chunks with the empty path.

    Equal payloads never reach the decoder. A chunk that can't be decoded counts as modified whole.
    """
    side = lambda df, n: df.select(F.col("path").alias("file"), "cx", "cz", F.col("comp").alias(f"comp_{n}"), F.col("payload").alias(f"payload_{n}"), F.col("payload_hash").alias(f"hash_{n}"))
    pairs = side(old, "a").join(side(new, "b"), ["file", "cx", "cz"], "full").where("not (hash_a <=> hash_b and comp_a <=> comp_b)")

    def work(row: dict) -> Iterator[dict]:
        base = {k: row[k] for k in ("file", "cx", "cz")}
        has = [row[f"payload_{n}"] is not None for n in "ab"]
        try:
            trees = [_tree(row, n) if h else None for n, h in zip("ab", has, strict=True)]
        except ValueError:
            yield base | {"path": "", "kind": "modified", "old": None, "new": None, "segments": "[]", "old_json": None, "new_json": None}
            return
        if not all(has):
            found = [((), "removed" if has[0] else "added", *trees)]
        else:
            found = nbt.changes(*trees)
        for path, kind, a, b in sorted(found, key=lambda c: nbt.path_text(list(c[0]))):
            js = [None if x is None else nbt.to_json(x) for x in (a, b)]
            yield base | {"path": nbt.path_text(list(path)), "kind": kind, "old": nbt.brief(a), "new": nbt.brief(b), "segments": json.dumps(path), "old_json": js[0], "new_json": js[1]}

    return rows_mapped(pairs, NODE_CHANGES, work)


def file_summary(changes: DataFrame) -> DataFrame:
    """``file, n_node_changes, n_chunks`` of files with a semantic change."""
    return changes.groupBy("file").agg(F.count("*").alias("n_node_changes"), F.count_distinct("cx", "cz").alias("n_chunks"))


def reverse_patch(changes: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "added", "removed").when(F.col("kind") == "removed", "added").otherwise(F.col("kind"))
    return changes.withColumns({"kind": kind, "old": F.col("new"), "new": F.col("old"), "old_json": F.col("new_json"), "new_json": F.col("old_json")})


def apply_patch(base: DataFrame, changes: DataFrame, force: bool = False) -> DataFrame:
    """``path, cx, cz, comp, payload, conflicts`` of every chunk after the patch; removed ones are gone.

    A change is done only where the chunk is as its old value says, or by force. Chunks without
    changes keep their payload as it is.
    """
    ops = changes.groupBy(F.col("file").alias("path"), "cx", "cz").agg(F.array_sort(F.collect_list(F.struct("segments", "old_json", "new_json"))).alias("ops"))
    rows = base.select("path", "cx", "cz", "comp", "payload").join(ops, ["path", "cx", "cz"], "full")
    out = "path string, cx int, cz int, comp tinyint, payload binary, conflicts array<string>"
    plain = rows.where("ops is null").select("path", "cx", "cz", "comp", "payload", F.expr("cast(array() as array<string>)").alias("conflicts"))

    def work(row: dict) -> Iterator[dict]:
        key = {k: row[k] for k in ("path", "cx", "cz")}
        comp = row["comp"] or region.ZLIB
        root = None if row["payload"] is None else decode(comp, row["payload"])
        node = lambda text: None if text is None else nbt.from_json(text)
        ops_ = [(tuple(json.loads(o["segments"])), node(o["old_json"]), node(o["new_json"])) for o in row["ops"]]
        whole = next((o for o in ops_ if not o[0]), None)
        if whole:
            fits = force or (root is None if whole[1] is None else root is not None and nbt.same(root, whole[1]))
            root, bad = (whole[2], []) if fits else (root, [""])
        elif root is None:
            bad = [nbt.path_text(list(o[0])) for o in ops_]
        else:
            bad = nbt.apply(root, ops_, force)
        if root is not None:
            yield key | {"comp": comp, "payload": region.deflate(comp, nbt.write(root)), "conflicts": bad}
        elif bad:
            yield key | {"comp": comp, "payload": None, "conflicts": bad}

    return plain.unionByName(rows_mapped(rows.where("ops is not null"), out, work))


# Whole worlds: differences and patches of entries, whatever their kind -----------------------------------

ENTRY_CHANGES = "entry string, file string, pos string, path string, kind string, old string, new string, segments string, old_json string, new_json string"
_TREES = ("region", "nbt")


def _text(kind: str, body: bytes | None) -> str | None:
    """A whole entry for a patch: trees as tagged JSON, all else in base 64."""
    if body is None:
        return None
    return nbt.to_json(nbt.read(body)[1]) if kind in _TREES else base64.b64encode(body).decode()


def entry_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ENTRY_CHANGES between the entries (``kind, path, pos, body``) of two worlds.

    Trees that both have are compared by nodes; what one side lacks, and files of other kinds, change
    whole, under the empty path. Entries with equal bodies reach no decoder.
    """
    key = ["kind", "path", "pos"]
    side = lambda df, n: df.select(*key, F.col("body").alias(n), F.sha2("body", 256).alias(f"h{n}"))
    pairs = side(old, "a").join(side(new, "b"), key, "full").where("not (ha <=> hb)").drop("ha", "hb")

    def work(row: dict) -> Iterator[dict]:
        kind, a, b = row["kind"], row["a"], row["b"]
        base = {"entry": kind, "file": row["path"], "pos": row["pos"]}
        if kind in _TREES and a is not None and b is not None:
            found = nbt.changes(nbt.read(a)[1], nbt.read(b)[1])
            for path, what, x, y in sorted(found, key=lambda c: nbt.path_text(list(c[0]))):
                js = [None if v is None else nbt.to_json(v) for v in (x, y)]
                yield base | {"path": nbt.path_text(list(path)), "kind": what, "old": nbt.brief(x), "new": nbt.brief(y), "segments": json.dumps(path), "old_json": js[0], "new_json": js[1]}
            return
        brief = [None if v is None else f"{len(v)} bytes" for v in (a, b)]
        what = "added" if a is None else "removed" if b is None else "modified"
        yield base | {"path": "", "kind": what, "old": brief[0], "new": brief[1], "segments": "[]", "old_json": _text(kind, a), "new_json": _text(kind, b)}

    return rows_mapped(pairs, ENTRY_CHANGES, work)


def apply_entries(base: DataFrame, changes: DataFrame, force: bool = False) -> DataFrame:
    """``kind, path, pos, body, conflicts`` of every entry after the patch; removed ones are gone.

    A change is done only where the entry is as its old value says, or by force; the paths of the others
    are the conflicts. Entries without changes stay as they are.
    """
    key = ["kind", "path", "pos"]
    ops = changes.groupBy(F.col("entry").alias("kind"), F.col("file").alias("path"), "pos").agg(F.array_sort(F.collect_list(F.struct("segments", "old_json", "new_json"))).alias("ops"))
    rows = base.select(*key, "body").join(ops, key, "full")
    plain = rows.where("ops is null").select(*key, "body", F.expr("cast(array() as array<string>)").alias("conflicts"))

    def whole(kind: str, text: str | None) -> bytes | None:
        if text is None:
            return None
        return nbt.canonical(nbt.from_json(text)) if kind in _TREES else base64.b64decode(text)

    def work(row: dict) -> Iterator[dict]:
        kind, body, bad = row["kind"], row["body"], []
        ops_ = [(tuple(json.loads(o["segments"])), o["old_json"], o["new_json"]) for o in row["ops"]]
        at_once = next((o for o in ops_ if not o[0]), None)
        if at_once:
            if force or whole(kind, at_once[1]) == body:
                body = whole(kind, at_once[2])
            else:
                bad = [""]
        elif body is None:
            bad = [nbt.path_text(list(o[0])) for o in ops_]
        else:
            root = nbt.read(body)[1]
            bad = nbt.apply(root, [(s, *(None if t is None else nbt.from_json(t) for t in texts)) for s, *texts in ops_], force)
            body = nbt.canonical(root)
        if body is not None or bad:
            yield {k: row[k] for k in key} | {"body": body, "conflicts": bad}

    return plain.unionByName(rows_mapped(rows.where("ops is not null"), "kind string, path string, pos string, body binary, conflicts array<string>", work))


#: Block edits that a chunk shows.
SHOWN_EDITS = 8


def diff_lines(old: DataFrame, new: DataFrame, changes: DataFrame, edits: DataFrame) -> DataFrame:
    """``file, line`` in order of a world's differences as a text: files, their nodes and chunks, the first block edits of each.

    ``old``, ``new``: the entries; ``changes``: of :func:`entry_changes`; ``edits``: of :func:`block_edits`.
    """
    sides = old.select("path", F.lit(0).alias("s")).unionByName(new.select("path", F.lit(1).alias("s"))).groupBy("path").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    touched = changes.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n")).join(sides, "path")
    mark = F.when(F.col("a") == 1, "+").when(F.col("b") == 0, "-").otherwise("~")
    touched = touched.select("path", mark.alias("mark"))
    none, zero = F.lit("").alias("pos"), F.lit(0)
    out = [touched.select("path", none, zero.alias("step"), zero.alias("i"), F.concat_ws(" ", "mark", "path").alias("line"))]
    inside = changes.withColumnRenamed("path", "node").join(touched.where("mark = '~'").select(F.col("path").alias("file")), "file")
    name = F.regexp_replace(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), " ", "")
    trees = inside.where("entry <> 'region' and node <> ''")
    w = Window.partitionBy("file").orderBy("node")
    out.append(trees.select(F.col("file").alias("path"), none, F.lit(1).alias("step"), F.row_number().over(w).alias("i"), F.concat(F.lit("    "), "node", F.lit(" ("), name, F.lit(")")).alias("line")))
    chunk = inside.where("entry = 'region'").groupBy("file", "pos").agg(F.count("*").alias("n"), F.min(F.col("node")).alias("node"), F.min("kind").alias("kind"))
    sign = F.when(F.col("node") != "", "~").when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise("~")
    told = F.when(sign == "~", F.concat(F.lit(" ("), "n", F.lit(" changes)"))).otherwise("")
    out.append(chunk.select(F.col("file").alias("path"), "pos", F.lit(2).alias("step"), zero.alias("i"), F.concat(F.lit("    "), sign, F.lit(" chunk "), "pos", told).alias("line")))
    w = Window.partitionBy("path", "cx", "cz").orderBy("y", "z", "x")
    ranked = edits.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("path", "cx", "cz")), "pos": F.concat_ws(",", "cx", "cz")}).where(F.col("i") <= SHOWN_EDITS + 1)
    text = F.concat(F.lit("        @"), F.concat_ws(",", "x", "y", "z"), F.lit(": "), F.coalesce("old", F.lit("-")), F.lit(" -> "), F.coalesce("new", F.lit("-")))
    more = F.concat(F.lit("        … and "), F.col("n") - SHOWN_EDITS, F.lit(" more block changes"))
    out.append(ranked.select("path", "pos", F.lit(3).alias("step"), "i", F.when(F.col("i") <= SHOWN_EDITS, text).otherwise(more).alias("line")))
    lines = out[0]
    for more_ in out[1:]:
        lines = lines.unionByName(more_)
    xz = F.split("pos", ",")
    return lines.orderBy("path", F.when(F.col("step") < 2, F.col("step")).otherwise(2), F.get(xz, F.lit(0)).try_cast("int"), F.get(xz, F.lit(1)).try_cast("int"), "step", "i").select(F.col("path").alias("file"), "line")
