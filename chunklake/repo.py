"""A repository of snapshots: content-addressed objects, trees, commits, refs and what moves them.

Objects, trees and commits are Parquet tables that only grow; refs, logs and other marks are one
small document. A tree's entries are ``kind, path, pos, id``; any table or world can be turned into
entries with bodies, see :func:`table_entries` and :func:`world_entries`.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coords
from .functions.hashing import canonical_row, content_id, merkle
from .operators import dag, merge
from .session import materialise
from .sources import nbt, region, storage
from .sources.world import all_files, rows_mapped

ENTRY = "kind string, path string, pos string, body binary"
TREE = "tree string, kind string, path string, pos string, id string"
OBJECT = "id string, body binary, raw_len bigint"
CACHE = "key string, id string"
COMMIT = "id string, tree string, parents array<string>, message string, author string, time bigint"
KEY = ["kind", "path", "pos"]
_REF = re.compile(r"^(?![/.])(?!.*\.\.)[^\\\0]{1,255}$")


class RepoError(ValueError):
    """What a repository can't do."""


# Entries ------------------------------------------------------------------------------------------------


def table_entries(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The rows of a table as entries: position is the key, the body the other columns in name order."""
    rest = sorted(c for c in df.columns if c not in keys)
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return df.select(F.lit("table").alias("kind"), F.lit(name).alias("path"), canonical_row([F.col(k) for k in keys]).alias("pos"), body.cast("binary").alias("body"))


def _world_rows(spark: SparkSession, root: str, skip: str | None) -> DataFrame:
    """``kind, path, content, beside`` of a world's files; ``beside``: the oversized chunk bodies of a region."""
    found = all_files(spark, root, skip).withColumn("kind", F.when(F.col("content").isNull(), "dir").otherwise(coords.path_class(F.col("path"))))
    name = r"^(.*/|)c\.(-?\d+)\.(-?\d+)\.mcc$"
    cx, cz = (F.regexp_extract("path", name, k).try_cast("int") for k in (2, 3))
    owner = F.concat(F.regexp_extract("path", name, 1), F.lit("r."), F.shiftright(cx, 5), F.lit("."), F.shiftright(cz, 5), F.lit(".mca"))
    found = found.withColumn("owner", F.when(F.col("path").rlike(name), owner))
    bodies = found.where("owner is not null")
    rows = found.select("kind", "path", "content", F.expr("cast(null as array<struct<path: string, cx: int, cz: int, content: binary>>)").alias("beside"))
    if not bodies.isEmpty():
        beside = bodies.groupBy(F.col("owner").alias("path")).agg(F.collect_list(F.struct("path", cx.alias("cx"), cz.alias("cz"), "content")).alias("beside"))  # of one region's 1,024 chunks at most
        regions = found.where("kind = 'region'")
        alone = bodies.join(regions.select(F.col("path").alias("owner")), "owner", "left_anti")
        rows = regions.select("kind", "path", "content").join(beside, "path", "left").select("kind", "path", "content", "beside").unionByName(
            found.where("kind <> 'region' and owner is null").unionByName(alone.select(found.columns)).select("kind", "path", "content").withColumn("beside", F.lit(None))
        )
    return rows


def _digest(kind: str, body: bytes) -> str:
    return f"{kind}:{hashlib.sha256(body).hexdigest()}"


def _chunks(row: dict) -> tuple[list[tuple[str, int, bytes]], set[tuple[int, int]]]:
    """Position, compression and payload of a region's chunks, and which of these lie beside it."""
    chunks = region.parse(row["path"], row["content"])
    bodies = {(x["cx"], x["cz"]): x["content"] for x in row["beside"] or []}
    payload = [bodies.get((c.x, c.z)) if c.external else c.payload for c in chunks]
    if not chunks or not all(payload):
        raise region.BadRegion("no chunks, or bodies that are missing")
    return [(f"{c.x},{c.z}", c.compression, p) for c, p in zip(chunks, payload, strict=True)], {(c.x, c.z) for c in chunks if c.external}


def _keys(row: dict) -> Iterator[dict]:
    """``path, key`` of everything in a file that would be decoded or stored; nothing is decoded for it."""
    keys = {_digest(k, row["content"] or b"") for k in (row["kind"], "blob")} | {_digest("blob", x["content"]) for x in row["beside"] or []}
    if row["kind"] == "region":
        try:
            keys |= {_digest(str(scheme), body) for _, scheme, body in _chunks(row)[0]}
        except ValueError:
            pass  # a blob as a whole
    yield from ({"path": row["path"], "key": k} for k in keys)


def _parts(row: dict) -> Iterator[dict]:
    """The entries of a file (ENTRY and ``key, id``); those whose key is in ``known`` have its id and no body."""
    known = {x["key"]: x["id"] for x in row.get("known") or []}
    base = {"kind": row["kind"], "path": row["path"], "pos": ""}

    def part(sort: str, body: bytes, decode: Callable[[bytes], bytes], **own: str) -> dict:
        key = _digest(sort, body)
        if key in known:
            return base | own | {"key": key, "id": known[key], "body": None}
        made = decode(body)
        return base | own | {"key": key, "id": nbt.object_id(made), "body": made}

    plain = lambda body: body
    blobs = [part("blob", x["content"], plain, kind="blob", path=x["path"]) for x in row["beside"] or []]
    try:
        if row["kind"] == "region":
            chunks, taken = _chunks(row)
            parts = [part(str(scheme), body, lambda b, s=scheme: nbt.canonical(nbt.read(region.inflate(s, b))[1]), pos=pos) for pos, scheme, body in chunks]
            parts += [b for b, x in zip(blobs, row["beside"] or [], strict=True) if (x["cx"], x["cz"]) not in taken]
        elif row["kind"] == "nbt":
            parts = [part("nbt", row["content"], lambda b: nbt.canonical(nbt.read(region.unpack_file(b))[1]))]
        else:
            parts = [part(row["kind"], row["content"] or b"", plain)]
    except ValueError:
        parts = [part("blob", row["content"], plain, kind="blob"), *blobs]
    yield from parts


def world_entries(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """A world's files as entries: chunks and trees by canonical bytes, all else as it is, empty folders too.

    Oversized chunk bodies beside a region belong to it. A region without chunks, with a chunk that can't
    be decoded or whose body is missing is a blob as a whole, and so are its bodies, a body that no
    region asks for, and a tree file that can't be read. ``skip`` is a folder that is left out.
    """
    return rows_mapped(_world_rows(spark, root, skip), f"{ENTRY}, key string, id string", _parts).drop("key", "id")


def confined(path: str) -> str:
    """The path if it stays below its root."""
    parts = path.split("/")
    if path.startswith("/") or "\\" in path or "\0" in path or ".." in parts or "" in parts:
        raise RepoError(f"{path!r} leaves its folder")
    return path


def world_files(entries: DataFrame) -> DataFrame:
    """``path, content``: the files that entries make, regions and trees compressed, oversized bodies beside them; folders have null content."""
    whole = entries.where("kind <> 'region'").select("kind", "path", "body")

    def plain(row: dict) -> Iterator[dict]:
        body = row["body"]
        content = {"nbt": lambda: region.deflate(region.GZIP, body), "dir": lambda: None}.get(row["kind"], lambda: body)()
        yield {"path": confined(row["path"]), "content": content}

    def build(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        rows = table.to_pylist()
        path = confined(rows[0]["path"])
        chunks = [region.Chunk(*map(int, r["pos"].split(",")), region.ZLIB, region.deflate(region.ZLIB, r["body"]), False, 0) for r in rows]
        data, outside = region.build(chunks)
        folder = path.rpartition("/")[0]
        out = [{"path": path, "content": data}, *({"path": f"{folder}/{n}" if folder else n, "content": b} for n, b in outside.items())]
        return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    regions = entries.where("kind = 'region'").groupBy("path").applyInArrow(build, "path string, content binary")
    return rows_mapped(whole, "path string, content binary", plain).unionByName(regions)


def write_files(out_files: DataFrame, root: str) -> int:
    """Write ``path, content`` rows below ``root``, a folder that all executors mount; the number of files."""

    def work(row: dict) -> Iterator[dict]:
        from pathlib import Path

        target = Path(root.removeprefix("file:")) / confined(row["path"])
        if row["content"] is None:
            target.mkdir(parents=True, exist_ok=True)
            return
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        part.write_bytes(row["content"])
        part.replace(target)
        yield {"path": row["path"]}

    return rows_mapped(out_files, "path string", work).count()


def _named(entries: DataFrame) -> DataFrame:
    """Entries with the ids of their bodies, which they may have already."""
    return entries if "id" in entries.columns else entries.withColumn("id", content_id(F.col("body")))


# The repository -----------------------------------------------------------------------------------------


class Repo:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if not storage.exists(spark, f"{self.root}/meta"):
            raise RepoError(f"{root} holds no repository")

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Repo:
        root = root.rstrip("/")
        if storage.exists(spark, f"{root}/meta"):
            raise RepoError("there is a repository already")
        for name, ddl in (("objects", OBJECT), ("trees", TREE), ("commits", COMMIT), ("cache", CACHE)):
            spark.createDataFrame([], ddl).write.parquet(f"{root}/{name}")
        meta = {"head": "main", "branches": {}, "tags": {}, "remotes": {}, "config": {}, "reflog": [], "stash": [], "bisect": None, "shallow": [], "promisor": None, "objects": "objects", "tag_objects": {}}
        storage.write_next(spark, f"{root}/meta", 0, meta)
        return cls(spark, root)

    # Tables and marks

    def table(self, name: str) -> DataFrame:
        ddl = {"objects": OBJECT, "trees": TREE, "commits": COMMIT, "cache": CACHE}[name]
        return self.spark.read.schema(ddl).parquet(self._path(name))

    def world(self, root: str) -> DataFrame:
        """A world's entries (ENTRY and ``key, id``), of which only those that are new here have bodies.

        Payloads are looked up by their hash in the cache that commits fill, so that only chunks and
        trees that no earlier commit had are decoded; this repository's own folder is left out.
        """
        rows = _world_rows(self.spark, root, self.root)
        cache = self.table("cache").join(self.table("objects").select("id"), "id", "left_semi").dropDuplicates(["key"])
        if cache.isEmpty():
            return rows_mapped(rows, f"{ENTRY}, key string, id string", _parts)
        hits = rows_mapped(rows, "path string, key string", _keys).join(cache, "key")
        known = materialise(hits.groupBy("path").agg(F.collect_set(F.struct("key", "id")).alias("known")))  # of one file's chunks, 1,024 at most
        return rows_mapped(rows.join(known, "path", "left"), f"{ENTRY}, key string, id string", _parts)

    def _path(self, name: str) -> str:
        """The folder of a table; a collection of garbage names another one for the objects."""
        return f"{self.root}/{self.meta['objects'] if name == 'objects' else name}"

    @property
    def meta(self) -> dict:
        at, found = storage.read_latest(self.spark, f"{self.root}/meta")
        return found | {"at": at}

    def _save(self, meta: dict) -> None:
        """Write the marks; refused if they are not those that ``meta`` was read from any more."""
        try:
            meta["at"] = storage.write_next(self.spark, f"{self.root}/meta", meta["at"], {k: v for k, v in meta.items() if k != "at"})
        except storage.Conflict as e:
            raise RepoError("the repository has changed meanwhile; nothing was moved") from e

    def edges(self) -> DataFrame:
        """``child, parent, ord``; commits at a shallow boundary have no parents."""
        rows = self.table("commits").select(F.col("id").alias("child"), F.posexplode("parents").alias("ord", "parent"))
        cut = self.meta["shallow"]
        return rows.where(~F.col("child").isin(cut)) if cut else rows

    def head(self) -> str | None:
        m = self.meta
        return m["branches"].get(m["head"]) if not m["head"].startswith("@") else m["head"][1:]

    def _move(self, to: str, message: str, ref: str | None = None, seen: dict | None = None) -> None:
        """Point the head or a branch at a commit; with ``seen`` only if nothing has changed since these marks."""
        m = seen or self.meta
        name = ref or m["head"]
        old = m["branches"].get(name)
        if name.startswith("@"):
            old, m["head"] = name[1:], f"@{to}"
        else:
            m["branches"][name] = to
        m["reflog"].append({"ref": name, "from": old, "to": to, "message": message})
        self._save(m)

    # Commits

    def _put(self, entries: DataFrame) -> str:
        """Store bodies that are new and the tree, if new; the tree's id."""
        named = materialise(_named(entries))
        bodies = named.where("body is not null").select("id", "body")
        new = bodies.dropDuplicates(["id"]).join(self.table("objects").select("id"), "id", "left_anti")
        new.select("id", "body", F.octet_length("body").cast("bigint").alias("raw_len")).write.mode("append").parquet(self._path("objects"))
        if "key" in named.columns:
            keys = named.where("body is not null").select("key", "id").distinct()
            keys.write.mode("append").parquet(f"{self.root}/cache")
        return self._put_tree(named)

    def _put_tree(self, named: DataFrame) -> str:
        """Store a tree of known ids, if new."""
        tree = self.tree_id(named)
        if self.table("trees").where(F.col("tree") == tree).isEmpty():
            named.select(F.lit(tree).alias("tree"), *KEY, "id").write.mode("append").parquet(f"{self.root}/trees")
        return tree

    def _bodies(self, tree: DataFrame) -> DataFrame:
        """Entries with bodies; those that a partial clone lacks are fetched, one that is nowhere is an error."""
        if self.meta["promisor"]:
            self._fetch(tree)
        lost = F.raise_error(F.concat(F.lit("no object "), "id", F.lit(" of "), "path"))
        rows = tree.join(self.table("objects").dropDuplicates(["id"]).select("id", "body", F.lit(True).alias("there")), "id", "left")
        return rows.select(*KEY, F.when(F.col("there").isNull(), lost).otherwise(F.col("body")).alias("body"))

    def _fetch(self, tree: DataFrame) -> int:
        """Copy the tree's bodies that are not here from where this clone was made; the number of them."""
        wanted = materialise(tree.select("id").distinct().join(self.table("objects").select("id"), "id", "left_anti"))
        if wanted.isEmpty():
            return 0
        bodies = materialise(Repo(self.spark, self.meta["promisor"]).table("objects").join(wanted, "id", "left_semi"))
        bodies.write.mode("append").parquet(self._path("objects"))
        return bodies.count()

    @staticmethod
    def tree_id(named: DataFrame) -> str:
        """Hash of the files' hashes; a file's is that of its positions and ids, by buckets of the position."""
        per_file = merkle(named, ["kind", "path"], "pos", "id").select(F.concat_ws("|", "path", "kind").alias("k"), F.col("sig").alias("s"))
        top = merkle(per_file, [], "k", "s").first()
        return top["sig"] if top["sig"] else hashlib.sha256(b"").hexdigest()

    def _commit(self, tree: str, parents: list[str], message: str, author: str, when: int | None) -> str:
        body = {"tree": tree, "parents": parents, "message": message, "author": author, "time": int(time.time()) if when is None else when}
        cid = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        row = (cid, tree, parents, message, author, body["time"])
        if self.table("commits").where(F.col("id") == cid).isEmpty():
            self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return cid

    def commit(self, entries: DataFrame, message: str, author: str = "", when: int | None = None, before=None, after=None) -> str | None:  # noqa: ANN001
        """Snapshot and commit on the current branch; null if the tree is that of the head already.

        ``before(entries)`` may refuse by raising; ``after(commit)`` is told.
        """
        if before:
            before(entries)
        seen = self.meta
        tree = self._put(entries)
        parent = self.head()
        if parent and self.commit_of(parent)["tree"] == tree:
            return None
        cid = self._commit(tree, [parent] if parent else [], message, author, when)
        self._move(cid, f"commit: {message}", seen=seen)
        if after:
            after(cid)
        return cid

    def commit_of(self, cid: str) -> dict:
        row = self.table("commits").where(F.col("id") == cid).first()
        if row is None:
            raise RepoError(f"no commit {cid}")
        return row.asDict()

    def resolve(self, spec: str) -> str:
        """HEAD, a branch, tag, ``@{n}``, or at least four hex digits, then ``~n`` and ``^n``."""
        m = re.fullmatch(r"(.*?)((?:~\d*|\^\d*)*)", spec, re.DOTALL)
        name, steps = m[1], re.findall(r"([~^])(\d*)", m[2])
        meta = self.meta
        if name in ("", "HEAD"):
            cid = self.head()
        elif at := re.fullmatch(r"(.*)@\{(\d+)\}", name):
            ref = at[1] or meta["head"]
            log = [e for e in meta["reflog"] if e["ref"] == ref][::-1]
            cid = log[int(at[2])]["to"] if int(at[2]) < len(log) else None
        else:
            cid = meta["branches"].get(name) or self._peeled(meta, (meta["tags"].get(name) or {}).get("target"))
            if cid is None and re.fullmatch(r"[0-9a-f]{4,64}", name):
                hits = [r["id"] for r in self.table("commits").where(F.col("id").startswith(name)).select("id").limit(2).collect()]
                cid = hits[0] if len(hits) == 1 else None
        if cid is None:
            raise RepoError(f"{spec!r} names no commit")
        for sign, n in steps:
            if sign == "~" and int(n or 1) > 2:
                chain = dag.first_parents(self.spark.createDataFrame([(cid,)], "start string"), self.edges(), int(n))
                at = chain.where(F.col("step") == int(n)).first()
                if at is None:
                    raise RepoError(f"{spec!r} goes beyond the root")
                cid = at["node"]
                continue
            for _ in range(int(n or 1) if sign == "~" else 1):
                parents = self.commit_of(cid)["parents"]
                k = 0 if sign == "~" else int(n or 1) - 1
                if k >= len(parents):
                    raise RepoError(f"{spec!r} goes beyond the root")
                cid = parents[k]
        return cid

    @staticmethod
    def _peeled(meta: dict, target: str | None) -> str | None:
        """The commit that a tag names, through tags of tags."""
        while target in meta["tag_objects"]:
            target = meta["tag_objects"][target]["object"]
        return target

    def tree_of(self, rev: str = "HEAD") -> DataFrame:
        """``kind, path, pos, id`` of a commit."""
        return self.table("trees").where(F.col("tree") == self.commit_of(self.resolve(rev))["tree"]).select(*KEY, "id")

    def checkout(self, rev: str = "HEAD", regions: list[tuple[int, int]] | None = None, paths: list[str] | None = None) -> DataFrame:
        """Entries with bodies, of chosen regions or paths only where these are given."""
        tree = self.tree_of(rev)
        if regions is not None:
            rx, rz = coords.region_from_name(F.col("path"))
            keep = [f"{x},{z}" for x, z in regions]
            tree = tree.where((F.col("kind") != "region") | F.concat_ws(",", rx, rz).isin(keep))
        if paths is not None:
            tree = tree.where(F.col("path").isin(paths))
        return self._bodies(tree)

    def switch(self, branch: str) -> str:
        m = self.meta
        m["head"] = branch if branch in m["branches"] else f"@{self.resolve(branch)}"
        self._save(m)
        return m["head"]

    def log(self, rev: str = "HEAD", author: str | None = None, grep: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """The chain of first parents, latest first, and what passes the filters of it."""
        start = self.spark.createDataFrame([(self.resolve(rev),)], "start string")
        chain = dag.first_parents(start, self.edges()).withColumnRenamed("node", "id")
        rows = chain.join(self.table("commits"), "id")
        for ok in (author is None or F.col("author").contains(author), grep is None or F.col("message").contains(grep), since is None or F.col("time") >= since, until is None or F.col("time") <= until):
            rows = rows.where(ok) if ok is not True else rows
        return rows.orderBy("step")

    # Comparison

    def diff(self, a: str, b: str) -> DataFrame:
        return self._changes(self.tree_of(a), self.tree_of(b))

    @staticmethod
    def _changes(a: DataFrame, b: DataFrame) -> DataFrame:
        """``kind, path, pos, code, old_id, new_id``: A, D or M."""
        rows = a.withColumnRenamed("id", "old_id").join(b.withColumnRenamed("id", "new_id"), KEY, "full").where("not (old_id <=> new_id)")
        return rows.select(*KEY, F.when(F.col("old_id").isNull(), "A").when(F.col("new_id").isNull(), "D").otherwise("M").alias("code"), "old_id", "new_id")

    def status(self, entries: DataFrame, rev: str = "HEAD") -> DataFrame:
        """``path, code`` of files that differ from a commit; nothing is written."""
        here = _named(entries).select(*KEY, "id")
        old = self.tree_of(rev) if self.head() or rev != "HEAD" else here.limit(0)
        sides = old.withColumn("side", F.lit(0)).unionByName(here.withColumn("side", F.lit(1)))
        changed = sides.groupBy(*KEY).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.min("side").alias("s"), F.max("side").alias("t"))
        marks = changed.groupBy("path").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.max(((F.col("n") != 2) | (F.col("a") != F.col("b"))).cast("int")).alias("changed"))
        code = F.when(F.col("s") == 1, "A").when(F.col("t") == 0, "D").when(F.col("changed") == 1, "M")
        return marks.select("path", code.alias("code")).where("code is not null")

    def verify(self, rev: str, entries: DataFrame) -> bool:
        """Whether entries have exactly a commit's tree."""
        return self.tree_id(_named(entries).select(*KEY, "id")) == self.commit_of(self.resolve(rev))["tree"]

    def clean(self, entries: DataFrame, rev: str = "HEAD") -> DataFrame:
        """Paths that a commit does not know."""
        return entries.select("path").distinct().join(self.tree_of(rev).select("path"), "path", "left_anti")

    # History

    def merge_base(self, a: str, b: str) -> str | None:
        starts = self.spark.createDataFrame([(self.resolve(x),) for x in (a, b)], "start string")
        if starts.distinct().count() == 1:
            return self.resolve(a)
        return dag.merge_base(starts, self.edges().select("child", "parent")).first()["merge_base"]

    def _tree_or_none(self, rev: str | None) -> DataFrame:
        return self.tree_of(rev) if rev else self.table("trees").limit(0).select(*KEY, "id")

    def _three(self, base: str | None, ours: str, theirs: str | None, parents: list[str], message: str, author: str, when: int | None) -> dict:
        merged, bad = merge.merge(self._tree_or_none(base), self.tree_of(ours), self._tree_or_none(theirs), KEY, "id")
        conflicts = [r["path"] for r in bad.select("path").distinct().orderBy("path").collect()]
        if conflicts:
            return {"outcome": "conflicts", "paths": conflicts}
        cid = self._commit(self._put_tree(materialise(merged.select(*KEY, "id"))), parents, message, author, when)  # all bodies are those of a side
        self._move(cid, message)
        return {"outcome": "merged", "commit": cid}

    def merge(self, other: str, author: str = "", when: int | None = None) -> dict:
        """up_to_date, fast_forward, merged, or conflicts, which change nothing."""
        ours, theirs = self.resolve("HEAD"), self.resolve(other)
        base = self.merge_base(ours, theirs)
        if base == theirs:
            return {"outcome": "up_to_date"}
        if base == ours:
            self._move(theirs, f"merge {other}: fast-forward")
            return {"outcome": "fast_forward", "commit": theirs}
        return self._three(base, ours, theirs, [ours, theirs], f"merge {other}", author, when)

    def cherry_pick(self, rev: str, author: str = "", when: int | None = None) -> dict:
        c = self.commit_of(self.resolve(rev))
        head = self.resolve("HEAD")
        return self._three(c["parents"][0] if c["parents"] else None, head, c["id"], [head], c["message"], author, when)

    def revert(self, rev: str, author: str = "", when: int | None = None) -> dict:
        c = self.commit_of(self.resolve(rev))
        head = self.resolve("HEAD")
        return self._three(c["id"], head, c["parents"][0] if c["parents"] else None, [head], f"revert {c['message']}", author, when)

    def rebase(self, onto: str) -> dict:
        """The head's own commits again on top of another; stops at the first that conflicts, the head as it was."""
        start, target = self.resolve("HEAD"), self.resolve(onto)
        base = self.merge_base(start, target)
        own = []
        at: str | None = start
        while at and at != base:
            own.append(at)
            at = next(iter(self.commit_of(at)["parents"]), None)
        self._move(target, f"rebase onto {onto}")
        for cid in reversed(own):
            done = self.cherry_pick(cid, when=self.commit_of(cid)["time"])
            if done["outcome"] != "merged":
                self._move(start, "rebase: stopped")
                return done
        return {"outcome": "rebased", "commit": self.head(), "n": len(own)}

    def reset(self, rev: str) -> str:
        cid = self.resolve(rev)
        self._move(cid, f"reset to {rev}")
        return cid

    # Names

    def branch(self, name: str, rev: str = "HEAD", delete: bool = False) -> None:
        if not _REF.fullmatch(name):
            raise RepoError(f"{name!r} is no name")
        target = None if delete else self.resolve(rev)
        m = self.meta
        if delete:
            if name == m["head"] or m["branches"].pop(name, None) is None:
                raise RepoError(f"{name!r} can't be deleted")
        else:
            m["branches"][name] = target
        self._save(m)

    def tag(self, name: str, rev: str = "HEAD", message: str | None = None, delete: bool = False, force: bool = False, author: str = "", when: int | None = None) -> str | None:
        """Name a commit; with a message by a tag object of its own, which may stand for another tag. The target's id."""
        if not _REF.fullmatch(name):
            raise RepoError(f"{name!r} is no name")
        m = self.meta
        if delete:
            if m["tags"].pop(name, None) is None:
                raise RepoError(f"no tag {name!r}")
            self._save(m)
            return None
        if name in m["tags"] and not force:
            raise RepoError(f"there is a tag {name!r}")
        target = self.resolve(rev)
        if message is not None:
            inner = m["tags"].get(rev, {}).get("target")
            made = {"object": inner if inner in m["tag_objects"] else target, "name": name, "message": message, "author": author, "time": int(time.time()) if when is None else when}
            target = hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()
            m["tag_objects"][target] = made
        m["tags"][name] = {"target": target, "message": message}
        self._save(m)
        return target

    def reflog(self, ref: str | None = None) -> list[dict]:
        m = self.meta
        return [e for e in m["reflog"] if e["ref"] == (ref or m["head"])][::-1]

    def config(self, key: str, value: str | None = None, unset: bool = False) -> str | None:
        m = self.meta
        if unset:
            m["config"].pop(key, None)
        elif value is not None:
            m["config"][key] = value
        else:
            return m["config"].get(key)
        self._save(m)
        return value

    def stash_push(self, entries: DataFrame, message: str = "") -> str:
        tree = self._put(entries)
        head = self.head()
        cid = self._commit(tree, [head] if head else [], f"stash: {message}", "", None)
        m = self.meta
        m["stash"].append(cid)
        self._save(m)
        return cid

    def stash_pop(self, drop_only: bool = False) -> DataFrame | None:
        """The entries stashed last, which leave the stack."""
        m = self.meta
        if not m["stash"]:
            raise RepoError("the stash is empty")
        cid = m["stash"].pop()
        self._save(m)
        return None if drop_only else self.checkout(cid)

    # Bisection

    def bisect(self, bad: str | None = None, good: str | None = None, skip: str | None = None, reset: bool = False) -> dict:
        """Record marks and tell the next commit to test; needs a bad and a good mark."""
        m = self.meta
        if reset:
            m["bisect"] = None
            self._save(m)
            return {"state": "reset"}
        b = m["bisect"] or {"bad": None, "good": [], "skip": []}
        if bad:
            b["bad"] = self.resolve(bad)
        if good:
            b["good"].append(self.resolve(good))
        if skip:
            b["skip"].append(self.resolve(skip))
        m["bisect"] = b
        self._save(m)
        if not b["bad"] or not b["good"]:
            return {"state": "need_marks"}
        frame = lambda ids, name: self.spark.createDataFrame([(i,) for i in ids], f"{name} string")
        return dag.bisect_step(frame([b["bad"]], "start"), frame(b["good"], "start"), frame(b["skip"], "node"), self.edges().select("child", "parent")).first().asDict()

    # Audits

    def tips(self) -> list[str]:
        """HEAD, branches, tags, the stash and what reflogs name, so that a collection spares them."""
        m = self.meta
        named = {self.head(), *m["branches"].values(), *(self._peeled(m, t["target"]) for t in m["tags"].values()), *m["stash"], *(e["to"] for e in m["reflog"])}
        return sorted(x for x in named if x)

    def reachable(self, tips: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Commits and object ids that tips reach."""
        starts = self.spark.createDataFrame([(t,) for t in (self.tips() if tips is None else tips)], "start string")
        walk = dag.ancestors(starts, self.edges().select("child", "parent")).select(F.col("node").alias("id")).distinct()
        commits = materialise(walk.join(self.table("commits"), "id", "left").select("id", "tree"))
        ids = self.table("trees").join(commits.select("tree").distinct(), "tree", "left_semi").select("id").distinct()
        return commits, ids

    def fsck(self) -> dict:
        """Counts of checked, corrupt, missing, promised and unreachable objects, and of missing commits."""
        commits, ids = self.reachable()
        store = self.table("objects").select("id", (content_id(F.col("body")) != F.col("id")).alias("bad")).withColumn("s", F.lit(1))
        rows = store.join(ids.withColumn("r", F.lit(1)), "id", "full")
        count = lambda c: F.count(F.when(c, 1))
        found = rows.agg(count(F.col("s") == 1).alias("checked"), count(F.col("bad")).alias("corrupt"), count(F.col("s").isNull()).alias("missing"), count(F.col("r").isNull()).alias("unreachable")).first().asDict()
        promised = found["missing"] if self.meta["promisor"] else 0
        return found | {"promised": promised, "missing": found["missing"] - promised, "missing_commits": commits.where("tree is null").count()}

    def gc(self) -> dict:
        """Rewrite the objects that are reachable into few files and drop the others."""
        _, ids = self.reachable()
        store = self.table("objects")
        kept = store.join(ids, "id", "left_semi")
        m = self.meta
        old, new = m["objects"], f"objects-{uuid.uuid4().hex}"
        before = store.count()
        kept.write.parquet(f"{self.root}/{new}")
        n = self.spark.read.schema(OBJECT).parquet(f"{self.root}/{new}").count()
        m["objects"] = new
        self._save(m)  # from here on the new table counts; the old one goes after
        storage.delete(self.spark, f"{self.root}/{old}")
        return {"kept": n, "pruned": before - n}

    # Transfer

    def _copy(self, other: Repo, tip: str, objects: bool = True, cut: list[str] = ()) -> int:  # type: ignore[assignment]
        """Copy into this repository what ``other``'s tip reaches and this one lacks; the number of objects."""
        commits, ids = other.reachable([tip])
        lacks = commits.select("id").join(self.table("commits").select("id"), "id", "left_anti")
        new = other.table("commits").join(lacks, "id", "left_semi")
        trees = other.table("trees").join(commits.select("tree").distinct(), "tree", "left_semi").join(self.table("trees").select("tree").distinct(), "tree", "left_anti")
        moved = 0
        if objects:
            bodies = materialise(other.table("objects").join(ids, "id", "left_semi").join(self.table("objects").select("id"), "id", "left_anti"))
            if not bodies.where(content_id(F.col("body")) != F.col("id")).isEmpty():
                raise RepoError("an object is not what its id says")
            moved = bodies.count()
            bodies.write.mode("append").parquet(self._path("objects"))
        materialise(trees).write.mode("append").parquet(f"{self.root}/trees")
        materialise(new).write.mode("append").parquet(f"{self.root}/commits")
        return moved

    @classmethod
    def clone(cls, source: Repo, root: str, depth: int | None = None, partial: bool = False) -> Repo:
        """A copy of all branches; with ``depth`` the history is cut, with ``partial`` bodies come on demand."""
        new = cls.init(source.spark, root)
        theirs = source.meta
        for name, tip in theirs["branches"].items():
            if depth is None:
                new._copy(source, tip, not partial)
            else:
                starts = source.spark.createDataFrame([(tip,)], "start string")
                near = materialise(dag.ancestors(starts, source.edges().select("child", "parent"), depth - 1))
                ids = near.select(F.col("node").alias("id")).distinct()
                commits = materialise(source.table("commits").join(ids, "id", "left_semi").join(new.table("commits").select("id"), "id", "left_anti"))
                trees = materialise(source.table("trees").join(commits.select("tree").distinct(), "tree", "left_semi"))
                commits.write.mode("append").parquet(f"{root}/commits")
                trees.write.mode("append").parquet(f"{root}/trees")
                if not partial:
                    source.table("objects").join(trees.select("id").distinct(), "id", "left_semi").join(new.table("objects").select("id"), "id", "left_anti").write.mode("append").parquet(new._path("objects"))
                edge = dag.shallow_boundary(starts, source.edges().select("child", "parent"), depth - 1)
                m = new.meta
                m["shallow"] = sorted({*m["shallow"], *(r["node"] for r in edge.collect())})
                new._save(m)
            m = new.meta
            m["branches"][name] = tip
            new._save(m)
        m = new.meta
        m |= {"head": theirs["head"], "tags": theirs["tags"] if depth is None else {}, "tag_objects": theirs["tag_objects"] if depth is None else {}, "remotes": {"origin": source.root}, "promisor": source.root if partial else None}
        new._save(m)
        return new

    def backfill(self, rev: str = "HEAD") -> int:
        """Fetch the bodies of a commit that a partial clone lacks."""
        return self._fetch(self.tree_of(rev))

    def fetch(self, source: Repo, branch: str) -> int:
        tip = source.meta["branches"][branch]
        n = self._copy(source, tip)
        m = self.meta
        m["branches"][f"origin/{branch}"] = tip
        self._save(m)
        return n

    def pull(self, source: Repo, branch: str) -> dict:
        self.fetch(source, branch)
        return self.merge(f"origin/{branch}")

    def push(self, target: Repo, branch: str, force: bool = False) -> int:
        """Copy a branch over; refused where the other side's tip is no ancestor, unless forced."""
        tip = self.resolve(branch)
        theirs = target.meta["branches"].get(branch)
        if theirs and not force:
            starts = self.spark.createDataFrame([(tip,)], "start string")
            if dag.ancestors(starts, self.edges().select("child", "parent")).where(F.col("node") == theirs).isEmpty():
                raise RepoError("the other side has commits of its own")
        n = target._copy(self, tip)
        target._move(tip, "push", branch)
        return n

    def verify_remote(self, deep: bool = False) -> dict:
        """Branches, commits and objects they reach, what is missing, and with ``deep`` what is damaged."""
        m = self.meta
        commits, ids = self.reachable(sorted(m["branches"].values()))
        held = self.table("objects")
        missing = ids.join(held.select("id"), "id", "left_anti").count()
        corrupt = held.join(ids, "id", "left_semi").where(content_id(F.col("body")) != F.col("id")).count() if deep else 0
        return {"branches": len(m["branches"]), "commits": commits.count(), "objects": ids.count(), "missing": missing, "corrupt": corrupt}
