"""``python -m chunklake.cli``: repositories of worlds, and queries on worlds, from the shell.

Exit codes: 0 done, 1 differences, conflicts or nothing found, 2 an error.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import worlds
from .repo import Repo, RepoError, world_entries, world_files, write_files
from .sources import png, world


def show(df: DataFrame, limit: int | None = None) -> int:
    """Rows as JSON lines, as many as asked for; 0 if there were any."""
    n = 0
    for row in (df.limit(limit) if limit else df).toJSON().toLocalIterator():
        print(row)
        n += 1
    return 0 if n else 1


def _point(text: str) -> tuple[int, int]:
    x, z = text.split(",")
    return int(x), int(z)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunklake")
    p.add_argument("-C", "--repo", default=".chunklake")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags: dict) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("?*"), **({"nargs": a[-1]} if a[-1] in "?*" else {}))
        for f, kw in flags.items():
            c.add_argument(f"--{f.replace('_', '-')}", **kw)

    yes, text, number = {"action": "store_true"}, {}, {"type": int}
    add("init")
    add("commit", "world", message={"required": True}, author={"default": ""})
    add("checkout", "rev", "out", force=yes, prune=yes, region={"action": "append", "type": _point})
    add("restore", "rev", "out", "paths*")
    add("status", "world", rev={"default": "HEAD"})
    add("verify", "rev", "world")
    add("clean", "world", force=yes)
    add("log", "rev?", oneline=yes, author=text, grep=text, since=number, until=number)
    add("diff", "old", "new", json=yes)
    add("extract", "old", "new", "patch")
    add("apply", "patch", "world", "out", reverse=yes, force=yes)
    for name in ("merge", "revert", "cherry-pick", "rebase", "switch", "rev-parse", "show", "ls-tree"):
        add(name, "rev")
    add("reset", "rev", "world?", hard=yes)
    add("branch", "name?", "rev?", delete=yes)
    add("tag", "name?", "rev?", message=text, delete=yes, force=yes)
    add("cat-file", "id")
    add("stash", "action", "world?")
    add("reflog", "ref?")
    add("bisect", "action", "rev?")
    add("fsck")
    add("gc")
    add("config", "key", "value?", unset=yes)
    add("remote", "action", "name?", "url?")
    add("clone", "source", depth=number, filter=yes)
    for name in ("push", "pull", "fetch"):
        add(name, "remote", "branch", force=yes)
    add("backfill", "rev?")
    add("ls-remote", "remote")
    add("verify-remote", "remote?", deep=yes)
    add("players", "world")
    add("find", "kind", "world", "id?", dim=text)
    add("inspect", "world", "x", "y", "z", dim=text)
    add("where-changed", "old", "new", dim=text, verbose=yes)
    add("region", "world", dim=text)
    add("poi", "world", dim=text)
    add("render", "world", "out", dim=text, max_chunks={"type": int, "default": png.MOST_CHUNKS})
    return p


def _decoded(spark: SparkSession, root: str, dim: str | None) -> DataFrame:
    return world.chunks(world.raw_chunks(spark, root, dimension=dim or "overworld"))


def _world_diff(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both worlds' entries and what changes between them."""
    sides = [world_entries(spark, r) for r in (old, new)]
    return *sides, worlds.entry_changes(*sides)


def world_queries(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Commands that need no repository; null if it is none of them."""
    if a.command == "players":
        return show(world.players(spark, a.world))
    if a.command == "find":
        d = _decoded(spark, a.world, a.dim)
        found = {"entity": worlds.find_entities, "block-entity": worlds.find_block_entities, "sign": lambda d, _: worlds.find_signs(d)}
        return show(found[a.kind](d, a.id))
    if a.command == "inspect":
        x, y, z = int(a.x), int(a.y), int(a.z)
        raw = world.raw_chunks(spark, a.world, ("region",), a.dim or "overworld", regions=[(x >> 9, z >> 9)])
        return show(worlds.inspect_raw(raw, spark.createDataFrame([(x, y, z)], "x int, y int, z int")))
    if a.command == "where-changed":
        raw = [world.raw_chunks(spark, r, ("region",), a.dim or "overworld") for r in (a.old, a.new)]
        rows = worlds.where_changed(*raw).orderBy("x", "y", "z")
        return 1 - show(rows, None if a.verbose else 20)
    if a.command == "region":
        return show(worlds.region_info(world.raw_chunks(spark, a.world, dimension=a.dim or "overworld")).orderBy("x", "z"))
    if a.command == "poi":
        return show(worlds.points_of_interest(_decoded(spark, a.world, a.dim)))
    if a.command == "render":
        top = worlds.surface(_decoded(spark, a.world, a.dim), most_y=worlds.CEILING.get(a.dim, 319))
        image, info = png.render(worlds.pixels(top), a.max_chunks)
        Path(a.out).write_bytes(image)
        print(json.dumps(info))
        return 0
    if a.command == "diff" and Path(a.old).is_dir() and Path(a.new).is_dir():
        old, new, changes = _world_diff(spark, a.old, a.new)
        if a.json:
            return 1 - show(changes.orderBy("file", "pos", "path"))
        edits = worlds.block_edits(*(world.raw_chunks(spark, r, ("region",)) for r in (a.old, a.new)))
        lines = [r["line"] for r in worlds.diff_lines(old, new, changes, edits).toLocalIterator()]
        print("\n".join(lines) if lines else "No differences.")
        return int(bool(lines))
    if a.command == "extract":
        _world_diff(spark, a.old, a.new)[2].write.mode("overwrite").json(a.patch)
        return 0
    if a.command == "apply":
        ops = spark.read.schema(worlds.ENTRY_CHANGES).json(a.patch)
        done = worlds.apply_entries(world_entries(spark, a.world), worlds.reverse_patch(ops) if a.reverse else ops, a.force)
        write_files(world_files(done.where("body is not null").select("kind", "path", "pos", "body")), a.out)
        bad = done.where(F.size("conflicts") > 0)
        return 1 - show(bad.select("path", "pos", "conflicts"))
    return None


def _write(repo: Repo, entries: DataFrame, out: str, prune: bool = False) -> int:
    made = world_files(entries)
    n = write_files(made, out)
    if prune:
        keep = {r["path"] for r in made.select("path").toLocalIterator()}
        own = Path(repo.root.removeprefix("file:")).resolve()  # a repository may lie inside the world
        for f in [f for f in Path(out).rglob("*") if f.is_file() and str(f.relative_to(out)) not in keep and own not in f.resolve().parents]:
            f.unlink()
    print(json.dumps({"files": n}))
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    done = world_queries(spark, a)
    if done is not None:
        return done
    if a.command == "init":
        Repo.init(spark, a.repo)
        return 0
    if a.command == "clone":
        Repo.clone(Repo(spark, a.source), a.repo, a.depth, a.filter)
        return 0
    repo = Repo(spark, a.repo)
    tell = lambda x: print(json.dumps(x, default=str)) or 0
    outcome = lambda x: tell(x) or (0 if x["outcome"] != "conflicts" else 1)
    here = repo.world
    if a.command == "commit":
        cid = repo.commit(here(a.world), a.message, a.author, int(time.time()))
        return tell({"commit": cid}) or (0 if cid else 1)
    if a.command == "checkout":
        if not a.force and Path(a.out).exists() and any(Path(a.out).iterdir()):
            raise RepoError(f"{a.out} is not empty")
        return _write(repo, repo.checkout(a.rev, a.region), a.out, a.prune)
    if a.command == "restore":
        return _write(repo, repo.checkout(a.rev, paths=a.paths or None), a.out)
    if a.command == "status":
        return 1 - show(repo.status(here(a.world), a.rev).orderBy("path"))
    if a.command == "verify":
        ok = repo.verify(a.rev, here(a.world))
        return tell({"verified": ok}) or (0 if ok else 1)
    if a.command == "clean":
        rows = [r["path"] for r in repo.clean(here(a.world)).collect()]
        for path in rows if a.force else []:
            (Path(a.world) / path).unlink()
        return tell({"removed" if a.force else "would_remove": rows})
    if a.command == "log":
        rows = repo.log(a.rev or "HEAD", a.author, a.grep, a.since, a.until)
        return show(rows.select(F.substring("id", 1, 8).alias("id"), "message") if a.oneline else rows)
    if a.command == "diff":
        return 1 - show(repo.diff(a.old, a.new).orderBy("path", "pos"))
    if a.command in ("merge", "revert", "cherry-pick", "rebase"):
        return outcome(getattr(repo, a.command.replace("-", "_"))(a.rev))
    if a.command == "reset":
        if a.hard and not a.world:
            raise RepoError("a hard reset needs the world's folder")
        tell({"head": repo.reset(a.rev)})
        return _write(repo, repo.checkout(), a.world, prune=True) if a.hard else 0
    if a.command == "switch":
        return tell({"head": repo.switch(a.rev)})
    if a.command == "rev-parse":
        return tell(repo.resolve(a.rev))
    if a.command == "show":
        c = repo.commit_of(repo.resolve(a.rev))
        tell(c)
        if c["parents"]:
            show(repo.diff(c["parents"][0], c["id"]))
        return 0
    if a.command == "ls-tree":
        return show(repo.tree_of(a.rev).groupBy("kind", "path").agg(F.count("*").alias("n")).orderBy("path"))
    if a.command == "branch":
        return (repo.branch(a.name, a.rev or "HEAD", a.delete) or 0) if a.name else tell(repo.meta["branches"])
    if a.command == "tag":
        return (repo.tag(a.name, a.rev or "HEAD", a.message, a.delete, a.force) or 0) if a.name else tell(repo.meta["tags"])
    if a.command == "cat-file":
        return show(repo.table("objects").where(F.col("id").startswith(a.id)).select("id", "raw_len", F.base64("body").alias("body")))
    if a.command == "stash":
        if a.action == "push":
            return tell(repo.stash_push(here(a.world)))
        if a.action == "list":
            return tell(repo.meta["stash"])
        got = repo.stash_pop(drop_only=a.action == "drop")
        return _write(repo, got, a.world) if got is not None else 0
    if a.command == "reflog":
        return tell(repo.reflog(a.ref))
    if a.command == "bisect":
        if a.action == "log":
            return tell(repo.meta["bisect"])
        return tell(repo.bisect(reset=True) if a.action == "reset" else repo.bisect(**({} if a.action == "start" else {a.action: a.rev or "HEAD"})))
    if a.command in ("fsck", "gc"):
        found = getattr(repo, a.command)()
        return tell(found) or int(bool(found.get("missing") or found.get("corrupt")))
    if a.command == "config":
        return tell(repo.config(a.key, a.value, a.unset))
    if a.command == "remote":
        m = repo.meta
        if a.action in ("add", "set-url"):
            m["remotes"][a.name] = a.url
        elif a.action == "remove":
            m["remotes"].pop(a.name)
        elif a.action == "rename":
            m["remotes"][a.url] = m["remotes"].pop(a.name)
        else:
            return tell(m["remotes"].get(a.name, m["remotes"]) if a.name else m["remotes"])
        repo._save(m)  # noqa: SLF001
        return 0
    other = lambda name: Repo(spark, repo.meta["remotes"].get(name, name))
    if a.command == "push":
        return tell({"objects": repo.push(other(a.remote), a.branch, a.force)})
    if a.command == "pull":
        return outcome(repo.pull(other(a.remote), a.branch))
    if a.command == "fetch":
        return tell({"objects": repo.fetch(other(a.remote), a.branch)})
    if a.command == "backfill":
        return tell({"objects": repo.backfill(a.rev or "HEAD")})
    if a.command == "ls-remote":
        m = other(a.remote).meta
        return tell({"branches": m["branches"], "tags": m["tags"]})
    found = (other(a.remote) if a.remote else repo).verify_remote(a.deep)
    return tell(found) or int(bool(found["missing"] or found["corrupt"]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("chunklake").getOrCreate()
    try:
        return run(spark, a)
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
