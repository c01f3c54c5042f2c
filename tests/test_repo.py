import pytest
from pyspark.sql import functions as F

from chunklake.repo import Repo, RepoError, confined, table_entries, world_entries, world_files, write_files
from tests.worlds import make_world


def entries(spark, rows):
    return table_entries(spark.createDataFrame(sorted(rows.items()), "k int, v string"), "t", ["k"])


def values(df):
    return {r["pos"]: bytes(r["body"]).decode() for r in df.collect()}


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    repo = Repo.init(spark, str(tmp_path_factory.mktemp("repo")))
    base = {k: "a" for k in range(20)}
    ids = [repo.commit(entries(spark, base), "first", "ann", 100)]
    ids.append(repo.commit(entries(spark, base | {1: "b"}), "second", "bob", 200))
    ids.append(repo.commit(entries(spark, base | {1: "b", 50: "n"}), "third", "ann", 300))
    return repo, base, ids


def test_commit_log_resolve(spark, history):
    repo, base, ids = history
    assert repo.commit(entries(spark, base | {1: "b", 50: "n"}), "again") is None
    assert [r["message"] for r in repo.log().collect()] == ["third", "second", "first"]
    assert [r["message"] for r in repo.log(author="ann", until=250).collect()] == ["first"]
    assert repo.resolve("HEAD~2") == ids[0] and repo.resolve("@{1}") == ids[1] and repo.resolve(ids[0][:8]) == ids[0] and repo.resolve("main^1") == ids[1]
    for bad in ("nope", "HEAD~9"):
        with pytest.raises(RepoError):
            repo.resolve(bad)
    assert [(r["pos"], r["code"]) for r in repo.diff(ids[0], ids[2]).orderBy("pos").collect()] == [("1", "M"), ("50", "A")]
    assert repo.table("objects").count() == 3 - 0  # one body for each value


def test_status_verify_checkout(spark, history):
    repo, base, ids = history
    same = entries(spark, base | {1: "b", 50: "n"})
    assert repo.status(same).count() == 0 and repo.verify("HEAD", same.repartition(5)) and not repo.verify("HEAD~1", same)
    assert [(r["path"], r["code"]) for r in repo.status(entries(spark, base)).collect()] == [("t", "M")]
    assert values(repo.checkout(ids[0])) == values(entries(spark, base))
    assert repo.clean(table_entries(spark.createDataFrame([(1, "x")], "k int, v string"), "u", ["k"])).collect()[0]["path"] == "u"


def test_merge_pick_revert_rebase(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "r"))
    base = {k: "a" for k in range(8)}
    root = repo.commit(entries(spark, base), "root", when=1)
    repo.branch("side")
    repo.commit(entries(spark, base | {1: "ours"}), "ours", when=2)
    repo.switch("side")
    theirs = repo.commit(entries(spark, base | {2: "theirs"}), "theirs", when=3)
    repo.switch("main")
    assert repo.merge_base("main", "side") == root
    assert repo.merge("side", when=4)["outcome"] == "merged"
    assert values(repo.checkout())["2"] == '{"v":"theirs"}' and repo.merge("side")["outcome"] == "up_to_date"
    repo.switch("side")
    assert repo.merge("main")["outcome"] == "fast_forward"
    assert repo.revert(theirs, when=5)["outcome"] == "merged" and values(repo.checkout())["2"] == '{"v":"a"}'
    repo.branch("other", root)
    repo.switch("other")
    repo.commit(entries(spark, base | {1: "clash"}), "clash", when=6)
    before = repo.head()
    out = repo.merge("main")
    assert out == {"outcome": "conflicts", "paths": ["t"]} and repo.head() == before
    assert repo.rebase("main")["outcome"] == "conflicts" and repo.head() == before
    repo.reset(root)
    repo.commit(entries(spark, base | {5: "own"}), "own", when=7)
    assert repo.rebase("main")["outcome"] == "rebased" and values(repo.checkout())["5"] == '{"v":"own"}' and values(repo.checkout())["1"] == '{"v":"ours"}'
    assert repo.cherry_pick(theirs)["outcome"] == "merged"


def test_names_stash_config(spark, history):
    repo, base, ids = history
    repo.tag("v1", ids[0], "one")
    assert repo.resolve("v1") == ids[0]
    for name in ("../x", "/x", "a..b", ".x"):
        with pytest.raises(RepoError):
            repo.branch(name)
    with pytest.raises(RepoError):
        repo.tag("v1")
    repo.config("user.name", "ann")
    assert repo.config("user.name") == "ann"
    repo.stash_push(entries(spark, {1: "wip"}))
    assert values(repo.stash_pop()) == {"1": '{"v":"wip"}'}
    with pytest.raises(RepoError):
        repo.stash_pop()
    assert repo.reflog()[0]["to"] == ids[2]


def test_bisect(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "b"))
    ids = [repo.commit(entries(spark, {1: str(k)}), str(k), when=k) for k in range(8)]
    assert repo.bisect(bad="HEAD")["state"] == "need_marks"
    step = repo.bisect(good=ids[0])
    steps = 0
    while step["state"] == "step":
        steps += 1
        step = repo.bisect(bad=step["commit"]) if ids.index(step["commit"]) >= 5 else repo.bisect(good=step["commit"])
    assert step == {"state": "done", "commit": ids[5], "remaining": 0} and steps <= 4
    repo.bisect(reset=True)
    repo.bisect(bad=ids[2], good=ids[0])
    assert repo.bisect(skip=ids[1])["state"] == "inconclusive"


def test_fsck_gc_transfer(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "a"))
    repo.commit(entries(spark, {1: "a"}), "one", when=1)
    repo.commit(entries(spark, {1: "a", 2: "b"}), "two", when=2)
    spark.createDataFrame([("f" * 64, bytearray(b"lost"), 4)], "id string, body binary, raw_len bigint").write.mode("append").parquet(f"{repo.root}/objects")
    assert repo.fsck() == {"checked": 3, "corrupt": 1, "missing": 0, "unreachable": 1, "promised": 0, "missing_commits": 0}
    assert repo.gc() == {"kept": 2, "pruned": 1}
    copy = Repo.clone(repo, str(tmp_path / "c"))
    assert values(copy.checkout()) == values(repo.checkout()) and copy.verify_remote(deep=True) == {"branches": 1, "commits": 2, "objects": 2, "missing": 0, "corrupt": 0}
    shallow = Repo.clone(repo, str(tmp_path / "s"), depth=1)
    assert [r["message"] for r in shallow.log().collect()] == ["two"] and shallow.fsck()["missing_commits"] == 0
    lazy = Repo.clone(repo, str(tmp_path / "p"), partial=True)
    assert lazy.fsck()["promised"] == 2 and lazy.backfill() == 2 and lazy.fsck()["missing"] == 0
    copy.commit(entries(spark, {3: "c"}), "three", when=3)
    assert copy.push(repo, "main") == 1 and values(repo.checkout()) == {"3": '{"v":"c"}'}
    repo.commit(entries(spark, {4: "d"}), "four", when=4)
    copy.commit(entries(spark, {5: "e"}), "five", when=5)
    with pytest.raises(RepoError):
        copy.push(repo, "main")
    assert copy.pull(repo, "main")["outcome"] == "merged"


def test_world_round_trip(spark, tmp_path):
    world = make_world(tmp_path / "w")
    (world / "region/r.9.9.mca").write_bytes(b"\0" * 8192)
    repo = Repo.init(spark, str(tmp_path / "r"))
    found = world_entries(spark, str(world))
    repo.commit(found, "world", when=1)
    kinds = {(r["path"], r["kind"]) for r in repo.tree_of().collect()}
    assert ("playerdata/bad.dat", "blob") in kinds and ("icon.png", "blob") in kinds and ("region/r.0.0.mca", "region") in kinds and not any("session.lock" in p for p, _ in kinds)
    out = tmp_path / "out"
    assert write_files(world_files(repo.checkout()), str(out)) > 5
    assert repo.verify("HEAD", world_entries(spark, str(out)))
    part = {r["path"] for r in repo.checkout(regions=[(0, 0)]).collect()}
    assert "region/r.0.0.mca" in part and "icon.png" in part


@pytest.mark.parametrize("path", ["/etc/x", "a/../b", "a//b", "a\\b", "..", ""])
def test_confined(path):
    with pytest.raises(RepoError):
        confined(path)


def test_ingest_stream(spark, tmp_path):
    from chunklake.streaming.feed import ingest

    src = tmp_path / "in"
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "payload binary")
    rows.write.parquet(str(src))
    stream = lambda: spark.readStream.schema("payload binary").parquet(str(src))
    ingest(stream(), str(tmp_path / "store"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    rows.unionByName(spark.createDataFrame([(bytearray(b"c"),)], "payload binary")).write.mode("append").parquet(str(src))
    ingest(stream(), str(tmp_path / "store"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "store")).select(F.count("*"), F.count_distinct("id")).first() == (3, 3)


# Nothing is lost ----------------------------------------------------------------------------------------


def decoded(root):
    """Every file of a world by path: trees decoded, bodies beside regions with them, folders as None."""
    from chunklake.sources import nbt as N
    from chunklake.sources import region as R

    out = {}
    for f in sorted(root.rglob("*")):
        path = str(f.relative_to(root))
        if f.is_dir():
            if not any(f.iterdir()):
                out[path] = None
        elif f.name == "session.lock" or path.startswith("repo/"):
            continue
        elif f.suffix == ".mca" and f.stat().st_size > R.HEADER:
            bodies = {c: c.payload or (f.parent / f"c.{c.x}.{c.z}.mcc").read_bytes() for c in R.parse(path, f.read_bytes())}
            out[path] = {(c.x, c.z): N.canonical(N.read(R.inflate(c.compression, b))[1]) for c, b in bodies.items()}
        elif f.suffix == ".mcc" and (f.parent / "r.0.0.mca").exists() and f.name == "c.3.4.mcc":
            continue
        else:
            try:
                out[path] = N.canonical(N.read(R.unpack_file(f.read_bytes()))[1]) if f.suffix == ".dat" else f.read_bytes()
            except ValueError:
                out[path] = f.read_bytes()
    return out


def odd_world(root):
    """A world with an oversized chunk, hidden names, nested locks, empty folders and bodies that nothing asks for."""
    import random

    from chunklake.sources import nbt as N
    from tests.worlds import chest_chunk, compound, write_region

    make_world(root)
    write_region(root / "region/r.0.0.mca", {(0, 0): chest_chunk(), (3, 4): compound(x=(N.BYTES, random.Random(2).randbytes(1_200_000)))})
    (root / "region/c.9.9.mcc").write_bytes(b"nobody asks for this")
    (root / "region/c.99.99.mcc").write_bytes(b"no region")
    (root / "region/c.99999999999.0.mcc").write_bytes(b"no place")
    for name in ("_note.txt", ".hidden", ".cfg/deep/_x.bin", "data/w/_y", "data/session.lock", "a=b/c.txt", "region/odd.mca"):
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode())
    (root / "empty/inner").mkdir(parents=True)
    (root / "region/r.7.7.mca").write_bytes(b"\0" * 8192)
    return root


def test_round_trip_loses_nothing(spark, tmp_path):
    world = odd_world(tmp_path / "data/w")  # a path whose parts come again inside
    assert (world / "region/c.3.4.mcc").exists()
    repo = Repo.init(spark, str(world / "repo"))
    repo.commit(world_entries(spark, str(world), repo.root), "all", when=1)
    assert repo.commit(world_entries(spark, str(world), repo.root), "again") is None
    paths = {r["path"] for r in repo.tree_of().collect()}
    assert "region/c.3.4.mcc" not in paths and "region/c.9.9.mcc" in paths  # a chunk's own body is in its entry
    assert not any("session.lock" in p or p.startswith("repo") for p in paths) and {"_note.txt", ".cfg/deep/_x.bin", "empty/inner"} <= paths
    out = tmp_path / "out"
    write_files(world_files(repo.checkout()), str(out))
    assert decoded(out) == decoded(world) and len(decoded(world)) > 15
    assert repo.verify("HEAD", world_entries(spark, str(out)))


def test_region_with_a_lost_body_stays_as_it_is(spark, tmp_path):
    world = odd_world(tmp_path / "w")
    (world / "region/c.3.4.mcc").unlink()
    kinds = {r["path"]: (r["kind"], bytes(r["body"])) for r in world_entries(spark, str(world)).where("path like 'region/%'").collect()}
    assert kinds["region/r.0.0.mca"] == ("blob", (world / "region/r.0.0.mca").read_bytes()) and kinds["region/c.9.9.mcc"][0] == "blob"


def test_missing_bodies_are_fetched_or_an_error(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "a"))
    rows = {k: f"v{k}" for k in range(10)}
    repo.commit(entries(spark, rows), "one", when=1)
    lazy = Repo.clone(repo, str(tmp_path / "p"), partial=True)
    assert lazy.table("objects").count() == 0 and values(lazy.checkout()) == values(entries(spark, rows)) and lazy.table("objects").count() == 10
    ids = [r["id"] for r in repo.table("objects").select("id").limit(1).collect()]
    kept = spark.createDataFrame(repo.table("objects").where(~F.col("id").isin(ids)).collect(), repo.table("objects").schema)
    kept.write.mode("overwrite").parquet(f"{repo.root}/objects")
    spark.catalog.refreshByPath(f"{repo.root}/objects")
    with pytest.raises(Exception, match="no object"):
        repo.checkout().collect()


def test_merge_in_a_partial_clone(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "a"))
    base = {k: "a" for k in range(6)}
    repo.commit(entries(spark, base), "root", when=1)
    repo.branch("side")
    repo.commit(entries(spark, base | {1: "ours"}), "ours", when=2)
    repo.switch("side")
    repo.commit(entries(spark, base | {2: "theirs"}), "theirs", when=3)
    repo.switch("main")
    lazy = Repo.clone(repo, str(tmp_path / "p"), partial=True)
    assert lazy.merge("side", when=4)["outcome"] == "merged"
    assert values(lazy.checkout()) == values(entries(spark, base | {1: "ours", 2: "theirs"}))


def test_keys_of_rows_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("~", "x"), ("\\", "|"), ("\\|", None), ("", ""), ("|", ""), ("", "|")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a string, b string, v int")
    assert table_entries(df, "t", ["a", "b"]).select("pos").distinct().count() == len(rows)


def test_long_history(spark, tmp_path):
    """Logs and steps back beyond the depth of Spark's recursive queries."""
    repo = Repo.init(spark, str(tmp_path / "r"))
    first = repo.commit(entries(spark, {1: "a"}), "0", when=0)
    tree = repo.commit_of(first)["tree"]
    ids = [first] + [f"{k:064x}" for k in range(1, 260)]
    spark.createDataFrame([(ids[k], tree, [ids[k - 1]], str(k), "", k) for k in range(1, 260)], repo.table("commits").schema).coalesce(1).write.mode("append").parquet(f"{repo.root}/commits")
    repo._move(ids[-1], "jump")
    assert [r["message"] for r in repo.log().collect()] == [str(k) for k in reversed(range(260))]
    assert repo.resolve("HEAD~200") == ids[59] and repo.resolve("HEAD~259") == first
    with pytest.raises(RepoError):
        repo.resolve("HEAD~260")


def test_marks_are_compared_and_set(spark, tmp_path):
    repo = Repo.init(spark, str(tmp_path / "r"))
    repo.commit(entries(spark, {1: "a"}), "one", when=1)
    seen = repo.meta
    repo.branch("other")
    with pytest.raises(RepoError, match="meanwhile"):
        repo._move("f" * 64, "late", seen=seen)
    late = Repo(spark, repo.root)

    def meanwhile(_):
        late.branch("third")

    with pytest.raises(RepoError, match="meanwhile"):
        seen = repo.meta
        meanwhile(None)
        repo._save(seen)
    assert set(repo.meta["branches"]) == {"main", "other", "third"}
    (tmp_path / f"r/meta/v{repo.meta['at'] + 1:012d}.json").write_text('{"head": ')  # a writer died
    assert set(repo.meta["branches"]) == {"main", "other", "third"}
    repo.branch("fourth")
    assert "fourth" in Repo(spark, repo.root).meta["branches"]


def test_tags_of_tags(spark, history):
    repo, _, ids = history
    inner = repo.tag("inner", ids[1], "first words", when=5)
    outer = repo.tag("outer", "inner", "more words", when=6)
    assert inner != outer and repo.meta["tag_objects"][outer]["object"] == inner
    assert repo.resolve("outer") == repo.resolve("inner") == ids[1] and repo.resolve("outer~1") == ids[0]
    repo.tag("light", ids[2])
    assert repo.meta["tags"]["light"]["target"] == ids[2]


def test_patch_of_whole_worlds(spark, tmp_path):
    from chunklake.operators import worlds as W
    from chunklake.sources import world as world_source
    from tests.worlds import chest_chunk, compound, i, write_dat, write_region

    old, new = odd_world(tmp_path / "a"), odd_world(tmp_path / "b")
    write_region(new / "region/r.0.0.mca", {(0, 0): chest_chunk(0), (7, 7): compound(hp=i(1))})
    (new / "region/c.3.4.mcc").unlink()
    write_dat(new / "level.dat", compound(Data=compound(Player=compound(XpLevel=i(3)), New=i(1))))
    (new / "icon.png").write_bytes(b"\0\xff other")
    (new / ".hidden").unlink()
    (new / "_added").write_bytes(b"new")
    (new / "empty/inner").rmdir()
    a, b = (world_entries(spark, str(w)) for w in (old, new))
    changes = W.entry_changes(a, b).cache()
    key = lambda df: {(r["kind"], r["path"], r["pos"]): bytes(r["body"]) for r in df.where("body is not null").collect()}
    there = W.apply_entries(a, changes)
    assert key(there) == key(b) and there.where(F.size("conflicts") > 0).count() == 0
    assert key(W.apply_entries(b, W.reverse_patch(changes))) == key(a)
    bad = {(r["path"], tuple(r["conflicts"])) for r in W.apply_entries(b, changes).where(F.size("conflicts") > 0).collect()}
    assert ("icon.png", ("",)) in bad and any(p == "level.dat" for p, _ in bad) and ("_added", ("",)) in bad
    assert key(W.apply_entries(b, changes, force=True)).keys() == key(b).keys()
    edits = W.block_edits(*(world_source.raw_chunks(spark, str(w), ("region",)) for w in (old, new)))
    lines = [r["line"] for r in W.diff_lines(a, b, changes, edits).collect()]
    want = ["- .hidden", "+ _added", "~ icon.png", "~ level.dat", "    Data.New (Added)", "    Data.Player.XpLevel (Modified)", "~ region/r.0.0.mca", "    ~ chunk 0,0 (1 changes)", "        @0,0,0: minecraft:stone -> minecraft:air", "    - chunk 3,4", "    + chunk 7,7"]
    at = [lines.index(x) for x in want]
    assert at == sorted(at) and "- empty/inner" in lines


def test_edits_shown_are_bounded(spark, tmp_path):
    from chunklake.operators import worlds as W
    from chunklake.sources import world as world_source
    from tests.worlds import block, compound, lst, section, write_region

    for name, state in (("a", "minecraft:stone"), ("b", "minecraft:dirt")):
        write_region(tmp_path / name / "region/r.0.0.mca", {(0, 0): compound(sections=lst(section(0, [block(state)]))), (1, 0): compound(sections=lst(section(0, [block("minecraft:stone")])))})
    roots = [str(tmp_path / n) for n in "ab"]
    a, b = (world_entries(spark, r) for r in roots)
    raw = [world_source.raw_chunks(spark, r, ("region",)) for r in roots]
    assert W.changed_pairs(*raw).count() == 1  # the equal chunk reaches no decoder
    edits = W.block_edits(*raw)
    assert edits.count() == 4096
    lines = [r["line"] for r in W.diff_lines(a, b, W.entry_changes(a, b), edits).collect()]
    assert sum("@" in x for x in lines) == W.SHOWN_EDITS and lines[-1] == f"        … and {4096 - W.SHOWN_EDITS} more block changes"
    assert W.diff_lines(a, a, W.entry_changes(a, a), W.block_edits(raw[0], raw[0])).count() == 0


def test_only_new_payloads_are_decoded(spark, tmp_path):
    from tests.worlds import chest_chunk, write_region

    world = odd_world(tmp_path / "w")
    chunks = {(k % 8, k // 8): chest_chunk(k % 3) for k in range(24)}
    write_region(world / "region/r.1.0.mca", {(x + 32, z): c for (x, z), c in chunks.items()})
    repo = Repo.init(spark, str(tmp_path / "r"))
    first = repo.world(str(world))
    n = first.where("body is not null").count()
    assert n == first.count() == world_entries(spark, str(world)).count()
    repo.commit(first, "one", when=1)
    assert repo.world(str(world)).where("body is not null").count() == 0 and repo.status(repo.world(str(world))).count() == 0
    write_region(world / "region/r.1.0.mca", {(x + 32, z): c for (x, z), c in (chunks | {(1, 1): chest_chunk(7), (2, 2): chest_chunk(8)}).items()})
    (world / "icon.png").write_bytes(b"other")
    again = repo.world(str(world))
    assert sorted((r["kind"], r["pos"]) for r in again.where("body is not null").collect()) == [("blob", ""), ("region", "33,1"), ("region", "34,2")]
    assert {r["path"]: r["code"] for r in repo.status(again).collect()} == {"icon.png": "M", "region/r.1.0.mca": "M"}
    repo.commit(again, "two", when=2)
    whole = world_entries(spark, str(world))
    assert repo.verify("HEAD", whole) and values_of(repo.checkout()) == values_of(whole)
    repo.gc()
    assert repo.world(str(world)).where("body is not null").count() == 0 and repo.fsck()["missing"] == 0


def values_of(df):
    return {(r["kind"], r["path"], r["pos"]): bytes(r["body"]) for r in df.collect()}
