import pytest
from pyspark.sql import functions as F

from chunklake.operators import worlds as W
from chunklake.sources import nbt as N
from chunklake.sources import png, world
from tests.worlds import block, chest_chunk, compound, i, make_world, section, write_region


@pytest.fixture(scope="module")
def old(tmp_path_factory):
    return make_world(tmp_path_factory.mktemp("old"))


@pytest.fixture(scope="module")
def decoded(spark, old):
    return world.chunks(world.raw_chunks(spark, str(old))).cache()


def test_players(spark, old):
    rows = {r["id"]: r for r in world.players(spark, str(old)).collect()}
    assert rows.keys() == {"host", "00000000-0000-0000-0000-000000000001"}
    r = rows["00000000-0000-0000-0000-000000000001"]
    assert (r["pos"], r["health"], r["xp_level"], r["dimension"]) == ([1.0, 64.0, -3.0], 18.0, 7, "minecraft:overworld")


def test_find(decoded):
    assert W.find_entities(decoded, "zombie").collect()[0]["pos"] == [5.0, 65.0, 5.0]
    assert W.find_entities(decoded, "creeper").count() == 0
    signs = {r["id"]: r["text"] for r in W.find_signs(decoded).collect()}
    assert signs == {"minecraft:sign": ["hello", "world"], "minecraft:oak_sign": ["a", "b"]}
    assert [tuple(r) for r in W.points_of_interest(decoded).collect()] == [("minecraft:home", 10, 64, -5)]


def test_region_info(spark, old):
    rows = W.region_info(world.raw_chunks(spark, str(old), ("region",))).orderBy("x").collect()
    assert [(r["x"], r["z"], r["compression"], r["external"], r["timestamp"]) for r in rows] == [(0, 0, 2, False, 1000), (5, 9, 2, False, 1001)]


def test_inspect(spark, decoded):
    points = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (900, 5, 0)], "x int, y int, z int")
    rows = {(r["x"], r["y"], r["z"]): (r["block"], r["biome"], r["block_entity"]) for r in W.inspect(decoded, points).collect()}
    assert rows == {(0, 0, 0): ("minecraft:stone", "minecraft:plains", "minecraft:chest"), (1, 0, 0): ("minecraft:air", "minecraft:plains", None), (900, 5, 0): (None, None, None)}


def test_where_changed_and_diff(spark, old, tmp_path):
    new = make_world(tmp_path / "new")
    write_region(new / "region/r.0.0.mca", {(0, 0): chest_chunk(0), (7, 7): compound(hp=i(1))})
    a, b = (world.raw_chunks(spark, str(p), ("region",)) for p in (old, new))
    rows = W.where_changed(a, b).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, "minecraft:stone", "minecraft:air")]
    changes = W.chunk_diff(a, b).cache()
    kinds = {(r["cx"], r["path"]): r["kind"] for r in changes.collect()}
    assert kinds == {(0, "sections[0].block_states.data"): "modified", (5, ""): "removed", (7, ""): "added"}
    assert W.file_summary(changes).collect()[0]["n_chunks"] == 3
    tree = lambda df: {(r["cx"], r["cz"]): N.canonical(world.decode(r["comp"], bytes(r["payload"]))) for r in df.collect()}
    there = W.apply_patch(a, changes)
    assert tree(there) == tree(b) and there.where(F.size("conflicts") > 0).count() == 0
    assert tree(W.apply_patch(b, W.reverse_patch(changes))) == tree(a)
    bad = W.apply_patch(b, changes).where(F.size("conflicts") > 0)
    assert {(r["cx"], tuple(r["conflicts"])) for r in bad.collect()} == {(0, ("sections[0].block_states.data",)), (5, ("",)), (7, ("",))}


def test_external_bodies(spark, tmp_path):
    import random

    r = random.Random(1)
    big = compound(x=(N.BYTES, r.randbytes(1_200_000)))
    write_region(tmp_path / "region/r.0.0.mca", {(1, 2): big})
    raw = world.raw_chunks(spark, str(tmp_path)).collect()
    assert len(raw) == 1 and raw[0]["external"] and N.changes(world.decode(raw[0]["comp"], bytes(raw[0]["payload"])), big) == []
    (tmp_path / "region/c.1.2.mcc").unlink()
    assert world.raw_chunks(spark, str(tmp_path)).count() == 0


def test_bad_names(spark, tmp_path):
    write_region(tmp_path / "region/r.0.0.mca", {(0, 0): chest_chunk()})
    (tmp_path / "region/odd.mca").write_bytes(b"x" * 9000)
    assert world.raw_chunks(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="no region's name"):
        world.raw_chunks(spark, str(tmp_path), strict=True).count()


def test_unresolvable_sections_have_no_cells(spark, tmp_path):
    write_region(tmp_path / "region/r.0.0.mca", {(0, 0): compound(sections=N_list(section(0, [block("a"), block("b", axis="x", b="1")], [0b0011] + [0] * 255), section(1, [block("s", z="1", a="2")])))})
    cells = W.cells(W.sections(world.chunks(world.raw_chunks(spark, str(tmp_path)))))
    assert {(r["state"], r["n"]) for r in cells.groupBy("state").agg(F.count("*").alias("n")).collect()} == {("s[a=2,z=1]", 4096)}


def N_list(*x):
    return (N.LIST, list(x))


def test_render(spark, decoded):
    top = W.surface(decoded)
    rows = W.pixels(top).collect()
    assert [(r["x"], r["z"], r["r"], r["g"], r["b"]) for r in rows] == [(0, 0, 122, 122, 122)]
    image, info = png.render(W.pixels(top))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and info == {"width": 16, "height": 16, "truncated": False}


def test_ceiling(spark, tmp_path):
    """Above the Nether's height no block is the top of its column."""
    write_region(tmp_path / "DIM-1/region/r.0.0.mca", {(0, 0): compound(sections=N_list(section(0, [block("minecraft:netherrack")]), section(7, [block("minecraft:bedrock")])))})
    raw = world.raw_chunks(spark, str(tmp_path), dimension="the_nether")
    tops = {most: {(r["y"], r["state"]) for r in W.surface(world.chunks(raw), most_y=most).collect()} for most in (W.CEILING["the_nether"], 319, 100)}
    assert tops == {120: {(120, "minecraft:bedrock")}, 319: {(127, "minecraft:bedrock")}, 100: {(15, "minecraft:netherrack")}}


def test_inspect_reads_the_points_own_chunks(spark, tmp_path):
    write_region(tmp_path / "region/r.0.0.mca", {(0, 0): chest_chunk(), (1, 0): chest_chunk()})
    write_region(tmp_path / "region/r.1.0.mca", {(32, 0): chest_chunk()})
    (tmp_path / "region/r.5.5.mca").write_bytes(b"never read")
    raw = world.raw_chunks(spark, str(tmp_path), ("region",), regions=[(0, 0)])
    assert {(r["cx"], r["cz"]) for r in raw.select("cx", "cz").collect()} == {(0, 0), (1, 0)}
    points = spark.createDataFrame([(0, 0, 0), (16, 0, 0), (16, 0, 99)], "x int, y int, z int")
    rows = {(r["x"], r["z"]): (r["block"], r["block_entity"]) for r in W.inspect_raw(raw, points).collect()}
    assert rows == {(0, 0): ("minecraft:stone", "minecraft:chest"), (16, 0): ("minecraft:stone", None), (16, 99): (None, None)}


def test_map_is_cut(spark, tmp_path):
    write_region(tmp_path / "region/r.0.0.mca", {(k, 0): chest_chunk() for k in range(6)})
    top = W.pixels(W.surface(world.chunks(world.raw_chunks(spark, str(tmp_path)))))
    assert png.render(top)[1] == {"width": 96, "height": 16, "truncated": False}
    assert png.render(top, 2)[1] == {"width": 32, "height": 16, "truncated": True}
