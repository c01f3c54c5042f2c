import json

import pytest

from chunklake.cli import main
from tests.worlds import chest_chunk, compound, i, make_world, write_region


@pytest.fixture
def cli(spark, tmp_path, capsys):
    def run(*args):
        code = main(["-C", str(tmp_path / "repo"), *map(str, args)], spark)
        out = capsys.readouterr()
        return code, [json.loads(x) for x in out.out.splitlines()] if not out.err else out.err

    return run


def test_history(cli, tmp_path):
    world = make_world(tmp_path / "w")
    assert cli("init") == (0, []) and cli("init")[0] == 2
    code, (done,) = cli("commit", world, "--message", "one", "--author", "ann")
    assert code == 0 and cli("commit", world, "--message", "again")[0] == 1
    assert cli("status", world)[0] == 0 and cli("verify", "HEAD", world)[0] == 0
    (world / "icon.png").write_bytes(b"other")
    assert cli("status", world) == (1, [{"path": "icon.png", "code": "M"}]) and cli("verify", "HEAD", world)[0] == 1
    cli("commit", world, "--message", "two")
    assert [r["message"] for r in cli("log", "--oneline")[1]] == ["two", "one"]
    assert cli("diff", "HEAD~1", "HEAD")[1][0]["path"] == "icon.png"
    assert cli("rev-parse", "HEAD~1")[1] == [done["commit"]]
    code, _ = cli("checkout", "HEAD~1", tmp_path / "out")
    assert code == 0 and (tmp_path / "out/icon.png").read_bytes() == b"png" and cli("checkout", "HEAD", tmp_path / "out")[0] == 2
    assert cli("branch", "side", "HEAD~1")[0] == 0 and set(cli("branch")[1][0]) == {"main", "side"}
    assert cli("fsck")[1][0]["missing"] == 0 and cli("rev-parse", "nothing")[0] == 2
    (world / "extra.txt").write_text("x")
    assert cli("clean", world)[1] == [{"would_remove": ["extra.txt"]}] and cli("clean", world, "--force")[0] == 0 and not (world / "extra.txt").exists()


def test_world_commands(cli, tmp_path):
    old, new = make_world(tmp_path / "a"), make_world(tmp_path / "b")
    write_region(new / "region/r.0.0.mca", {(0, 0): chest_chunk(0), (7, 7): compound(hp=i(1))})
    assert len(cli("players", old)[1]) == 2
    assert cli("find", "entity", old, "zombie")[0] == 0 and cli("find", "entity", old, "creeper")[0] == 1
    assert cli("inspect", old, 0, 0, 0)[1][0]["block"] == "minecraft:stone"
    assert cli("where-changed", old, new) == (1, [{"x": 0, "y": 0, "z": 0, "old": "minecraft:stone", "new": "minecraft:air"}])
    assert cli("where-changed", old, old)[0] == 0
    assert len(cli("poi", old)[1]) == 1 and len(cli("region", old)[1]) == 4
    assert cli("render", old, tmp_path / "m.png")[0] == 0 and (tmp_path / "m.png").read_bytes()[:4] == b"\x89PNG"
    patch = f"file://{tmp_path}/patch"
    assert cli("extract", old, new, patch)[0] == 0
    assert cli("apply", patch, old, tmp_path / "c")[0] == 0 and cli("where-changed", tmp_path / "c", new)[0] == 0
    assert cli("apply", patch, new, tmp_path / "d")[0] == 1
    assert cli("apply", patch, new, tmp_path / "e", "--reverse")[0] == 0 and cli("where-changed", tmp_path / "e", old)[0] == 0
