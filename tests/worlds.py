"""Synthetic worlds, built in code."""

from pathlib import Path

from chunklake.sources import nbt as N
from chunklake.sources import region as R


def compound(**kw):
    return (N.COMPOUND, kw)


def i(v):
    return (N.INT, v)


def s(v):
    return (N.STRING, v)


def lst(*v):
    return (N.LIST, list(v))


def pos(*v):
    return lst(*((N.DOUBLE, float(x)) for x in v))


def write_region(path: Path, chunks: dict, scheme=R.ZLIB):
    path.parent.mkdir(parents=True, exist_ok=True)
    data, outside = R.build([R.Chunk(x, z, scheme, R.deflate(scheme, N.write(root)), False, 1000 + k) for k, ((x, z), root) in enumerate(chunks.items())])
    path.write_bytes(data)
    for name, body in outside.items():
        (path.parent / name).write_bytes(body)


def write_dat(path: Path, root, scheme=R.GZIP):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(R.deflate(scheme, N.write(root)))


def block(name, **props):
    extra = {"Properties": compound(**{k: s(v) for k, v in props.items()})} if props else {}
    return compound(Name=s(name), **extra)


def section(y, palette, data=None, biomes=("minecraft:plains",)):
    states = {"palette": lst(*palette)} | ({"data": (N.LONGS, data)} if data else {})
    return compound(Y=(N.BYTE, y), block_states=compound(**states), biomes=compound(palette=lst(*map(s, biomes))))


def chest_chunk(first=1):
    data = [0] * 256
    data[0] = first
    chest = compound(id=s("minecraft:chest"), x=i(0), y=i(0), z=i(0))
    return compound(sections=lst(section(0, [block("minecraft:air"), block("minecraft:stone")], data)), block_entities=lst(chest))


def make_world(root: Path):
    write_dat(root / "playerdata/00000000-0000-0000-0000-000000000001.dat", compound(Pos=pos(1, 64, -3), Dimension=s("minecraft:overworld"), Health=(N.FLOAT, 18.0), XpLevel=i(7)))
    write_dat(root / "level.dat", compound(Data=compound(Player=compound(Pos=pos(0, 70, 0), XpLevel=i(2)))))
    (root / "playerdata/bad.dat").write_bytes(b"no tree")
    sign = compound(id=s("minecraft:sign"), x=i(10), y=i(70), z=i(-2), front_text=compound(messages=lst(s("hello"), s("world"))))
    old_sign = compound(id=s("minecraft:oak_sign"), x=i(11), y=i(70), z=i(-2), Text1=s("a"), Text2=s("b"))
    write_region(root / "region/r.0.0.mca", {(0, 0): chest_chunk(), (5, 9): compound(block_entities=lst(sign, old_sign))})
    write_region(root / "entities/r.0.0.mca", {(0, 0): compound(Entities=lst(compound(id=s("minecraft:zombie"), Pos=pos(5, 65, 5))))})
    write_region(root / "poi/r.0.0.mca", {(0, 0): compound(Sections=compound(**{"0": compound(Records=lst(compound(type=s("minecraft:home"), pos=(N.INTS, [10, 64, -5]))))}))})
    (root / "icon.png").write_bytes(b"png")
    (root / "session.lock").write_bytes(b"x")
    return root
