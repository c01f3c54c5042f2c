import math
import random

import pytest

from chunklake.sources import nbt as N
from chunklake.sources import region as R
from tests.worlds import compound, i, lst, s


def tree():
    return compound(
        a=(N.BYTE, -3), b=(N.SHORT, 300), c=i(-70000), d=(N.LONG, 2**53 + 1), e=(N.FLOAT, 1.5), f=(N.DOUBLE, 0.1), g=(N.BYTES, b"\x00\xff"), h=s("x\0\U0001f600é"), j=lst(i(1), i(2)), k=compound(z=i(1), y=i(2)), m=(N.INTS, [1, -2]), n=(N.LONGS, [2**62, -1]), o=lst()
    )


def test_binary_and_json_round_trips():
    assert N.read(N.write(tree(), "root")) == ("root", tree())
    assert N.from_json(N.to_json(tree())) == tree()
    for x in (math.inf, -math.inf):
        assert N.from_json(N.to_json((N.DOUBLE, x))) == (N.DOUBLE, x)
    assert math.isnan(N.from_json(N.to_json((N.DOUBLE, math.nan)))[1])
    for bad in ('{"int":1,"long":"2"}', "{}", "[]", '{"no":1}', "x"):
        with pytest.raises(N.BadData):
            N.from_json(bad)
    assert N.from_json('{"byte":200}') == (N.BYTE, -56)


@pytest.mark.parametrize("cut", range(0, 40, 3))
def test_cut_data_is_an_error(cut):
    with pytest.raises(N.BadData):
        N.read(N.write(tree())[: -1 - cut])


def test_depth_is_bounded():
    deep = compound()
    for _ in range(N.MOST_DEPTH + 2):
        deep = compound(x=deep)
    with pytest.raises(N.BadData):
        N.read(N.write(deep))


def test_canonical_bytes_ignore_key_order():
    a, b = compound(x=i(1), y=lst(compound(p=i(1), q=i(2)))), compound(y=lst(compound(q=i(2), p=i(1))), x=i(1))
    assert N.canonical(a) == N.canonical(b) and N.write(a) != N.write(b)


def test_identity_order():
    xyz = {c: i(v) for c, v in zip("xyz", (10, 64, -3), strict=True)}
    assert N.identity(compound(UUID=(N.INTS, [1, 2, 3, 4]), id=s("a"))) == "uuid:1,2,3,4"
    assert N.identity(compound(UUIDMost=(N.LONG, 1), UUIDLeast=(N.LONG, 2), **xyz)) == "uuid:1,2"
    assert N.identity(compound(**xyz, id=s("a"))) == "block:10,64,-3"
    assert N.identity(compound(Slot=(N.BYTE, 2), id=s("a"))) == "slot:2"
    assert N.identity(compound(id=s("minecraft:stone"))) == "id:minecraft:stone"
    assert N.identity(compound()) is None and N.identity(i(1)) is None


def test_paths():
    root = compound(Data=compound(Player=compound(Pos=lst((N.DOUBLE, 1.0), (N.DOUBLE, 2.0)))), Entities=lst(compound(UUID=(N.INTS, [1, 2, 3, 4]), id=s("zombie"))))
    assert N.get(root, N.parse_path("Data.Player.Pos[1]")) == (N.DOUBLE, 2.0)
    assert N.get(root, N.parse_path("Entities[uuid:1,2,3,4].id")) == s("zombie")
    assert N.put(root, N.parse_path("Data.Player.Pos[2]"), (N.DOUBLE, 3.0)) and not N.put(root, N.parse_path("Data.Player.Pos[9]"), i(1))
    assert N.drop(root, N.parse_path("Entities[0]")) and not N.drop(root, N.parse_path("nope.x"))
    for bad in ("", "a[", "a[]"):
        with pytest.raises(N.BadData):
            N.parse_path(bad)
    assert N.path_text(N.parse_path("a.b[3][id:x].c")) == "a.b[3][id:x].c"


def kinds(a, b):
    return [(N.path_text(list(p)), k) for p, k, _, _ in N.changes(a, b)]


def test_changes():
    a = compound(x=i(1), y=i(2), gone=i(3))
    assert sorted(kinds(a, compound(x=i(1), y=i(9), z=i(4)))) == [("gone", "removed"), ("y", "modified"), ("z", "added")]
    one, two = compound(id=s("a"), v=i(1)), compound(id=s("b"), v=i(2))
    assert kinds(compound(l=lst(one, two)), compound(l=lst(two, one))) == []
    assert kinds(lst(i(1), i(2)), lst(i(1), i(3), i(5))) == [("[1]", "modified"), ("[2]", "added")]
    assert kinds(compound(t=i(1)), compound(t=s("1"))) == [("t", "type_changed")]
    assert kinds((N.INTS, [1]), (N.INTS, [1, 2])) == [("", "modified")]
    assert kinds(lst(), lst(one)) == [("[0]", "added")]
    assert kinds((N.DOUBLE, math.nan), (N.DOUBLE, math.nan)) == [("", "modified")] and kinds((N.DOUBLE, 0.0), (N.DOUBLE, -0.0)) == []


def random_tree(r, depth=0):
    kind = r.choice([N.INT, N.STRING, N.LIST, N.COMPOUND, N.INTS]) if depth < 4 else N.INT
    if kind == N.INT:
        return i(r.randint(0, 4))
    if kind == N.STRING:
        return s(r.choice("abc"))
    if kind == N.INTS:
        return (N.INTS, [r.randint(0, 2) for _ in range(r.randint(0, 3))])
    if kind == N.LIST:
        return lst(*(compound(id=s(str(r.randint(0, 3))), v=random_tree(r, depth + 2)) if r.random() < 0.5 else compound(v=i(k)) for k in range(r.randint(0, 4))))
    return compound(**{r.choice("pqrst."): random_tree(r, depth + 1) for _ in range(r.randint(0, 4))})


@pytest.mark.parametrize("seed", range(60))
def test_patches_lead_there_and_back(seed):
    r = random.Random(seed)
    a, b = compound(x=random_tree(r)), compound(x=random_tree(r))
    ops = N.changes(a, b)
    there = N.from_json(N.to_json(a))
    assert N.apply(there, [(p, o, n) for p, _, o, n in ops]) == []
    assert N.changes(there, b) == []
    assert N.apply(there, [(p, n, o) for p, _, o, n in ops]) == []
    assert N.changes(there, a) == []


def test_guarded_apply():
    a = compound(hp=i(1))
    ops = [(p, o, n) for p, _, o, n in N.changes(a, compound(hp=i(2)))]
    other = compound(hp=i(99))
    assert N.apply(other, ops) == ["hp"] and other == compound(hp=i(99))
    assert N.apply(other, ops, force=True) == [] and other == compound(hp=i(2))


def test_region_round_trip_and_oversized():
    big = random.Random(1).randbytes(1_100_000)
    chunks = [R.Chunk(0, 0, R.PLAIN, b"abc", False, 5), R.Chunk(5, 9, R.ZLIB, big, False, 6), R.Chunk(33, -1, R.GZIP, b"z", False, 7)]
    data, outside = R.build(chunks[:2])
    got = R.parse("region/r.0.0.mca", data)
    assert got[0] == chunks[0] and got[1].external and got[1].payload is None and list(outside) == ["c.5.9.mcc"]
    neg, _ = R.build([R.Chunk(33, -1, R.GZIP, b"z", False, 7)])
    assert R.parse("r.1.-1.mca", neg) == [chunks[2]]
    assert R.parse("r.0.0.mca", b"") == [] and R.parse("r.0.0.mca", data[:5000]) == []
    with pytest.raises(R.BadRegion):
        R.parse("region/x.mca", data)


@pytest.mark.parametrize("scheme", [R.GZIP, R.ZLIB, R.PLAIN, R.LZ4])
def test_codecs(scheme):
    assert R.inflate(scheme, R.deflate(scheme, b"hello" * 100)) == b"hello" * 100
    with pytest.raises(R.BadRegion):
        R.inflate(scheme, R.deflate(scheme, b"a" * 5000), most=1000)


def test_codec_errors():
    for scheme, body in ((R.CUSTOM, b""), (R.ZLIB, b"xx"), (R.GZIP, R.deflate(R.GZIP, b"abc" * 99)[:-12])):
        with pytest.raises(R.BadRegion):
            R.inflate(scheme, body)
