import random

import numpy as np
import xxhash

from chunklake.llm import simhash_dedup as S
from chunklake.llm.graph import connected_components


def slow_simhash(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points):
    """Brute force: (id, fingerprint) to (id, hex, least reachable id)."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(points):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, f"{fp:016x}", least[find(i)]) for i, (k, fp) in enumerate(points))


def test_fingerprints():
    r = random.Random(2)
    for t in [None, "", " \n", "One", "a b c d", "a b c d e", "É x Y\tz\x0bq w", "w " * 70_000, *(" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 40))) for _ in range(50))]:
        assert S.simhash(t) == slow_simhash(t)
    a = slow_simhash("the quick brown fox jumps")
    assert S.simhash("THE quick\nbrown  fox jumps") == a


def test_tiles_find_all_links(spark, monkeypatch):
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(300)]
    for _ in range(500):
        x = r.choice(fps)
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted({*fps, 0, 2**64 - 1, 2**63})
    monkeypatch.setattr(S, "INNER_TILE", 16)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint")
    links = connected_components(S.tile_links(df, tile=8)).collect()
    root = {n["node"] & 2**64 - 1: n["root"] & 2**64 - 1 for n in links}
    want = components(list(enumerate(fps)))
    mine = {}
    for x in fps:
        mine.setdefault(root.get(x, x), []).append(x)
    theirs = {}
    for k, _, c in want:
        theirs.setdefault(c, []).append(fps[k])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pairs_inside_and_between():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64))
    got = {(i, j) for a, b in S.linked_pairs(base, near) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(400) for j in range(400) if int(base[i] ^ near[j]).bit_count() <= 4}
    both = np.concatenate((base, near))
    got = {frozenset((i, j)) for a, b in S.linked_pairs(both, None) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {frozenset((i, j)) for i in range(800) for j in range(i) if int(both[i] ^ both[j]).bit_count() <= 4}


def test_near_duplicates(docs_of):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(300)) for _ in range(12)]
    rows = [(100 - k, t) for k, t in enumerate(base)]
    rows += [(200 + k, t.replace(t.split()[5], "zz", 1)) for k, t in enumerate(base)] + [(300, base[0]), (301, base[0]), (7, None), (8, ""), (9, " \t"), (5, "one"), (5, "one")]
    got = sorted((x["doc_id"], x["fingerprint"], x["component_id"]) for x in S.near_duplicates(docs_of([*rows, (None, "x")], extra=True)).collect())
    assert got == components([(k, slow_simhash(t)) for k, t in rows])
    kept = sorted(x["doc_id"] for x in S.keep_first(docs_of(rows)).collect())
    assert kept == sorted({c for _, _, c in got})
    assert S.near_duplicates(docs_of([])).count() == 0 and S.keep_first(docs_of([])).count() == 0
    assert [x["doc_id"] for x in S.keep_first(docs_of([(None, "a"), (None, "a")])).collect()] == [None, None]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (-3, 2000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{1000 + k: 1000 for k in range(200)}, -3: -3, 2000: -3}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_query(spark, sf_dir):
    from chunklake.llm.queries import QUERIES

    texts = [(r["doc_id"], slow_simhash(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_dedup"](spark, sf_dir).collect())
    assert got == components(texts)
