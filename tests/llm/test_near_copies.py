import random

import numpy as np

import corpus_pipeline as P
from chunklake.llm import near_copies as N
from chunklake.llm.simhash_dedup import Forest, joining


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Brute force: the least id of each component of similarity 0.8."""
    root = {k: k for k, _ in rows}
    find = lambda k: k if root[k] == k else find(root[k])
    sets = [(k, shingles(t)) for k, t in rows]
    for k, a in sets:
        for j, b in sets:
            if j < k and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(k for k, _ in rows if find(k) == k)


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
    return " ".join(w)


def test_stage_drops_all_near_copies(spark, docs_of):
    r = random.Random(3)
    base = [" ".join(f"w{r.randint(0, 900)}" for _ in range(r.choice([60, 200, 500]))) for _ in range(15)]
    rows = list(enumerate(base))
    for t in base:
        for edits in range(1, 9):
            rows.append((len(rows), edited(r, t, edits)))
    rows += [(900, base[3]), (901, base[3].upper()), (902, "two words"), (903, "Two  words"), (904, "two others"), (905, None), (906, ""), (907, " \n")]
    want = survivors(rows)
    assert sorted(x["doc_id"] for x in P.drop_near_copies(spark, docs_of(rows, extra=True), None).collect()) == want
    from chunklake.llm import simhash_dedup

    assert len(want) < simhash_dedup.keep_first(docs_of(rows)).count()


def test_chains_and_edges(docs_of):
    t = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(t[2 * k : 2 * k + 60])) for k in range(20)]
    random.Random(1).shuffle(rows)
    assert [x["doc_id"] for x in N.keep_first(docs_of(rows)).collect()] == survivors(rows) == [0]
    assert N.keep_first(docs_of([])).count() == 0
    assert sorted(map(str, (x["doc_id"] for x in N.keep_first(docs_of([(None, "a"), (None, "a"), (1, "b"), (1, "a")])).collect()))) == ["1", "None", "None"]


def test_groups_are_compared_in_tiles(docs_of, monkeypatch):
    """Chains and families whose members differ from the least one, in blocks of three texts."""
    monkeypatch.setattr(N, "TILE", 3)
    r = random.Random(9)
    t = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(t[3 * k : 3 * k + 60])) for k in range(30)]
    for family in range(6):
        body = " ".join(f"v{r.randint(0, 900)}" for _ in range(120))
        rows += [(100 + 20 * family + k, edited(r, body, k)) for k in range(16)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    assert sorted(x["doc_id"] for x in N.keep_first(docs_of(shuffled)).collect()) == survivors(rows)


def test_ties_of_wide_fingerprints_match_brute_force(docs_of, monkeypatch):
    """All pairs that the tiles tie, in one piece and over many small tiles, join what brute force joins."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, (6, 400), np.uint64)
    sets = [np.concatenate((s[: n - k], r.integers(0, 2**64, k, np.uint64))) for s in base for n, k in ((400, 0), (400, 20), (400, 40), (340, 0), (300, 5), (200, 0))]
    rows = np.array([[i, len(s), *N.fingerprint(s).tolist()] for i, s in enumerate(sets)], np.uint64)
    sizes = rows[:, 1].astype(float)
    d = np.bitwise_count(rows[:, None, 2:] ^ rows[None, :, 2:]).astype(int)
    want = {(i, j) for i in range(len(rows)) for j in range(i) if d[i, j, 0] <= N.FIRST_RADIUS and d[i, j].sum() <= N.RADIUS}
    alike = {(i, j) for i, j in want if min(sizes[i], sizes[j]) >= N.SIMILARITY * max(sizes[i], sizes[j])}
    monkeypatch.setattr(N, "INNER_TILE", 5)
    got = {(max(i, j), min(i, j)) for u, v in N.tied_pairs(rows, None) for i, j in zip(u.tolist(), v.tolist(), strict=True)}
    assert alike <= got <= want and alike
    across = {(i, j + 18) for u, v in N.tied_pairs(rows[:18], rows[18:]) for i, j in zip(u.tolist(), v.tolist(), strict=True)}
    assert {(j, i) for i, j in alike if j < 18 <= i} <= across


def test_bits_are_majorities_over_all_shingles():
    h = np.random.default_rng(1).integers(0, 2**64, 10_001, np.uint64)
    mixed = (h[:, None] ^ N._XOR) * N._TIMES
    mixed = (mixed ^ (mixed >> np.uint64(32))) * N._AGAIN
    mixed ^= mixed >> np.uint64(29)
    bits = np.unpackbits(mixed.view(np.uint8), axis=1).astype(int).sum(axis=0)
    assert np.array_equal(np.unpackbits(N.fingerprint(h).view(np.uint8)), (2 * bits > len(h)).astype(np.uint8))


def test_stage_over_many_tiles(docs_of, monkeypatch):
    monkeypatch.setattr(N, "FP_TILE", 4)
    r = random.Random(4)
    base = [" ".join(f"w{r.randint(0, 900)}" for _ in range(r.choice([60, 75, 95, 200]))) for _ in range(12)]
    rows = [(10 * k + e, edited(r, t, e)) for k, t in enumerate(base) for e in range(5)]
    assert sorted(x["doc_id"] for x in N.keep_first(docs_of(rows)).collect()) == survivors(rows)


def test_links_that_join_are_a_forest():
    r = np.random.default_rng(2)
    found = [(r.integers(0, 300, 500), r.integers(0, 300, 500)) for _ in range(2)] + [(np.zeros(0, int), np.zeros(0, int)), (np.arange(299), np.arange(1, 300))]
    kept = [(int(i), int(j)) for u, v in joining(iter(found), 300) for i, j in zip(u, v, strict=True)]
    assert len(kept) == 299
    forest = Forest()
    assert all(forest.join(i, j) for i, j in kept)
