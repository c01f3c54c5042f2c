import hashlib
import random

from chunklake.llm import syncmers as S


def edited(rows):
    """id to (n, sha of the edited text), by the contract."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""), reverse=True)
    out = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), e))
    return out


def check(docs_of, rows):
    got = S.compare_edited(docs_of(rows, extra=True)).collect()
    want = edited(rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(k), n, h) for k, n, h, _ in want)
    by_text = {}
    prints = {r["doc_id"]: r for r in S.fingerprint(docs_of([(i, e) for i, (_, _, _, e) in enumerate(want)])).collect()}
    of = {(str(k), h): prints[i]["fingerprint"] for i, (k, _, h, _) in enumerate(want)}
    for r in got:
        assert r["edited_fingerprint"] == of[str(r["doc_id"]), r["edited_sha256"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    return by_text, got


def test_edited_texts(docs_of, monkeypatch):
    r = random.Random(1)
    rows = [(k * 7 - 50, "".join(r.choice("ab é😀\n") for _ in range(r.randint(0, 90)))) for k in range(40)]
    check(docs_of, rows)
    monkeypatch.setattr(S, "BUCKET_ROWS", 4)
    check(docs_of, rows)
    check(docs_of, [*rows, (5, None), (3, "dup"), (3, "dup"), (3, "dup two"), (None, "nothing"), (None, None)])


def test_edges(docs_of):
    assert S.compare_edited(docs_of([])).count() == 0
    _, got = check(docs_of, [(1, "alone in the table with some words to see")])
    assert got[0]["near_next"] == 1.0
    _, got = check(docs_of, [(1, None), (2, "")])
    assert {r["near_edited"] for r in got} == {1.0} and {r["fingerprint"] for r in got} == {""}




def test_anchors_are_context_free(docs_of):
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(600)]
    a, b, c = " ".join(words), " ".join(["other", *words]), " ".join([*words[:300], "changed", *words[301:]])
    rows = {x["doc_id"]: x for x in S.fingerprint(docs_of([(1, a), (2, b), (3, c), (4, a), (5, "two words"), (6, "two  words")])).collect()}
    split = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    one, two, three = (split(rows[k]["fingerprint"]) for k in (1, 2, 3))
    assert len(one) == rows[1]["n_anchors"] and len(one) / 595 == __import__("pytest").approx(2 / (S.K - S.S + 1), abs=0.08)
    assert two[-len(one) :] == one
    lost = len(set(one) - set(three))
    assert 0 < lost <= S.K
    assert rows[4]["fingerprint"] == rows[1]["fingerprint"] and rows[5]["fingerprint"] == rows[6]["fingerprint"] != ""


def test_likeness(docs_of):
    r = random.Random(2)
    rows = [(k, " ".join(f"v{r.randint(0, 10**6)}" for _ in range(400))) for k in range(6)]
    for x in S.compare_edited(docs_of(rows)).collect():
        assert 0.4 < x["near_edited"] < 0.6 and x["near_next"] < 0.02 and 0.55 < x["edited_positions"] < 0.75


def test_native(spark, sf_dir):
    from chunklake.llm.queries import QUERIES

    for name in ("op7_syncmers", "op9_url_filter", "op10_chat_format", "op3_decontaminate"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop", "Cartesian")), name


def test_short_and_unspaced_texts(docs_of):
    r = random.Random(6)
    rows = [(k, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(6 + k % 3))) for k in range(60)]
    got = S.fingerprint(docs_of(rows)).collect()
    assert all(x["n_anchors"] > 0 for x in got) and len({x["fingerprint"] for x in got}) == 60
    letters = ["".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(400)) for _ in range(3)] + ["".join(r.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(3)]
    for x in S.compare_edited(docs_of(list(enumerate(letters)))).collect():
        assert 0.35 < x["near_edited"] < 0.65 and x["near_next"] < 0.02


# Brute force ------------------------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def long_hash(values):
    """XXH64 of each value's eight bytes, the last hash as seed."""
    import struct

    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", v & MASK), seed=h)
    return h - (1 << 64) if h >> 63 else h


def short_hash(values):
    """Murmur3 of 32 bits over the halves of each value."""
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    h = 42
    for v in values:
        v &= MASK
        for half in (v & m, v >> 32):
            k = rot(half * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ (h >> 16)) * 0x85EBCA6B & m
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h


def brute_anchors(text):
    """Every run of K words is looked at; equal to the operator's by definition, not by its plan."""
    import regex
    import xxhash

    words = []
    for w in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[^\x20\x09-\x0D\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+", text or ""):
        words += list(w) if len(w) > S.LONG_WORD else [w]
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    if len(h) < S.K:
        return [short_array(h)] if h else []
    runs = [h[i : i + S.K] for i in range(len(h) - S.K + 1)]
    picked = []
    for run in runs:
        inner = [long_hash(run[i : i + S.S]) for i in range(S.K - S.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            picked.append(short_hash(run))
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    return picked or [min((short_hash(r) for r in runs), key=signed)]


def short_array(values):
    return short_hash(values)


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    out = {}
    likeness = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    hexed = lambda a: "".join(f"{x:08x}" for x in a)
    anchors = [brute_anchors(t) for _, t in order]
    for i, (k, t) in enumerate(order):
        j = (i + 1) % len(order)
        t, nxt = t or "", order[j][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        ea = brute_anchors(e)
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(anchors[i]), hexed(ea), likeness(anchors[i], ea), likeness(anchors[i], anchors[j]))
    return out


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_equals_brute_force(spark, sf_dir):
    from chunklake.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op7_syncmers"](spark, sf_dir).collect()}
    assert got == brute_rows(docs)


def test_brute_force_on_odd_texts(docs_of):
    r = random.Random(12)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "x" * 50), (6, "漢字かな" * 20), (7, "a b c d e f"), (8, "la " * 400), (9, "la " * 400), (10, "word " * 30_000)]
    rows += [(20 + k, " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 60)))) for k in range(40)]
    got = {x["doc_id"]: tuple(x[c] for c in COLUMNS) for x in S.compare_edited(docs_of(rows)).collect()}
    assert got == brute_rows(rows)


def test_many_levels_and_hot_ids(docs_of, monkeypatch):
    """Three levels of bounds; a third of the rows have no id and a third one id."""
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    monkeypatch.setattr(S, "FANOUT", 4)
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 12)))
    check(docs_of, [(r.randint(-(10**9), 10**9), text()) for _ in range(150)])
    check(docs_of, [(k * k, text()) for k in range(60)] + [(None, text()) for _ in range(60)] + [(77, text()) for _ in range(60)])
    check(docs_of, [(5, "same")] * 40 + [(None, None)] * 3)
