import collections
import random
import re

from chunklake.llm import decontaminate as D


def words(t):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def shingles(w, k):
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, bar=0.8):
    """Best similarity of item-sized windows, all of them looked at."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            k = min(5, len(v))
            if not v or len(w) < k or d is None or i is None:
                continue
            s = shingles(v, k)
            best = max(sum((shingles(w[a : a + len(v)], k) & s).values()) / max(1, sum((shingles(w[a : a + len(v)], k) | s).values())) for a in range(max(1, len(w) - len(v) + 1)))
            if best >= bar:
                out[d, i] = max(out.get((d, i), 0), round(best, 6))
    return out


def found(spark, docs_of, docs, items):
    it = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(docs_of(docs, extra=True), it).collect()}


def test_planted_passages(spark, docs_of):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(["of", "the", "and"]) if r.random() < 0.3 else f"w{r.randint(0, 500)}" for _ in range(n))
    items = [(k, text(r.randint(14, 60))) for k in range(12)]
    docs = []
    for k in range(60):
        body = text(r.randint(20, 150)).split()
        if k % 2 == 0:
            passage = items[k % 12][1].split()
            if k % 6 == 0:
                passage[r.choice([0, 1, -1, -2])] = "CHANGED"
            if k % 8 == 0:
                passage = [w.upper() + "," for w in passage]
            at = r.randint(0, len(body))
            body[at:at] = passage
        docs.append((k, " ".join(body)))
    want = brute(docs, items)
    assert len(want) >= 25 and found(spark, docs_of, docs, items) == want


def test_edges(spark, docs_of):
    items = [(1, None), (2, ""), (3, "one"), (4, "two words"), (5, "a b c d e f g"), (6, "a b c d e f g"), (None, "x y"), (7, "zz " * 30)]
    docs = [(1, None), (2, ""), (3, "One!"), (4, "say two, words now"), (5, "A b-c d e. f g h"), (5, "A b-c d e. f g h"), (6, "a b c d e f"), (7, "zz " * 200), (None, "one"), (8, "b c d e f g")]
    docs_ = [d for d in docs]
    want = {k: v for k, v in brute(docs_, items).items()}
    assert found(spark, docs_of, docs, items) == want and (5, 6) in want and (4, 4) in want
    assert found(spark, docs_of, [], items) == {} and found(spark, docs_of, docs, []) == {}
    left = D.without_leaks(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_cover_the_radius(spark):
    """Every fingerprint within the radius agrees with an indexed neighbour in some block."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = []
    for _ in range(200):
        a, b = r.getrandbits(64), 0
        for bit in r.sample(range(64), D.RADIUS):
            b |= 1 << bit
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        rows.append((signed(a), signed(a ^ b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    hit = F.arrays_overlap(D.block_values("a", True), D.block_values("b", False))
    assert df.where(~hit).count() == 0


def test_query(spark, sf_dir):
    from chunklake.llm.queries import QUERIES

    rows = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    docs, items = rows("documents", "doc_id"), rows("benchmark", "item_id")
    hits = [(d, t) for d, t in docs if any(re.sub(r"\W+", " ", x.lower())[:25] in re.sub(r"\W+", " ", (t or "").lower()) for _, x in items)]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    want = brute(hits, items)
    assert want and want.items() <= got.items()


def test_no_pair_at_the_bar_is_lost(spark, docs_of):
    """One changed word in 49 leaves 40 of 50 shingles; some such pairs differ by more than 17 bits."""
    r = random.Random(8)
    items = [[f"v{r.randint(0, 10**9)}" for _ in range(49)] for _ in range(1_500)]
    rows = [(k, " ".join([*w[:24], "changed", *w[25:]])) for k, w in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = D.find_leaks(docs_of(rows), bench).collect()
    assert sorted((x["doc_id"], x["item_id"], x["similarity"]) for x in found) == [(k, k, 0.8) for k in range(len(items))]
    assert max(x["hamming"] for x in found) > 17


def rearranged(r, words, how):
    """A passage with its halves swapped, words inserted, taken out or changed, or parts moved."""
    w = list(words)
    n = len(w)
    if how == "swapped":
        return w[n // 2 :] + w[: n // 2]
    if how == "inserted":
        for _ in range(r.randint(1, 2)):
            w.insert(r.randrange(n), f"in{r.randint(0, 999)}")
    elif how == "shortened":
        at = r.randrange(n - 2)
        del w[at : at + r.randint(1, 2)]
    elif how == "cut":
        del w[: r.randint(1, n // 10)]
    elif how == "changed":
        w[r.choice([0, n // 2, n - 1])] = "CHANGED"
    elif how == "rotated":
        k = r.randint(1, n - 1)
        w = w[k:] + w[:k]
    return w


def test_passages_out_of_order(spark, docs_of):
    r = random.Random(21)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([30, 45, 60, 61, 90])))) for k in range(10)]
    hows = ["swapped", "inserted", "shortened", "cut", "changed", "rotated"]
    docs = []
    for k in range(96):
        _, item = items[k % 10]
        body = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        at = r.randint(0, len(body))
        body[at:at] = rearranged(r, item.split(), hows[k % 6])
        docs.append((k, " ".join(body)))
    want = brute(docs, items)
    assert {hows[d % 6] for d, _ in want} == set(hows) and len(want) > 60
    got = found(spark, docs_of, docs, items)
    print(f"recall {len(want.keys() & got.keys())} of {len(want)}")
    assert got == want


def test_long_texts_and_repeated_shingles(spark, docs_of):
    r = random.Random(4)
    item = " ".join(["la"] * 20 + [f"x{k}" for k in range(20)])
    long = " ".join(f"y{r.randint(0, 5000)}" for _ in range(60_000))
    docs = [(1, f"{long} {item} {long}"), (2, "la " * 3000), (3, long), (3, item), (4, " ".join([f"x{k}" for k in range(20)] + ["la"] * 20))]
    got = found(spark, docs_of, docs, [(1, item), (2, "la " * 40)])
    assert got[1, 1] == 1.0 and got[3, 1] == 1.0 and got[2, 2] == 1.0 and (3, 2) not in got
    assert got.get((4, 1)) == brute(docs[4:], [(1, item)]).get((4, 1))
