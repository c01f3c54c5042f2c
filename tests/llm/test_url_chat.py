import random

from pyspark.sql import functions as F

from chunklake.llm import chat_format as C
from chunklake.llm import url_filter as U
from chunklake.llm.queries import RULES


def judge(spark, rows, listed, rules=RULES):
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS host", "'x' AS key", "1 AS block", "1 AS w0")
    bad = spark.createDataFrame([(u,) for u in listed], "url string").selectExpr("*", "'x' AS key")
    return [tuple(r) for r in U.filter_urls(pages, bad, rules).orderBy("page_id").select("page_id", "host", "path", "rule", "verdict").collect()]


def test_rules(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?q#f"), (2, "http://example.net/enx"), (3, "http://www.example.com/de/"), (4, "http://example.com/DE/"), (5, "http://b.org/fr/1"), (6, "http://notnet/"), (7, "http://x.net"), (8, "http://x.net?/"), (9, None), (10, "no scheme"), (11, "ÀB://ÀB.net/p"), (12, "a://b://c/d"),
    ]
    assert judge(spark, rows, []) == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/enx", "net/", "block"), (3, "www.example.com", "/de/", "example.com/de/", "block"), (4, "example.com", "/DE/", None, "allow"), (5, "b.org", "/fr/1", "org/fr/", "allow"),
        (6, "notnet", "/", None, "allow"), (7, "x.net", "", None, "allow"), (8, "x.net", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "Àb.net", "/p", "net/", "block"), (12, "b:", "//c/d", None, "allow"),
    ]


def test_listed(spark):
    rows = [(1, "https://www.S.com/a/?b=2&utm_x=1&a=1#z"), (2, "http://s.com/a?a=1&b=2"), (3, "http://s.com/a"), (4, "http://S.com/a/b"), (4, "http://S.com/a/b"), (5, None)]
    got = judge(spark, rows, ["http://s.com/a?b=2&a=1", None, "bad", "http://s.com/a/b/", "http://s.com/a/b"])
    assert [(k, v) for k, *_, v in got] == [(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (4, "block"), (5, "allow")]
    assert judge(spark, [], ["http://s.com/"]) == []


def test_no_false_positives_or_negatives(spark):
    r = random.Random(1)
    urls = [f"http://h{r.randint(0, 300)}.com/{r.randint(0, 50)}" for _ in range(5000)]
    listed = set(r.sample(sorted(set(urls)), 900))
    got = judge(spark, list(enumerate(urls)), sorted(listed), [])
    assert all((v == "block") == (urls[k] in listed) for k, *_, v in got)


def test_filter_rejects_most(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 2000 // U.KEYS_PER_BLOCK
    bloom = U.bloom_blocks(keys, "key", blocks)
    other = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key")).withColumn("block", U._block(F.col("key"), blocks)).join(bloom, "block")
    passed = other
    for i, m in enumerate(U._masks(F.col("key"))):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(m) == m)
    assert passed.count() < 200


def t(role, text):
    return {"role": role, "text": text}


def test_preferences(spark):
    u, s = t("user", "hi é😀"), t("system", "s")
    rows = [
        (1, [s, u, t("assistant", "good")], [s, u, t("assistant", "bad"), t("user", "x"), t("assistant", "")]),
        (2, [u], [u]), (3, None, [u]), (4, [], None), (5, [t(None, None), t("assistant", None)], [t(None, None), u]), (5, [u], [t("assistant", "hi é😀")]), (6, [u] * 3, [u] * 2),
    ]
    df = spark.createDataFrame(rows, "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("n", F.lit("clash"))
    got = C.format_preferences(df).collect()
    assert len(got) == len(rows)
    draw = lambda xs: "".join(f"<|{x['role'] or ''}|>\n{x['text'] or ''}<|end|>\n" for x in xs)
    by = {}
    for k, a, b in rows:
        a, b = a or [], b or []
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        by.setdefault(k, []).append((n, draw(a[:n]), draw(a[n:]), draw(b[n:])))
    for r in got:
        assert (r["n_prompt_turns"], r["prompt"], r["chosen_completion"], r["rejected_completion"]) in by[r["pair_id"]]
        for side in ("chosen", "rejected"):
            text = r[f"{side}_completion"]
            cut = [text[x["start"] : x["end"]] for x in r[f"{side}_spans"]]
            assert all(c.endswith("<|end|>\n") for c in cut)
            assert len(cut) == text.count("<|assistant|>\n")
    one = next(r for r in got if r["pair_id"] == 1)
    x = one["chosen_spans"][0]
    assert one["chosen_completion"][x["start"] : x["end"]] == "good<|end|>\n"


def test_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (2, 1, "assistant", "x"), (4, 0, "user", "no reply"), (5, 0, "assistant", "only"), (None, 0, "user", "lost"), (0, 1, "assistant", "a0")]
    got = {r["pair_id"]: r for r in C.preference_pairs(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    texts = lambda k, side: [x["text"] for x in got[k][side]]
    assert set(got) == {0, 1, 2, 4, 5}
    assert texts(0, "chosen") == ["q", "a0", "a0", "more"] and texts(0, "rejected") == ["q", "a0", "a1"]
    assert texts(1, "rejected") == ["p", "a0"] and texts(2, "rejected") == ["alone"] and texts(4, "rejected") == ["no reply", "only"] and texts(5, "rejected") == []
