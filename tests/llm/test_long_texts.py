"""Very long texts through the operators and the pipeline's stages."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F


def long_docs(spark, n=6, words=40_000):
    r = random.Random(1)
    rows = [(k, " ".join(f"w{r.randint(0, 4000)}" + ("." if r.random() < 0.08 else "") for _ in range(words)), "en", "s", 0) for k in range(n)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "x" * 300_000, "en", "s", 0), (102, "\n" * 50_000, "en", "s", 0), (103, "", "en", "s", 0), (104, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_operators(spark):
    from chunklake.llm import chat_format, simhash_dedup, url_filter

    docs = long_docs(spark)
    root = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert root[100] == 0 and root[103] == root[104] == 102 and len(set(root.values())) == 8
    urls = spark.createDataFrame([(1, "http://a.example/" + "p" * 200_000 + "?utm_x=1"), (2, "https://www.a.example/" + "p" * 200_000), (3, "x" * 200_000)], "page_id bigint, url string")
    got = {r["page_id"]: (r["verdict"], len(r["path"])) for r in url_filter.filter_urls(urls, urls.where("page_id = 2"), []).collect()}
    assert got == {1: ("block", 200_001), 2: ("block", 200_001), 3: ("allow", 0)}
    turns = [(k, i, role, text) for k in (2, 3) for i, (role, text) in enumerate([("user", "q " * 100_000), ("assistant", f"a{k} " * 100_000)])]
    pairs = chat_format.format_preferences(chat_format.preference_pairs(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string"))).collect()
    assert len(pairs) == 2 and all(p["n_prompt_turns"] == 1 and len(p["prompt"]) > 200_000 for p in pairs)


def test_stages(spark, sf_dir):
    docs = long_docs(spark)
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
    left = {r["doc_id"]: r["n"] for r in kept.select("doc_id", F.char_length("text").alias("n")).collect()}
    assert {0, 1, 2, 3, 4, 5, 101} <= left.keys() and 100 not in left and left[101] == 300_000
    coded = P.STAGES[-1][1](spark, kept.where("doc_id = 101 or doc_id = 1"), sf_dir).collect()
    assert all(r["decoded_chars"] == left[r["doc_id"]] for r in coded)
