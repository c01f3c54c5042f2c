import collections
import math
import random

import pytest

from chunklake.llm import lm_score as L


def brute(texts, order, factor=0.4, held_out=True):
    toks = [(t or "").lower().encode().split() for t in texts]
    grams_of = lambda w: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = collections.Counter()
    for w in toks:
        every.update(grams_of(w))
    out = []
    for w in toks:
        own = grams_of(w) if held_out else {}
        total = sum(map(len, toks)) - (len(w) if held_out else 0)
        count = lambda g: every[g] - own.get(g, 0)  # noqa: B023, E731

        def s(gram):
            if len(gram) == 1:
                return max(count(gram), 1) / max(total, 1)  # noqa: B023
            return count(gram) / count(gram[:-1]) if count(gram) else factor * s(gram[1:])  # noqa: B023

        out.append((len(w), sum(math.log10(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order, blocks, parts", [(1, 10**9, 10**9), (2, 200, 20), (3, 300, 15), (4, 100, 10**9)])
def test_equals_brute_force(docs_of, monkeypatch, order, blocks, parts):
    monkeypatch.setattr(L, "BLOCK_CHARS", blocks)
    monkeypatch.setattr(L, "PARTITION_GRAMS", parts)
    r = random.Random(order)
    texts = [" ".join(r.choice("aabbcdeé") * r.randint(1, 2) for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "", " \n", "A", "A", "x\u00a0y z"]
    for held_out in (True, False):
        got = {x["doc_id"]: x for x in L.score_documents(docs_of(list(enumerate(texts)), extra=True), order=order, held_out=held_out).collect()}
        for k, (n, score) in enumerate(brute(texts, order, held_out=held_out)):
            assert got[k]["n_words"] == n and got[k]["log10_score"] == pytest.approx(score, abs=1e-9)
            assert got[k]["mean_log10"] == (pytest.approx(score / n) if n else None)


def test_edges(docs_of):
    assert L.score_documents(docs_of([])).count() == 0
    assert [tuple(r) for r in L.score_documents(docs_of([(1, None)])).collect()] == [(1, 0, 0.0, None)]
    rows = L.score_documents(docs_of([(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert len(rows) == 3 and {r["n_words"] for r in rows} == {2, 1}
    assert L.score_documents(docs_of([(1, "w " * 200_000)])).first()["n_words"] == 200_000


def test_trigram_contexts_count(spark, docs_of, tmp_path):
    """The query tells texts apart that a bigram model scores alike."""
    from chunklake.llm.queries import QUERIES

    texts = ["a b c", "a b c", "d b e", "d b e", "a b e", "d b c"]
    docs_of(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log10_score"] for r in QUERIES["op6_lm_score"](spark, str(tmp_path)).collect()}
    for k, (_, score) in enumerate(brute(texts, 3)):
        assert got[k] == pytest.approx(score, abs=1e-4)
    assert abs(got[0] - got[4]) > 0.1 and L.ORDER == 3


@pytest.mark.parametrize("n", [1, 5, 70_000])
def test_packing_loses_nothing(n):
    x = L.np.unique(L.np.random.default_rng(n).integers(0, 2**64, n, L.np.uint64))
    assert (L._unpacked_sorted(L._packed_sorted(x)) == x).all() and (L._unpacked(L._packed(x), L.np.uint64) == x).all()


def test_texts_that_occur_twice_score_apart(docs_of):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, r.choice([20, 300, 3000]))}"
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(texts + texts[:30]))
    got = {x["doc_id"]: x["mean_log10"] for x in L.score_documents(docs_of(rows)).collect()}
    assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 300))


def test_repeated_rows_are_scored_each(docs_of):
    rows = [(1, "the same text again")] * 50 + [(2, "another text")]
    got = L.score_documents(docs_of(rows).repartition(5)).collect()
    assert len(got) == 51 and len({r["log10_score"] for r in got if r["doc_id"] == 1}) == 1
