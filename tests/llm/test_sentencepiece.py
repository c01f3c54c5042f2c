import random

import numpy as np
import pytest

from chunklake.llm import sentencepiece_codec as C
from chunklake.llm.queries import PIECE_MODEL, TOKENIZERS

MODEL = f"{TOKENIZERS}/{PIECE_MODEL}"
ODD = [None, "", "   ", " Hello  world ", "a\nb\tc", "▁x", "é́ ﬁ Ｆ", "日本語😀\U0001f9ff\0x", "<s> </s> <unk> <0x0A>", "x" * 3000, " " * 100 + "a" + " " * 37, "0123 4567", "    def f(x):\n        return x  # 1\n\n\n", "the" * 500]


@pytest.fixture(scope="module")
def pieces():
    return C.load_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(seed, n=150):
    r = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz      éñü\n.,()<>▁日本0123")
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 300))) for _ in range(n)]


@pytest.mark.parametrize("index, together", [(400_000, 200), (50, 20), (64, 0)])
def test_equals_the_library(pieces, library, monkeypatch, index, together):
    monkeypatch.setattr(C, "INDEX_CHARS", index)
    monkeypatch.setattr(C, "LONGEST_TOGETHER", together)
    codec = C.Codec(pieces)
    all_texts = ODD + texts(index)
    for t, ids in zip(all_texts, codec.encode(all_texts), strict=True):
        got = np.frombuffer(ids, np.int32)
        want = library.encode(t or "")
        assert got.tolist() == want
        assert codec.decode(got) == library.decode(want)


def test_small_tables_of_decisions(pieces, library, monkeypatch):
    monkeypatch.setattr(C, "DECISIONS", 64)
    monkeypatch.setattr(C, "REMEMBERED", 5)
    codec = C.Codec(pieces)
    for k in range(3):
        t = texts(k, 40)
        assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(t)] == library.encode(t)


def test_pieces_with_ambiguous_merges():
    """A toy model where the best score, not the longest piece, decides."""
    names = ["<unk>", *"▁abc", "bc", "ab", "abc", "▁a"]
    p = C.Pieces(names, [0.0, *[-9.0] * 4, -1.0, -2.0, -3.0, -4.0], "u" + "n" * 8, 0)
    codec = p.codec
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        parts = list("▁" + t.replace(" ", "▁"))
        while True:
            pairs = [(-p.scores[names.index(x + y)], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in names]
            if not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert [names[i] for i in np.frombuffer(codec.encode([t])[0], np.int32)] == parts
    assert codec.p.pieces[np.frombuffer(codec.encode(["d"])[0], np.int32)[-1]] == "<unk>"


def test_in_spark(spark, docs_of, pieces, library):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "x")]
    out = C.encode(docs_of(rows, extra=True), pieces, decoded="back").collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["token_ids"]), r["back"]) for r in out) == sorted((k if k is not None else -1, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for k, t in rows)
    again = C.decode(C.encode(docs_of(rows), pieces), pieces).collect()
    assert sorted(r["decoded"] for r in again) == sorted(library.decode(library.encode(t or "")) for _, t in rows)
    assert C.encode(docs_of([]), pieces).count() == 0


def test_whole_table(spark, sf_dir, library):
    from chunklake.llm.queries import QUERIES

    texts_ = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts_)
    for r in rows:
        assert r["token_ids"] == library.encode(texts_[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"])
