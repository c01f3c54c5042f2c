import random

from chunklake.llm import line_dedup as L


def brute(rows):
    seen, gone = set(), {}
    for k, t in sorted((k, t) for k, t in rows if k is not None and t is not None):
        solid = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        for a in zip(solid, solid[1:], solid[2:], strict=False):
            w = tuple(x for _, x in a)
            if w in seen:
                gone.setdefault(k, set()).update(i for i, _ in a)
            seen.add(w)
    return sorted((k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())), len(gone.get(k, ()))) for k, t in rows if k is not None)


def check(docs_of, rows):
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in L.dedup_lines(docs_of(rows)).where("doc_id is not null").collect())
    assert [tuple(x) for x in got] == brute(rows)


def test_windows_overlap_and_merge(docs_of):
    check(docs_of, [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, "a\n\nb\n \nc\nz"), (5, "q\nq\nq\nq\nq")])


def test_random_texts(docs_of):
    r = random.Random(5)
    check(docs_of, [(k, "\n".join(r.choice(["", "a", "b", " a ", "c", "d d"]) for _ in range(r.randint(0, 25)))) for k in range(60)])


def test_edges(spark, docs_of):
    check(docs_of, [(1, None), (2, ""), (3, "one"), (4, "\n\n\n"), (5, "a\nb\nc"), (6, "a\nb\nc")])
    assert L.dedup_lines(docs_of([])).count() == 0
    out = L.dedup_lines(docs_of([(None, "a\nb\nc"), (None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc")], extra=True))
    assert out.where("doc_id is null and text = 'a\nb\nc'").count() == 2 and out.count() == 4 and "fp" in out.columns
    long = "\n".join(f"line {k}" for k in range(20_000))
    got = L.dedup_lines(docs_of([(1, long), (2, "x\n" + long)])).where("doc_id = 2").first()
    assert got["text"] == "x" and got["n_removed"] == 20_000


def test_passages_inside_lines(spark, docs_of):
    """The pipeline's stage finds a passage in lines that are broken elsewhere, and repeated short texts."""
    import corpus_pipeline as P

    long = "word " * 49 + "last"
    rows = [(1, "A b. C d. E f. G h.\nI j."), (2, "x. C d.\nE f. G h. y.\n\nz."), (3, "only this"), (4, "only this"), (5, f"n1.\n{long}\nn2."), (6, f"{long}\nn3.")]
    rows += [(7, "q. A b. r. C d. s."), (8, "two. lines"), (9, "two.  lines "), (10, None), (11, "你好。再见。谢谢。一"), (12, "二。你好。再见。谢谢。")]
    got = {x["doc_id"]: x["text"] for x in P.strip_repeated_lines(spark, docs_of(rows).selectExpr("*", "0L AS n_chars"), None).collect()}
    want = dict(rows) | {2: "x. \ny.\n\nz.", 6: "n3.", 12: "二。"}
    for k in (4, 9):
        del want[k]
    assert got == want
