import duckdb
import pytest

from chunklake.llm.queries import ORACLES, QUERIES
from tests.test_catalog import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    compare(QUERIES[name](spark, folder), con, ORACLES[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        after = kept.count()
        assert 0 < after <= before, name
        before = after
    out = P.run(spark, sf_dir)
    rows = {r["doc_id"]: r for r in out.collect()}
    want = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert rows.keys() == want.keys() and len(rows) == before
    import hashlib

    for k, r in rows.items():
        assert r["decoded_sha256"] == hashlib.sha256((want[k] or "").replace("▁", " ").encode()).hexdigest()


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}


def test_stages_keep_other_columns(spark, sf_dir):
    """Extra columns with names that the operators use come through as they are, nulls included."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    names = ["severity", "p_toxic", "n_removed", "__rn", "__gone", "__id", "__lines", "__judged", "fp", "words", "id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(spark.createDataFrame([(None, "lost", None, None, None), (9_001, None, None, None, None), (9_001, None, None, None, None)], docs.schema))
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1))) for n in names})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names), name
        assert any(r["doc_id"] is None for r in rows), name
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name
