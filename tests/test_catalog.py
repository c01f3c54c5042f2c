import datetime
from collections import Counter

import duckdb
import pytest

from chunklake import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(map(repr, (plain(r[c]) for c in cols))) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(repr(plain(r[names.index(c)])) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert {r["kind"] for r in __spark_entry__.entry(spark).collect()} == {"added", "removed", "modified"}
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark, sf_dir):
    plan = QUERIES["inspect_point"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,42)]" in plan and "l_comment" not in plan
    plan = QUERIES["dedup_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan
