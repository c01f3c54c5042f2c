from chunklake.functions import sql
from chunklake.sources import nbt as N
from chunklake.sources import region as R
from tests.worlds import compound, i, lst, s


def test_functions(spark):
    sql.register(spark)
    tree = compound(a=i(1), l=lst(compound(id=s("x"), v=(N.DOUBLE, 2.5))), b=(N.INTS, [1, 2]))
    rows = [(1, bytearray(R.deflate(R.ZLIB, N.write(tree))), 2), (2, bytearray(b"junk"), 2), (3, None, None)]
    spark.createDataFrame(rows, "k int, payload binary, comp int").createOrReplaceTempView("t")
    got = {r["k"]: r for r in spark.sql("SELECT k, nbt_json(payload, comp) AS j, nbt_get(payload, comp, 'l[id:x].v') AS g, sha2(nbt_canonical(payload, comp), 256) AS c FROM t").collect()}
    assert N.from_json(got[1]["j"]) == tree and got[1]["g"] == '{"double":"2.5"}' and got[1]["c"] == N.object_id(N.canonical(tree))
    assert got[2]["j"] is got[2]["g"] is got[3]["j"] is None
    nodes = spark.sql("SELECT k, n.* FROM t, LATERAL nbt_nodes(payload, comp) n").collect()
    assert {(r["path"], r["parent"], r["key"], r["idx"], r["ident"], r["depth"], r["tag"]) for r in nodes} == {
        ("", None, None, None, None, 0, 10), ("a", "", "a", None, None, 1, 3), ("l", "", "l", None, None, 1, 9), ("l[0]", "l", None, 0, "id:x", 2, 10), ("l[0].id", "l[0]", "id", None, None, 3, 8), ("l[0].v", "l[0]", "v", None, None, 3, 6), ("b", "", "b", None, None, 1, 11),
    }
    by = {r["path"]: r for r in nodes}
    assert by["a"]["i64"] == 1 and by["l[0].v"]["f64"] == 2.5 and by["l[0].id"]["str"] == "x" and by["b"]["ints"] == [1, 2]
