"""Queries on diffs, status, patches, merges and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_row, cents, content_id, merkle_sql
from ..functions.identity import typed_value
from ..operators import diff, merge, patch, snapshot
from .tables import edited, sql_edited, table

ORDER_FIELDS = ["o_orderstatus", "o_orderpriority", "price"]
_A = "a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice * 100)::bigint AS price FROM orders)"
_B = f"b AS ({sql_edited('a', 'o_orderkey', {'o_orderstatus': chr(39) + 'X' + chr(39), 'o_orderpriority': None, 'price': 'price + 1'})})"


def orders_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", cents(F.col("o_totalprice")).alias("price"))


def orders_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(orders_a(spark, sf_dir), "o_orderkey", {"o_orderstatus": F.lit("X"), "price": F.col("price") + 1})


def keyed_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.keyed_diff(orders_a(spark, sf_dir), orders_b(spark, sf_dir), ["o_orderkey"], ORDER_FIELDS)
    return out.select("o_orderkey", "kind", F.col("a.price").alias("old_price"), F.col("b.price").alias("new_price"))


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed orders by kind."""
    return keyed_diff_orders(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


_DIFF = f"{_A}, {_B}, d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority OR a.price IS DISTINCT FROM b.price THEN 'modified' END AS kind, a.price AS old_price, b.price AS new_price FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"
SQL_KEYED_DIFF = f"WITH {_DIFF} SELECT * FROM d WHERE kind IS NOT NULL"
SQL_DIFF_COUNTS = f"WITH {_DIFF} SELECT kind, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY kind"


def node_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.node_diff(orders_a(spark, sf_dir), orders_b(spark, sf_dir), ["o_orderkey"], ORDER_FIELDS)


_CELLS = " UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS path, {f}::varchar AS v FROM {{t}}" for f in ORDER_FIELDS)
SQL_NODE_DIFF = f"""WITH {_A}, {_B}, ca AS ({_CELLS.format(t='a')}), cb AS ({_CELLS.format(t='b')}),
d AS (SELECT coalesce(ca.o_orderkey, cb.o_orderkey) AS o_orderkey, coalesce(ca.path, cb.path) AS path, CASE WHEN cb.path IS NULL THEN 'removed' WHEN ca.path IS NULL THEN 'added' WHEN ca.v IS DISTINCT FROM cb.v THEN 'modified' END AS kind, ca.v AS old, cb.v AS new FROM ca FULL JOIN cb ON ca.o_orderkey = cb.o_orderkey AND ca.path = cb.path)
SELECT * FROM d WHERE kind IS NOT NULL"""


def type_change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the value in ``events.props``, where some became texts."""
    a = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("v"))
    b = edited(a, "event_id", {"v": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k"), F.col("v"))).otherwise((F.col("v").cast("bigint") + 1).cast("string"))})
    return diff.type_diff(a, b, ["event_id"], "v", typed_value)


SQL_TYPE_CHANGE = f"""WITH a AS (SELECT event_id, props->>'$.k' AS v FROM events),
b AS ({sql_edited('a', 'event_id', {'v': "CASE WHEN event_id % 2 = 0 THEN 'k' || v ELSE (v::bigint + 1)::varchar END"})}),
d AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'removed' WHEN a.event_id IS NULL THEN 'added' WHEN (b.v LIKE 'k%') THEN 'type_changed' WHEN a.v IS DISTINCT FROM b.v THEN 'modified' END AS kind, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.event_id = b.event_id)
SELECT * FROM d WHERE kind IS NOT NULL"""

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, since line items repeat at some scales."""
    return table(spark, sf_dir, "lineitem").groupBy(*LINE_KEY).agg(F.max("l_returnflag").alias("flag"), F.max(cents(F.col("l_extendedprice"))).alias("price"))


_L = "a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag) AS flag, max(round(l_extendedprice * 100)::bigint) AS price FROM lineitem GROUP BY ALL)"
_LB = f"b AS ({sql_edited('a', 'l_orderkey', {'l_linenumber': None, 'l_partkey': None, 'l_suppkey': None, 'flag': chr(39) + 'Z' + chr(39), 'price': None})})"


def where_changed_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lines(spark, sf_dir)
    b = edited(a, "l_orderkey", {"flag": F.lit("Z")})
    return diff.where_changed(a, b, LINE_KEY, ["flag", "price"]).select(*LINE_KEY, F.col("a.flag").alias("old"), F.col("b.flag").alias("new"))


SQL_WHERE_CHANGED = f"WITH {_L}, {_LB} SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.flag AS old, b.flag AS new FROM a JOIN b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE a.flag IS DISTINCT FROM b.flag OR a.price IS DISTINCT FROM b.price"


def block_edit_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight changed lines of each supplier, the reference's cap of edits shown per chunk."""
    return diff.first_per_group(where_changed_inner(spark, sf_dir), ["l_suppkey"], [F.col(k) for k in LINE_KEY], 8)


SQL_BLOCK_EDIT = f"WITH c AS ({SQL_WHERE_CHANGED}) SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM c QUALIFY rn <= 8"


def _files(df: DataFrame) -> DataFrame:
    body = canonical_row([F.col("o_orderstatus"), F.col("price")])
    return snapshot.manifest(df, ["o_orderpriority"], F.col("o_orderkey"), body)


def status_amd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are priorities; one is missing on the new side and one is new."""
    a, b = orders_a(spark, sf_dir), orders_b(spark, sf_dir)
    moved = F.when(F.col("o_orderpriority").startswith("5"), "6-NEW").otherwise(F.col("o_orderpriority"))
    same = F.col("o_orderpriority").startswith("1")
    new = b.where(~same).unionByName(a.where(same)).withColumn("o_orderpriority", moved)
    return diff.status(_files(a), _files(new), "o_orderpriority", "sig")


def _sql_files(table_: str, name: str) -> str:
    entries = f"{name}0 AS (SELECT o_orderpriority, o_orderkey::varchar AS k, sha256(coalesce(o_orderstatus, '~') || '|' || coalesce(price::varchar, '~')) AS s FROM {table_})"
    return f"{entries}, {merkle_sql(f'{name}0', ['o_orderpriority'], name)}"


SQL_STATUS = f"""WITH {_A}, {_B}, n AS (SELECT o_orderkey, o_orderstatus, price, CASE WHEN o_orderpriority LIKE '5%' THEN '6-NEW' ELSE o_orderpriority END AS o_orderpriority FROM (SELECT * FROM b WHERE o_orderpriority NOT LIKE '1%' UNION ALL SELECT * FROM a WHERE o_orderpriority LIKE '1%')),
{_sql_files('a', 'fa')}, {_sql_files('n', 'fb')}
SELECT coalesce(fa.o_orderpriority, fb.o_orderpriority) AS o_orderpriority, CASE WHEN fa.sig IS NULL THEN 'A' WHEN fb.sig IS NULL THEN 'D' ELSE 'M' END AS code FROM fa FULL JOIN fb ON fa.o_orderpriority = fb.o_orderpriority WHERE fa.sig IS DISTINCT FROM fb.sig"""


def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of each supplier's lines, and how many there are."""
    rows = _lines(spark, sf_dir)
    pos = F.concat_ws(",", *(F.col(k).cast("string") for k in LINE_KEY))
    return snapshot.manifest(rows, ["l_suppkey"], pos, canonical_row([F.col("flag"), F.col("price")]))


_MAN = f"e AS (SELECT l_suppkey, concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, sha256(coalesce(flag, '~') || '|' || coalesce(price::varchar, '~')) AS s FROM a), {merkle_sql('e', ['l_suppkey'], 'm')}"
SQL_MANIFEST = f"WITH {_L}, {_MAN} SELECT * FROM m"


def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.tree_hash(manifest_rollup(spark, sf_dir), "l_suppkey")


SQL_TREE = f"WITH {_L}, {_MAN}, f AS (SELECT l_suppkey::varchar AS k, sig AS s FROM m), {merkle_sql('f', [], 't')} SELECT sig AS tree, n AS n_files FROM t"


def verify_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a copy dealt otherwise has the same tree, and whether the edited copy has."""
    a, b = orders_a(spark, sf_dir), orders_b(spark, sf_dir)
    tree = lambda df: snapshot.tree_hash(_files(df), "o_orderpriority").select("tree")
    trees = tree(a).withColumn("k", F.lit("base")).unionByName(tree(a.repartition(7)).withColumn("k", F.lit("copy"))).unionByName(tree(b).withColumn("k", F.lit("edited")))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("tree")))
    return trees.agg((pick("base") == pick("copy")).alias("copy_verifies"), (pick("base") == pick("edited")).alias("edited_verifies"), pick("base").alias("tree"))


SQL_VERIFY = f"""WITH {_A}, {_B}, {_sql_files('a', 'fa')}, {_sql_files('b', 'fb')}, pa AS (SELECT o_orderpriority AS k, sig AS s FROM fa), pb AS (SELECT o_orderpriority AS k, sig AS s FROM fb), {merkle_sql('pa', [], 'ta')}, {merkle_sql('pb', [], 'tb')}
SELECT true AS copy_verifies, ta.sig = tb.sig AS edited_verifies, ta.sig AS tree FROM ta, tb"""


def _ours_theirs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = orders_a(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    ours = edited(base, "o_orderkey", {"o_orderstatus": F.lit("X")})
    theirs = edited(base, "o_orderkey", {"o_orderstatus": F.lit("Y")}, drop=101, change=59, add=None)
    both = F.when(F.col("o_orderkey") % 106 == 0, "W").otherwise(F.col("o_orderstatus"))  # changed on both sides, differently
    return base, ours, theirs.withColumn("o_orderstatus", both)


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.three_way(*_ours_theirs(spark, sf_dir), ["o_orderkey"], "o_orderstatus")
    return rows.select("o_orderkey", "decision", "merged")


_BASE = "base AS (SELECT o_orderkey, o_orderstatus FROM orders)"
_OURS = f"ours AS ({sql_edited('base', 'o_orderkey', {'o_orderstatus': chr(39) + 'X' + chr(39)})})"
_T0 = f"t0 AS ({sql_edited('base', 'o_orderkey', {'o_orderstatus': chr(39) + 'Y' + chr(39)}, 101, 59, None)})"
_THEIRS = f"{_T0}, theirs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 106 = 0 THEN 'W' ELSE o_orderstatus END AS o_orderstatus FROM t0)"
_KEYS = "k AS (SELECT o_orderkey FROM base UNION SELECT o_orderkey FROM ours UNION SELECT o_orderkey FROM theirs)"


def _sql_three(b: str, o: str, t: str) -> str:
    return f"""w AS (SELECT k.o_orderkey, b.o_orderstatus AS b, o.o_orderstatus AS o, t.o_orderstatus AS t, b.o_orderkey IS NOT NULL AS hb, o.o_orderkey IS NOT NULL AS ho, t.o_orderkey IS NOT NULL AS ht FROM k LEFT JOIN {b} b USING (o_orderkey) LEFT JOIN {o} o USING (o_orderkey) LEFT JOIN {t} t USING (o_orderkey)),
m AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t AND ho = ht THEN 'ours' WHEN o IS NOT DISTINCT FROM b AND ho = hb THEN 'theirs' WHEN t IS NOT DISTINCT FROM b AND ht = hb THEN 'ours' ELSE 'conflict' END AS decision FROM w)"""


_THREE = f"WITH {_BASE}, {_OURS}, {_THEIRS}, {_KEYS}, {_sql_three('base', 'ours', 'theirs')}"
SQL_THREE_WAY = f"{_THREE} SELECT o_orderkey, decision, CASE decision WHEN 'ours' THEN o WHEN 'theirs' THEN t END AS merged FROM m"


def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(*_ours_theirs(spark, sf_dir), ["o_orderkey"], "o_orderstatus")[1]


SQL_CONFLICTS = f"{_THREE} SELECT o_orderkey, b AS base, o AS ours, t AS theirs FROM m WHERE decision = 'conflict'"


def cherry_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What theirs changed, on top of ours; conflicts leave the row out."""
    base, ours, theirs = _ours_theirs(spark, sf_dir)
    return merge.cherry_pick(base, theirs, ours, ["o_orderkey"], "o_orderstatus")[0]


SQL_CHERRY = f"{_THREE} SELECT o_orderkey, CASE decision WHEN 'ours' THEN o ELSE t END AS o_orderstatus FROM m WHERE decision = 'ours' AND ho OR decision = 'theirs' AND ht"


def revert_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ours changed undone on top of theirs."""
    base, ours, theirs = _ours_theirs(spark, sf_dir)
    return merge.revert(base, ours, theirs, ["o_orderkey"], "o_orderstatus")[0]


SQL_REVERT = f"WITH {_BASE}, {_OURS}, {_THEIRS}, {_KEYS}, {_sql_three('ours', 'theirs', 'base')} SELECT o_orderkey, CASE decision WHEN 'ours' THEN o ELSE t END AS o_orderstatus FROM m WHERE decision = 'ours' AND ho OR decision = 'theirs' AND ht"

CUSTOMER = ["c_mktsegment", "balance"]


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", cents(F.col("c_acctbal")).alias("balance"))
    return a, edited(a, "c_custkey", {"balance": F.col("balance") + 7})


_CA = "a AS (SELECT c_custkey, c_mktsegment, round(c_acctbal * 100)::bigint AS balance FROM customer)"
_CB = f"b AS ({sql_edited('a', 'c_custkey', {'c_mktsegment': None, 'balance': 'balance + 7'})})"


def patch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = patch.extract(*_customers(spark, sf_dir), ["c_custkey"], CUSTOMER)
    return ops.select("c_custkey", "status", F.col("base.balance").alias("base"), F.col("value.balance").alias("value"))


SQL_EXTRACT = f"WITH {_CA}, {_CB} SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.c_custkey IS NULL THEN 'added' ELSE 'modified' END AS status, a.balance AS base, b.balance AS value FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.balance IS DISTINCT FROM b.balance OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"


def patch_apply_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _customers(spark, sf_dir)
    return patch.apply(a, patch.extract(a, b, ["c_custkey"], CUSTOMER), ["c_custkey"], CUSTOMER)


SQL_FORWARD = f"WITH {_CA}, {_CB} SELECT c_custkey, c_mktsegment, balance FROM b"


def patch_apply_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _customers(spark, sf_dir)
    return patch.apply(b, patch.reverse(patch.extract(a, b, ["c_custkey"], CUSTOMER)), ["c_custkey"], CUSTOMER)


SQL_REVERSE = f"WITH {_CA} SELECT c_custkey, c_mktsegment, balance FROM a"


def patch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch from a to b against a table whose balances were changed elsewhere."""
    a, b = _customers(spark, sf_dir)
    other = edited(a, "c_custkey", {"balance": F.col("balance") - 3}, drop=103, change=3, add=None)
    bad = patch.conflicts(other, patch.extract(a, b, ["c_custkey"], CUSTOMER), ["c_custkey"], CUSTOMER)
    return bad.select("c_custkey", "status", F.col("base.balance").alias("base"), F.col("now.balance").alias("now"))


_OPS = SQL_EXTRACT[SQL_EXTRACT.index("SELECT coalesce") :]
_OTHER = f"other AS ({sql_edited('a', 'c_custkey', {'c_mktsegment': None, 'balance': 'balance - 3'}, 103, 3, None)})"
SQL_PATCH_CONFLICTS = f"WITH {_CA}, {_CB}, {_OTHER}, ops AS ({_OPS}) SELECT ops.c_custkey, status, base, other.balance AS now FROM ops LEFT JOIN other ON ops.c_custkey = other.c_custkey WHERE CASE WHEN status = 'added' THEN other.c_custkey IS NOT NULL ELSE other.c_custkey IS NULL OR other.balance <> base END"


def list_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of lines; identity is the part, which some orders repeat, so these go by position."""
    rows = _lines(spark, sf_dir)
    a = rows.select("l_orderkey", F.col("l_partkey").cast("string").alias("ident"), F.concat_ws(".", *(F.col(k).cast("string") for k in LINE_KEY[1:])).alias("at"), "flag")
    b = edited(a, "l_orderkey", {"flag": F.lit("Z")}, drop=97, change=53, add=None)
    return diff.align_lists(a, b, ["l_orderkey"], "ident", "at", "flag")


SQL_LIST_ALIGN = f"""WITH {_L}, sa AS (SELECT l_orderkey, l_partkey::varchar AS ident, concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS pos, flag FROM a),
sb AS ({sql_edited('sa', 'l_orderkey', {'ident': None, 'pos': None, 'flag': chr(39) + 'Z' + chr(39)}, add=None)}),
u AS (SELECT 'a' AS side, * FROM sa UNION ALL SELECT 'b', * FROM sb),
g AS (SELECT l_orderkey, count(DISTINCT side) = 2 AND count(*) = count(DISTINCT (side, ident)) AS keyed FROM u GROUP BY 1),
s AS (SELECT u.*, g.keyed, CASE WHEN g.keyed THEN 'id:' || ident ELSE '[' || pos || ']' END AS slot FROM u JOIN g USING (l_orderkey)),
x AS (SELECT l_orderkey, keyed, slot, bool_or(side = 'a') AS ha, bool_or(side = 'b') AS hb, max(CASE WHEN side = 'a' THEN flag END) AS old, max(CASE WHEN side = 'b' THEN flag END) AS new FROM s GROUP BY ALL)
SELECT l_orderkey, keyed, slot, CASE WHEN NOT hb THEN 'removed' WHEN NOT ha THEN 'added' ELSE 'modified' END AS kind, old, new FROM x WHERE NOT ha OR NOT hb OR old IS DISTINCT FROM new"""


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.objects(table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null"), "text", "doc_id").select("id", "first_key", "n")


SQL_DEDUP = "SELECT sha256(text) AS id, min(doc_id) AS first_key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"


def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = snapshot.objects(table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null"), "text", "doc_id")
    return o.agg(F.sum(F.col("n") * F.col("raw_len")).alias("raw"), F.sum("raw_len").cast("bigint").alias("stored"), F.sum("n").alias("n_docs"), F.count("*").alias("n_objects"))


SQL_DEDUP_RATIO = "WITH o AS (SELECT sha256(text) AS id, count(*) AS n, max(strlen(text)) AS raw_len FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT sum(n * raw_len)::bigint AS raw, sum(raw_len)::bigint AS stored, sum(n)::bigint AS n_docs, count(*) AS n_objects FROM o"


def objects_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label."""
    return snapshot.missing(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


def objects_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.present(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


SQL_MISSING = "SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
SQL_PRESENT = "SELECT DISTINCT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def cache_hit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first commit fills the cache, the second looks its payloads up: hits and misses by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", content_id(F.col("text")).alias("id"))
    out = snapshot.cache_lookup(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "id")
    return out.groupBy("source").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


SQL_CACHE = "WITH d AS (SELECT doc_id, source, sha256(text) AS id FROM documents), c AS (SELECT DISTINCT id FROM d WHERE doc_id % 2 = 0) SELECT source, count(c.id) AS hits, count(*) - count(c.id) AS misses FROM d LEFT JOIN c ON c.id = d.id WHERE doc_id % 2 = 1 GROUP BY source"

def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two columns as one text, with signs of its own and nulls among the values."""
    sign = F.element_at(F.array(*map(F.lit, ["|", "~", "\\", "a|b", ""])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    a = F.when(F.col("o_orderkey") % 7 != 0, F.concat(sign, F.lit("x"), sign))
    b = F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderstatus", sign))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", canonical_row([a, b]).alias("pos"))


SQL_ROW_KEYS = r"""WITH s AS (SELECT o_orderkey, o_orderstatus, ['|', '~', '\', 'a|b', ''][(o_orderkey % 5 + 1)::int] AS sign FROM orders),
v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN sign || 'x' || sign END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || sign END AS b FROM s)
SELECT o_orderkey, coalesce(regexp_replace(a, '([\\|~])', '\\\1', 'g'), '~') || '|' || coalesce(regexp_replace(b, '([\\|~])', '\\\1', 'g'), '~') AS pos FROM v"""


QUERIES = {
    "row_keys": (row_keys, SQL_ROW_KEYS),
    "keyed_diff_orders": (keyed_diff_orders, SQL_KEYED_DIFF),
    "diff_counts": (diff_counts, SQL_DIFF_COUNTS),
    "node_diff_orders": (node_diff_orders, SQL_NODE_DIFF),
    "type_change_diff": (type_change_diff, SQL_TYPE_CHANGE),
    "where_changed_inner": (where_changed_inner, SQL_WHERE_CHANGED),
    "block_edit_topn": (block_edit_topn, SQL_BLOCK_EDIT),
    "status_amd": (status_amd, SQL_STATUS),
    "manifest_rollup": (manifest_rollup, SQL_MANIFEST),
    "tree_hash": (tree_hash, SQL_TREE),
    "verify_tree": (verify_tree, SQL_VERIFY),
    "three_way_merge": (three_way_merge, SQL_THREE_WAY),
    "merge_conflicts": (merge_conflicts, SQL_CONFLICTS),
    "cherry_pick": (cherry_pick, SQL_CHERRY),
    "revert_change": (revert_change, SQL_REVERT),
    "patch_extract": (patch_extract, SQL_EXTRACT),
    "patch_apply_forward": (patch_apply_forward, SQL_FORWARD),
    "patch_apply_reverse": (patch_apply_reverse, SQL_REVERSE),
    "patch_conflicts": (patch_conflicts, SQL_PATCH_CONFLICTS),
    "list_align": (list_align, SQL_LIST_ALIGN),
    "dedup_documents": (dedup_documents, SQL_DEDUP),
    "dedup_ratio": (dedup_ratio, SQL_DEDUP_RATIO),
    "objects_missing": (objects_missing, SQL_MISSING),
    "objects_present": (objects_present, SQL_PRESENT),
    "cache_hit_join": (cache_hit_join, SQL_CACHE),
}
