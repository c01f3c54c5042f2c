"""Queries on the commit graph, logs, batches and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import passes_since_until, safe_ref_name
from ..operators import dag, sequence, snapshot
from .tables import EDGES, commit_edges, table


def _starts(spark: SparkSession, sf_dir: str, n: int, step: int = 97) -> DataFrame:
    """The latest commit and others ``step`` apart before it."""
    top = table(spark, sf_dir, "orders", "o_orderkey").agg(F.max("o_orderkey").alias("m"))
    return top.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("m") - i * step)).alias("start"))


def _closure(starts: str) -> str:
    return f"WITH RECURSIVE {EDGES}, s AS ({starts}), walk AS (SELECT start, start AS node FROM s UNION SELECT w.start, e.parent FROM walk w JOIN edges e ON e.child = w.node)"


def _sql_starts(n: int, step: int = 97) -> str:
    return f"SELECT (SELECT max(o_orderkey) FROM orders) - range * {step} AS start FROM range({n})"


def first_parent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of first parents (key div 2) from the latest commit."""
    k = table(spark, sf_dir, "orders", "o_orderkey")
    edges = k.where("o_orderkey > 0").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent"), F.lit(0).alias("ord"))
    return dag.first_parents(k.agg(F.max("o_orderkey").alias("start")), edges)


SQL_FIRST_PARENT = "WITH RECURSIVE chain AS (SELECT max(o_orderkey) AS node, 0 AS step FROM orders UNION ALL SELECT node // 2, step + 1 FROM chain WHERE node > 0) SELECT node, step FROM chain"


def ancestors_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.ancestors(_starts(spark, sf_dir, 5), commit_edges(spark, sf_dir)).select("start", "node")


SQL_ANCESTORS = f"{_closure(_sql_starts(5))} SELECT start, node FROM walk"


def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.merge_base(_starts(spark, sf_dir, 2, 1003), commit_edges(spark, sf_dir))


SQL_MERGE_BASE = f"{_closure(_sql_starts(2, 1003))}, common AS (SELECT node FROM walk GROUP BY 1 HAVING count(DISTINCT start) = 2), best AS (SELECT node FROM common WHERE node NOT IN (SELECT e.parent FROM edges e JOIN common c ON c.node = e.child)) SELECT min(node) AS merge_base, count(*) AS n_bases FROM best"


def bisect_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest commit is bad, its key div 16 good, a quarter of it skipped."""
    bad = _starts(spark, sf_dir, 1)
    good = bad.select(F.expr("start div 16").alias("start"))
    skipped = bad.select(F.expr("start div 4").alias("node"))
    return dag.bisect_step(bad, good, skipped, commit_edges(spark, sf_dir))


SQL_BISECT = f"""WITH RECURSIVE {EDGES}, top AS (SELECT max(o_orderkey) AS t FROM orders),
bad AS (SELECT t AS node FROM top UNION SELECT e.parent FROM bad b JOIN edges e ON e.child = b.node), good AS (SELECT t // 16 AS node FROM top UNION SELECT e.parent FROM good g JOIN edges e ON e.child = g.node),
sus AS (SELECT node FROM bad EXCEPT SELECT node FROM good), inner_ AS (SELECT * FROM edges WHERE child IN (SELECT node FROM sus) AND parent IN (SELECT node FROM sus)),
reach AS (SELECT node AS start, node FROM sus UNION SELECT r.start, i.parent FROM reach r JOIN inner_ i ON i.child = r.node),
cnt AS (SELECT start AS node, count(*) AS n FROM reach GROUP BY 1), free AS (SELECT node, least(n, (SELECT count(*) FROM sus) - n) AS score FROM cnt, top WHERE node <> t AND node <> t // 4)
SELECT CASE WHEN (SELECT count(*) FROM free) > 0 THEN 'step' WHEN (SELECT count(*) FROM sus, top WHERE node <> t) > 0 THEN 'inconclusive' ELSE 'done' END AS state, coalesce((SELECT node FROM free ORDER BY score DESC, node LIMIT 1), t) AS commit, (SELECT count(*) FROM free) AS remaining FROM top"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves: each commit's lines, named by part."""
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")


def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that the tips reach."""
    commits = dag.ancestors(_starts(spark, sf_dir, 3), commit_edges(spark, sf_dir)).select(F.col("node").alias("l_orderkey")).distinct()
    return _objects(spark, sf_dir).join(commits, "l_orderkey", "left_semi").select("l_partkey").distinct()


_REACH = f"{_closure(_sql_starts(3))}, r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT node FROM walk))"
SQL_REACHABLE = f"{_REACH} SELECT l_partkey FROM r"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store lost the parts that 41 divides; a part is sound unless 43 divides it."""
    return table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 41 <> 0").withColumnRenamed("p_partkey", "l_partkey")


def fsck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.fsck(_store(spark, sf_dir), reachable_objects(spark, sf_dir), "l_partkey", F.col("l_partkey") % 43 != 0)


_STORE = "st AS (SELECT p_partkey AS l_partkey FROM part WHERE p_partkey % 41 <> 0)"
SQL_FSCK = f"{_REACH}, {_STORE} SELECT (SELECT count(*) FROM st) AS checked, (SELECT count(*) FROM st WHERE l_partkey % 43 = 0) AS corrupt, (SELECT count(*) FROM r WHERE l_partkey NOT IN (SELECT l_partkey FROM st)) AS missing, (SELECT count(*) FROM st WHERE l_partkey NOT IN (SELECT l_partkey FROM r)) AS unreachable"


def gc_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.gc(_store(spark, sf_dir), reachable_objects(spark, sf_dir), "l_partkey")


SQL_GC = f"{_REACH}, {_STORE} SELECT count(*) FILTER (l_partkey IN (SELECT l_partkey FROM r)) AS kept, count(*) FILTER (l_partkey NOT IN (SELECT l_partkey FROM r)) AS pruned FROM st"


def verify_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, commits they reach, objects of these, and how many the store lacks or holds damaged."""
    tips = _starts(spark, sf_dir, 3)
    commits = dag.ancestors(tips, commit_edges(spark, sf_dir)).select("node").distinct()
    wanted = _objects(spark, sf_dir).join(commits, F.col("l_orderkey") == F.col("node"), "left_semi").select("l_partkey").distinct()
    held = _store(spark, sf_dir).withColumn("held", F.lit(True))
    counts = wanted.join(held, "l_partkey", "left").agg(F.count("*").alias("objects"), F.count(F.when(F.col("held").isNull(), 1)).alias("missing"), F.count(F.when(F.col("held") & (F.col("l_partkey") % 43 == 0), 1)).alias("corrupt"))
    return counts.withColumns({"commits": F.lit(commits.count()), "branches": F.lit(tips.count())})


SQL_VERIFY_REMOTE = f"{_REACH}, {_STORE} SELECT 3 AS branches, (SELECT count(DISTINCT node) FROM walk) AS commits, count(*) AS objects, count(*) FILTER (l_partkey % 41 = 0 OR l_partkey NOT IN (SELECT l_partkey FROM st)) AS missing, count(*) FILTER (l_partkey % 43 = 0 AND l_partkey IN (SELECT l_partkey FROM st)) AS corrupt FROM r"


def shallow_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.shallow_boundary(_starts(spark, sf_dir, 2), commit_edges(spark, sf_dir), 3)


SQL_SHALLOW = f"WITH RECURSIVE {EDGES}, s AS ({_sql_starts(2)}), walk AS (SELECT start AS node, 0 AS depth FROM s UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node WHERE w.depth < 3), m AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1) SELECT node, depth FROM m WHERE depth = 3 AND node IN (SELECT child FROM edges)"


def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as log entries: author and message contain texts, times that can't be read pass."""
    rows = table(spark, sf_dir, "conversations").withColumn("time", F.when(F.col("conv_id") % 5 == 0, "unknown").otherwise((F.col("turn") * 100).cast("string")))
    kept = F.col("role").contains("assist") & F.col("text").contains("th") & passes_since_until(F.col("time"), 100, 300)
    return rows.where(kept).select("conv_id", "turn", "time")


SQL_LOG = "WITH r AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'unknown' ELSE (turn * 100)::varchar END AS time FROM conversations) SELECT conv_id, turn, time FROM r WHERE contains(role, 'assist') AND contains(text, 'th') AND coalesce(try_cast(time AS bigint) >= 100, true) AND coalesce(try_cast(time AS bigint) <= 300, true)"


def reflog_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth most recent event of each user."""
    log = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return sequence.nth_latest(log, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "event_type")


SQL_REFLOG = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 4"


def fetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fixed_batches(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 256)


def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's bytes begin in one pack."""
    return sequence.running(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", F.col("n_chars"), "pack_offset")


def sector_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sector of each document in a region file: 4 KiB sectors after a header of two."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = d.select("doc_id", F.ceil((F.octet_length(F.coalesce("text", F.lit(""))) + 5) / 4096).alias("sectors"))
    return sequence.running(rows, "doc_id", F.col("sectors"), "before").select("doc_id", "sectors", (F.col("before") + 2).alias("sector"))


SQL_OFFSETS = "SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pack_offset FROM documents"
SQL_SECTORS = "WITH s AS (SELECT doc_id, ceil((strlen(coalesce(text, '')) + 5) / 4096.0)::bigint AS sectors FROM documents) SELECT doc_id, sectors, 2 + coalesce(sum(sectors) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS sector FROM s"


def push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 50,000 characters, each source's list by itself."""
    return sequence.greedy_batches(table(spark, sf_dir, "documents", "source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 50_000)


SQL_PUSH = """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, rn, 0::bigint AS batch, CASE WHEN n_chars >= 50000 THEN 0 ELSE n_chars END AS acc, (CASE WHEN n_chars >= 50000 THEN 1 ELSE 0 END)::bigint AS nxt FROM d WHERE rn = 1
UNION ALL SELECT d.source, d.doc_id, d.rn, f.nxt, CASE WHEN f.acc + d.n_chars >= 50000 THEN 0 ELSE f.acc + d.n_chars END, f.nxt + CASE WHEN f.acc + d.n_chars >= 50000 THEN 1 ELSE 0 END FROM f JOIN d ON d.source = f.source AND d.rn = f.rn + 1)
SELECT source, doc_id, batch FROM f"""


def suspects_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in either half but not in both."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    a, b = (o.where(F.col("o_orderkey") % 2 == k).select("o_custkey") for k in (0, 1))
    return a.union(b).distinct().subtract(a.intersect(b))


SQL_SUSPECTS = "WITH a AS (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) (SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b)"


def last_known_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ref's last value in its log."""
    log = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return log.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


def ref_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of urls, with and without what a ref must not hold."""
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a..b"), F.col("page_id"))).otherwise(F.concat(F.lit("heads/"), F.col("page_id")))
    return table(spark, sf_dir, "pages", "page_id").select("page_id", name.alias("name")).select("page_id", "name", safe_ref_name(F.col("name")).alias("safe"))


def change_feed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour, as the streaming feed counts them."""
    from ..streaming.feed import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content, by a window."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", F.sha2("text", 256).alias("id"))
    w = Window.partitionBy("id").orderBy("doc_id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "doc_id", "source")


QUERIES = {
    "first_parent_log": (first_parent_log, SQL_FIRST_PARENT),
    "ancestors_dag": (ancestors_dag, SQL_ANCESTORS),
    "merge_base": (merge_base, SQL_MERGE_BASE),
    "bisect_step": (bisect_step, SQL_BISECT),
    "reachable_objects": (reachable_objects, SQL_REACHABLE),
    "fsck_counts": (fsck_counts, SQL_FSCK),
    "gc_prune": (gc_prune, SQL_GC),
    "verify_remote": (verify_remote, SQL_VERIFY_REMOTE),
    "shallow_boundary": (shallow_boundary, SQL_SHALLOW),
    "log_filter": (log_filter, SQL_LOG),
    "reflog_nth": (reflog_nth, SQL_REFLOG),
    "fetch_batches": (fetch_batches, "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch FROM documents"),
    "pack_offsets": (pack_offsets, SQL_OFFSETS),
    "sector_offsets": (sector_offsets, SQL_SECTORS),
    "push_batches": (push_batches, SQL_PUSH),
    "suspects_except": (suspects_except, SQL_SUSPECTS),
    "last_known_state": (last_known_state, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1"),
    "ref_name_check": (ref_name_check, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' || page_id WHEN 1 THEN 'a..b' || page_id ELSE 'heads/' || page_id END AS name, page_id % 3 = 2 AS safe FROM pages"),
    "change_feed_windows": (change_feed_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "dedup_latest": (dedup_latest, "SELECT sha256(text) AS id, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"),
}
