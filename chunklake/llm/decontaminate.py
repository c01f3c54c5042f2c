"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are the lower-cased runs of letters and digits; a shingle is five consecutive words and weighs
as much as it occurs. Windows of an item's length are laid at every position where enough shingles of
items of that length stand, in any order, for the similarity asked for; elsewhere it is out of reach.
Their SimHash fingerprints are looked up in an index of the items': the 64 bits are cut into
``BLOCKS`` blocks, and every fingerprint within ``RADIUS`` bits agrees with the item's in some block
up to ``RADIUS // BLOCKS`` bits; the index holds all these neighbours of each block. The candidates
are then verified by the exact weighted similarity. Built-in functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialise

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of texts with similarity 0.8 differ by 10 bits on average; 23 is over four deviations more.
RADIUS, BLOCKS = 23, 6


def words_column(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(words: Column | str, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(k)))


def _all_shingles(words: str, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _shingle(words, i, k))


def _shingles(words: str, k: Column) -> Column:
    """Hashes of all shingles of a short list of words; ``k`` is at most SHINGLE_WORDS."""
    hashed = lambda i, n: F.xxhash64(*(F.get(words, i + d) for d in range(n)))
    of = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: hashed(i, n))
    out = F.when(F.size(words) >= SHINGLE_WORDS, of(SHINGLE_WORDS))
    for n in range(1, SHINGLE_WORDS):
        out = out.when((k == n) & (F.size(words) >= n), of(n))
    return out.otherwise(F.expr("cast(array() as array<bigint>)"))


def _shift_right(c: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", c, by)


def _counters(shingles: Column) -> Column:
    """How many shingles have each bit: element k holds the counts of the bits k, k+16, k+32 and k+48, 16 bits each."""
    lanes = F.lit(0x0001000100010001).cast("bigint")
    count = lambda k: F.aggregate(shingles, F.lit(0).cast("bigint"), lambda acc, h: acc + _shift_right(h, k).bitwiseAND(lanes))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), count)


def _simhash(counters: Column, n: Column) -> Column:
    """Bit set where more than half of the ``n`` shingles have it."""
    count = lambda p: _shift_right(F.get(counters, p % 16), (p / 16).cast("int") * 16).bitwiseAND(0xFFFF)
    bit = lambda p: F.when(count(p) * 2 > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), p)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, p: acc.bitwiseOR(bit(p)))


def with_fingerprint(df: DataFrame, words: str, k: Column) -> DataFrame:
    """``df`` with ``sh`` (its shingles' hashes) and ``fp``."""
    df = df.withColumn("sh", _shingles(words, k))
    df = df.withColumns({"__c": _counters(F.col("sh")), "__n": F.size("sh")})
    return df.withColumn("fp", _simhash(F.col("__c"), F.col("__n"))).drop("__c", "__n")


def _blocks() -> list[tuple[int, int]]:
    """Shift and width of each block."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_values(fp: str, neighbours: bool) -> Column:
    """``array<struct<block,value>>``: each block's own value or all within RADIUS // BLOCKS bits."""
    def of(block: int, shift: int, width: int) -> Column:
        value = F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)
        flips = [sum(1 << b for b in bits) for d in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), d)] if neighbours else [0]
        masks = F.from_json(F.lit(str(flips)), "array<bigint>")  # one literal
        return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(of(i, *b) for i, b in enumerate(_blocks()))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two lists of shingles: each counts as often as it occurs."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    least = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    union = F.size(a) + F.size(b) - least
    return F.when(union > 0, least / union).otherwise(F.lit(0.0))


def window_starts(rows: DataFrame, places: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """``doc_id, t, len, k, starts``: the starts of all windows of ``len`` words that can hold the similarity.

    A window of ``a`` shingles can reach the similarity ``s`` with an item of ``b`` only if
    ``s / (1 + s) * (a + b)`` of its shingles stand in items of that length, wherever they stand there.
    ``rows``: ``doc_id, t`` (a text's hash) and its words ``w``; ``places``: ``len, k, h``.
    """
    hits = None
    for k in sizes:
        here = rows.where(F.size("w") >= k).select("doc_id", "t", "w", F.size("w").alias("nw"))
        here = here.select("doc_id", "t", "nw", F.posexplode(_all_shingles("w", k)).alias("p", "h"))
        here = here.join(places.where(F.col("k") == k), "h").select("doc_id", "t", "nw", "len", "k", "p")
        hits = here if hits is None else hits.unionByName(here)
    at = hits.groupBy("doc_id", "t", "len", "k").agg(F.first("nw").alias("nw"), F.sort_array(F.collect_set("p")).alias("at"))
    at = at.withColumn("b", F.col("len") - F.col("k") + 1).withColumn("a", F.least("b", F.col("nw") - F.col("k") + 1))
    at = at.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("a") + F.col("b")) * (similarity / (1 + similarity)) - 1e-9).cast("int"))).where(F.size("at") >= F.col("need"))
    lo = lambda j: F.greatest(F.lit(0), F.get("at", j + F.col("need") - 1) - F.col("a") + 1)
    hi = lambda j: F.least(F.get("at", j), F.greatest(F.lit(0), F.col("nw") - F.col("len")))
    whole = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda j: lo(j) <= hi(j))
    starts = F.array_distinct(F.flatten(F.transform(whole, lambda j: F.sequence(lo(j), hi(j)))))
    return at.select("doc_id", "t", "len", "k", starts.alias("starts")).where(F.size("starts") > 0)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start, hamming, similarity``: the best window of each document for each item.

    ``start`` is the window's first word, the least of equally good ones. Null and wordless texts on
    either side match nothing; an item of fewer than five words is one shingle, its whole sequence;
    repeated documents (rows of one id) count as one, repeated items under their own ids each; rows
    with a null id are left out. A document shorter than an item is compared as a whole.
    """
    bench = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_column(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    bench = bench.withColumns({"len": F.size("words"), "k": F.least(F.size("words"), F.lit(SHINGLE_WORDS))})
    bench = materialise(with_fingerprint(bench, "words", F.col("k")).select("item_id", "len", "k", "sh", "fp"))
    sizes = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most five values
    n_shingles = bench.agg(F.sum(F.size("sh"))).first()[0] or 0
    n_items = bench.count()
    places = broadcast_if_small(bench.select("len", "k", F.explode("sh").alias("h")).distinct(), n_shingles)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), words_column(F.col(text_col)).alias("w"))
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, start int, hamming int, similarity double")
    starts = materialise(window_starts(rows, places, sizes, similarity))
    windows = rows.join(broadcast_if_small(starts, starts.agg(F.sum(F.size("starts"))).first()[0] or 0), ["doc_id", "t"])
    windows = windows.select("doc_id", "len", "k", "w", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "len", "k", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("window"))
    # Few bytes but much work a row: dealt by number, so that small partitions are not put together.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = windows.repartition(n, "doc_id", "len", "start")
    windows = materialise(with_fingerprint(windows, "window", F.col("k")).select("doc_id", "len", "start", "sh", "fp"))
    # Equal windows of many documents are looked up once.
    classes = windows.groupBy("len", "fp", "sh").agg(F.count("*").alias("n")).drop("n")
    index = bench.select("item_id", "len", F.col("fp").alias("item_fp"), F.explode(block_values("fp", True)).alias("b")).select("item_id", "len", "item_fp", "b.block", "b.value")
    index = broadcast_if_small(index, n_items * 6 * 232)
    probes = classes.select("len", "fp", "sh", F.explode(block_values("fp", False)).alias("b")).select("len", "fp", "sh", "b.block", "b.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.join(index, ["len", "block", "value"]).where(hamming <= RADIUS)
    # A pair is taken from the first block in which it agrees.
    agrees = [F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), s).bitwiseAND((1 << w) - 1)) <= RADIUS // BLOCKS for s, w in _blocks()]
    first = F.coalesce(*(F.when(a, i) for i, a in enumerate(agrees)))
    near = near.where(F.col("block") == first).select("len", "fp", "sh", "item_id", hamming.cast("int").alias("hamming"))
    items_sh = broadcast_if_small(bench.select("item_id", F.col("sh").alias("item_sh")), n_shingles)
    sim = near.join(items_sh, "item_id").withColumn("similarity", weighted_similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= similarity)
    found = windows.join(sim.drop("item_sh"), ["len", "fp", "sh"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("d"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), (-F.col("b.d")).alias("hamming"), F.round("b.similarity", 6).alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item was found; rows and columns as in ``docs``."""
    id_ = fresh(docs, "leaked")
    leaked = find_leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(leaked, F.col(id_col) == F.col(id_), "left_anti")
