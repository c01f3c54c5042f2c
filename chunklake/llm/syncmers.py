"""Document fingerprints from closed syncmers over words.

A run of ``K`` words is an anchor if, of the ``K - S + 1`` runs of ``S`` words inside it, one with
the smallest hash is the first or the last. That depends on the run alone and on nothing around it,
so an edit disturbs only the anchors that overlap it. The fingerprint is the sequence of the
anchors' 32-bit hashes in text order, which allows matching by position as well as by content.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

K, S = 6, 2
#: Characters of scripts that are written without spaces are words; so are those of words of more characters than this.
UNSPACED, LONG_WORD = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}", 32
#: Documents that one bucket of the document order holds on average, and buckets into which one level of bounds parts another at most.
BUCKET_ROWS, FANOUT = 2_000, 4_096


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, which white space ends; case counts."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG_WORD, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))
    return F.transform(parts, lambda w: F.xxhash64(w))


def anchors_of(words: Column, shorts: Column) -> Column:
    """``array<int>``: the anchors in text order; under ``K`` words: one for the whole sequence; if no run is one, the least hash."""
    last = K - S
    at = lambda i, d: F.get(shorts, i + d)
    inner = lambda i: F.least(*(at(i, d) for d in range(last + 1)))
    edge = lambda i: F.least(at(i, 0), at(i, last)) == inner(i)
    picked = F.filter(F.sequence(F.lit(0), F.size(words) - K), edge)
    run = lambda i: F.hash(*(F.get(words, i + d) for d in range(K)))
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.size(words) - K), run))
    anchors = F.when(F.size(picked) > 0, F.transform(picked, run)).otherwise(F.array(least))
    return F.when(F.size(words) >= K, anchors).when(F.size(words) > 0, F.array(F.hash(words))).otherwise(F.expr("cast(array() as array<int>)"))


def with_anchors(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` and the anchors of ``text``; each array is made once, as a column of its own."""
    df = df.withColumn("__w", word_hashes(text))
    df = df.withColumn("__s", F.when(F.size("__w") >= K, F.transform(F.sequence(F.lit(0), F.size("__w") - S), lambda i: F.xxhash64(*(F.get("__w", i + d) for d in range(S))))))
    return df.withColumn(name, anchors_of(F.col("__w"), F.col("__s"))).drop("__w", "__s")


def fingerprint_text(anchors: Column) -> Column:
    """Eight hex digits for each anchor, in text order; no words: the empty string."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of the distinct anchors (Jaccard), 0 to 1; two empty fingerprints: 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def matched_positions(a: Column, b: Column) -> Column:
    """Anchors that stand at the same ordinal in both fingerprints, as a share of the longer one."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(same / longer)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_anchors, fingerprint`` of every row; null texts count as empty."""
    rows = with_anchors(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__t")), F.col("__t"), "__a")
    return rows.select(id_col, F.size("__a").alias("n_anchors"), fingerprint_text(F.col("__a")).alias("fingerprint"))


def _part(cuts: Column, value: str, fan: int) -> Column:
    """How many of the cuts the value is below; null values come last."""
    above = F.size(F.filter(cuts, lambda c: F.col(value) < c))
    return F.when(cuts.isNull(), 0).when(F.col(value).isNull(), fan + 1).otherwise(above).cast("bigint")


def _parted(rows: DataFrame, value: str, fan: int, bounds: DataFrame, n_bounds: int) -> DataFrame:
    """``rows`` with each bucket parted by its ``cuts``."""
    both = rows.join(broadcast_if_small(bounds, n_bounds), "bucket", "left")
    return both.withColumn("bucket", F.col("bucket") * (FANOUT + 2) + _part(F.col("cuts"), value, fan)).drop("cuts")


def _cuts(rows: DataFrame, value: str, fan: int) -> DataFrame:
    """``bucket, cuts``: the quantiles that part each bucket's values into ``fan`` equal shares."""
    return rows.groupBy("bucket").agg(_quantiles(value, fan).alias("cuts"))


def _quantiles(value: str, fan: int) -> Column:
    return F.percentile_approx(value, [i / fan for i in range(1, fan)] or [0.5], 10 * FANOUT)


def _ordered(rows: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """``rows`` with ``bucket``, which grows as the ids fall, null ids last; the levels that made the buckets.

    Each level parts all buckets by quantiles of their ids, so that any spread of ids fills them evenly
    and their number follows the rows'. Rows of one id share a bucket; where they are many, it is
    parted by their texts' first bytes. Only rows that are equal throughout can't be parted.
    """
    light = rows.select(id_col)
    wanted = max(1, rows.count() // BUCKET_ROWS)
    fan = min(FANOUT, wanted)
    cuts = light.agg(_quantiles(id_col, fan)).first()[0] if fan > 1 else []
    rows, light = (df.withColumn("bucket", _part(F.array(*map(F.lit, sorted(cuts or []))), id_col, fan)) for df in (rows, light))
    wanted, levels, groups = -(-wanted // fan), 1, fan + 2
    while wanted > 1:
        fan = min(FANOUT, wanted)
        bounds = materialise(_cuts(light, id_col, fan))
        rows, light = (_parted(df, id_col, fan, bounds, groups * fan) for df in (rows, light))
        wanted, levels, groups = -(-wanted // fan), levels + 1, groups * (fan + 2)
    sizes = light.groupBy("bucket").agg(F.count("*").alias("n"), F.min(id_col).alias("a"), F.max(id_col).alias("b"))
    heavy = materialise(sizes.where((F.col("n") > 2 * BUCKET_ROWS) & F.col("a").eqNullSafe(F.col("b"))).select("bucket", "n"))
    n_heavy, most = heavy.agg(F.count("*"), F.max("n")).first()
    if n_heavy:
        fan = min(FANOUT, -(-most // BUCKET_ROWS))
        rows = rows.withColumn("begin", F.conv(F.rpad(F.hex(F.substring(F.encode("t", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint"))
        bounds = materialise(_cuts(rows.join(broadcast_if_small(heavy, n_heavy), "bucket"), "begin", fan))
        rows, levels = _parted(rows, "begin", fan, bounds, n_heavy * fan).drop("begin"), levels + 1
    return rows, levels


def _successors(keys: DataFrame, levels: int) -> DataFrame:
    """``bucket, next``: the following bucket of each one, the first after the last; no window has more rows than a level has parts."""
    if levels <= 1:
        w = Window.orderBy("bucket")
        return keys.select("bucket", F.coalesce(F.lead("bucket").over(w), F.min("bucket").over(Window.partitionBy())).alias("next"))
    up = F.floor(F.col("bucket") / (FANOUT + 2)).cast("bigint")
    keys = keys.withColumn("up", up)
    firsts = keys.groupBy("up").agg(F.min("bucket").alias("first"))
    beyond = _successors(firsts.select(F.col("up").alias("bucket")), levels - 1).join(firsts.withColumnRenamed("up", "next"), "next").select(F.col("bucket").alias("up"), "first")
    inside = keys.withColumn("next", F.lead("bucket").over(Window.partitionBy("up").orderBy("bucket")))
    return inside.join(beyond, "up").select("bucket", F.coalesce("next", "first").alias("next"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last ``floor(n / 3)`` code points replaced by the first as many (or all)
    of the next document by descending id; after the last comes the first. Equal ids are ordered by
    text, null ids come last, a single document follows itself. Null texts count as empty; repeated
    rows stay. The order is dealt into buckets by quantiles of the ids; a bucket's last document
    takes its successor from a table with the first document of every bucket.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``
    and the positional likenesses ``edited_positions, next_positions``.
    """
    rows, levels = _ordered(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")), id_col)
    order = [F.col(id_col).desc_nulls_last(), F.col("t").desc()]
    in_bucket = Window.partitionBy("bucket").orderBy(*order)
    tops = materialise(rows.groupBy("bucket").agg(F.max(id_col).alias("top")))
    after = _successors(tops.select("bucket"), levels).select(F.col("bucket").alias("before"), F.col("next").alias("bucket"))
    firsts = rows.join(broadcast_if_small(tops, tops.count()), "bucket").where(F.col(id_col).eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.max("t").alias("t"))
    heads = with_anchors(firsts, F.col("t"), "a").join(after, "bucket").select(F.col("before").alias("bucket"), F.col("t").alias("head_t"), F.col("a").alias("head_a"))
    rows = with_anchors(rows, F.col("t"), "a")
    rows = rows.withColumns({"next_t": F.lead("t").over(in_bucket), "next_a": F.lead("a").over(in_bucket)})
    # Both sides are dealt by bucket already; a head may be a long text, so it isn't broadcast.
    rows = rows.join(heads, "bucket").withColumns({"next_t": F.coalesce("next_t", "head_t"), "next_a": F.coalesce("next_a", "head_a")})
    n = F.char_length("t")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("bigint"), "e": F.concat(F.left("t", n - cut), F.left("next_t", cut))})
    rows = with_anchors(rows, F.col("e"), "ea")
    return rows.select(
        id_col,
        "n_chars",
        F.sha2("e", 256).alias("edited_sha256"),
        fingerprint_text(F.col("a")).alias("fingerprint"),
        fingerprint_text(F.col("ea")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("ea")).alias("near_edited"),
        likeness(F.col("a"), F.col("next_a")).alias("near_next"),
        matched_positions(F.col("a"), F.col("ea")).alias("edited_positions"),
        matched_positions(F.col("a"), F.col("next_a")).alias("next_positions"),
    )
