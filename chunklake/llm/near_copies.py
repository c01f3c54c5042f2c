"""SimHash near-dedup whose links are checked: the Jaccard of two texts' sets of five-word shingles is 0.8 or more.

Fingerprints of 256 bits, for 64 can't tell such pairs from chance at a radius that holds them, go
through the tiles of ``simhash_dedup``: a cell is a class of set sizes, and only cells whose sizes allow
the similarity are paired; inner tiles are skipped by sizes and by population counts, and the rest is
compared with exclusive-or and bit counts. Two fingerprints are tied if their first 64 bits differ by
``FIRST_RADIUS`` at most and all by ``RADIUS``. Ties that join all tied texts, never all pairs, are
compared exactly, and so are, in tiles, the texts of tied groups that this leaves apart. Texts of equal
words count as one throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_texts, fresh, materialise, tidy
from .graph import connected_components
from .lm_score import gram_hashes, tokens
from .simhash_dedup import INNER_TILE, Forest, compare_tiles, tile_pairs

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Longs of a fingerprint; bits by which tied ones may differ in the first of them and in all.
LONGS, FIRST_RADIUS, RADIUS = 4, 24, 72
#: Texts, and shingles of a text, that are hashed at once.
TEXTS_AT_ONCE, SHINGLES_AT_ONCE = 200, 4_096
#: Texts of a block, two of which are compared in one task; fingerprints of a tile.
TILE, FP_TILE = 1_000, 8_192

_DRAWN = np.random.default_rng(42).integers(0, 2**64, (3, LONGS), np.uint64)
_XOR, _TIMES, _AGAIN = _DRAWN[0], _DRAWN[1] | np.uint64(1), _DRAWN[2] | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; under five words one for the whole sequence, no words: none."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        sizes, grams = gram_hashes(texts[at : at + TEXTS_AT_ONCE], SHINGLE_WORDS)
        end = 0
        for n in sizes.tolist():
            begin, end = end, end + n
            k = min(n, SHINGLE_WORDS)
            yield np.unique(grams[k - 1][begin + k - 1 : end]) if n else np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``LONGS`` longs; a bit is 1 if more than half of the shingles have it."""
    ones = np.zeros(64 * LONGS, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        h = (shingles[at : at + SHINGLES_AT_ONCE, None] ^ _XOR) * _TIMES
        h = (h ^ (h >> np.uint64(32))) * _AGAIN
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # as many as a byte can count
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        same = pa.array([xxhash.xxh128_digest(b" ".join(tokens(t))) for t in texts], pa.binary())
        sizes, fps = [], []
        for s in shingle_sets(texts):
            sizes.append(len(s))
            fps.append(fingerprint(s).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), same, pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "same", "size", "fp"])


def _inner(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int, int, int]]:
    """Inner tiles by size: positions, rows, least and largest size, least and largest population count."""
    order = np.argsort(rows[:, 1], kind="stable")
    count = np.bitwise_count(rows[:, 2:]).sum(axis=1, dtype=np.int64)
    cuts = (order[k : k + INNER_TILE] for k in range(0, len(rows), INNER_TILE))
    return [(i, rows[i], int(rows[i[0], 1]), int(rows[i[-1], 1]), int(count[i].min()), int(count[i].max())) for i in cuts]


def tied_pairs(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` (rows of id, size, fingerprint) that are tied, by inner tiles; ``b`` None: within ``a``."""
    left = _inner(a)
    right = left if b is None else _inner(b)
    for k, (i, x, low, high, few, many) in enumerate(left):
        for j, y, low2, high2, few2, many2 in right[k:] if b is None else right:
            if low2 * SIMILARITY > high or low * SIMILARITY > high2 or few2 - many > RADIUS or few - many2 > RADIUS:
                continue
            near = np.bitwise_count(x[:, 2, None] ^ y[None, :, 2]) <= FIRST_RADIUS
            if b is None and j is i:
                near = np.triu(near, 1)
            u, v = np.divmod(np.flatnonzero(near), len(y))
            close = np.bitwise_count(x[u, 3:] ^ y[v, 3:]).sum(axis=1, dtype=np.int64) + np.bitwise_count(x[u, 2] ^ y[v, 2]) <= RADIUS
            if close.any():
                yield i[u[close]], j[v[close]]


def links_of(ids: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all ids whose sets are similar; ids of one class are joined already."""
    forest, links, m = Forest(), [], len(ids)
    first: dict[int, int] = {}
    for i, c in enumerate(classes or range(m)):
        forest.join(first.setdefault(c, i), i)
    parts = len(first)
    if parts < 2:
        return links
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    holders = owner[np.argsort(at, kind="stable")]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(at))))
    begins = np.cumsum(sizes) - sizes
    for i in range(1, m):
        shared = np.zeros(m, np.int64)
        for g in at[begins[i] : begins[i] + sizes[i]].tolist():
            shared[holders[bounds[g] : bounds[g + 1]]] += 1
        for j in np.nonzero(shared[:i] >= similarity * (sizes[:i] + sizes[i] - shared[:i]))[0].tolist():
            if forest.join(j, i):
                parts -= 1
                links.append((ids[j], ids[i]))
        if parts == 1:  # nothing is left to be joined
            break
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, TEXTS_AT_ONCE):
            part = b.slice(k, TEXTS_AT_ONCE)
            sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "sh"])


def _verify(table: pa.Table) -> pa.Table:
    sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in table.column("sh")]
    links = links_of(table.column("rep").to_pylist(), sets, classes=table.column("cls").to_pylist())
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def _links(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """``u, v``: links that join all texts that are similar and that ``tied`` (u, v) connects somehow.

    The ties themselves are compared first, each by itself, which joins most groups to one class. Only
    where classes are left apart all texts of the tied group are compared, in tiles of two blocks of
    TILE texts, so that no task holds a large group.
    """
    groups = connected_components(tied)
    sets = materialise(rows.join(groups.select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", "text").mapInArrow(tidy(_sets), "rep bigint, sh array<bigint>").dropDuplicates(["rep"]))
    side = lambda n: sets.select(F.col("rep").alias(n), F.col("sh").alias(f"sh_{n}"))
    shared = F.size(F.array_intersect("sh_u", "sh_v"))
    alike = shared >= SIMILARITY * (F.size("sh_u") + F.size("sh_v") - shared)
    near = materialise(tied.join(side("u"), "u").join(side("v").hint("merge"), "v").where(alike).select("u", "v"))
    classes = connected_components(near).select(F.col("node").alias("rep"), F.col("root").alias("cls"))
    members = groups.select(F.col("node").alias("rep"), F.col("root").alias("tie")).join(classes, "rep", "left").withColumn("cls", F.coalesce("cls", "rep"))
    apart = members.groupBy("tie").agg(F.count("*").alias("m"), F.count_distinct("cls").alias("k")).where("k > 1").select("tie", F.ceil(F.col("m") / TILE).cast("int").alias("blocks"))
    dealt = members.join(apart.hint("merge"), "tie").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    tiles = dealt.select("tie", "a", "b", "rep", "cls").join(sets, "rep").groupBy("tie", "a", "b")
    return near.unionByName(tiles.applyInArrow(_verify, "u bigint, v bigint"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near copies; columns as in ``docs``.

    Null and wordless texts are copies of each other. Of rows that repeat an id one stays, that with
    the least text. Rows with a null id stay.
    """
    rows = for_texts(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = materialise(rows.mapInArrow(tidy(_sketches), "doc_id bigint, same binary, size bigint, fp array<bigint>"))
    reps = sketches.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    cell = F.floor(F.log("size") / math.log(1 / SIMILARITY)).cast("int")  # sizes of similar sets are one class apart at most
    cells = reps.where("size > 0").select(cell.alias("hi"), F.lit(0).alias("lo"), F.concat(F.array("rep", "size"), "fp").alias("fp"))
    work = tidy(compare_tiles(tied_pairs, LONGS + 2))
    tied = tile_pairs(cells, [(0, 0), (1, 0)], FP_TILE).mapInArrow(work, "u bigint, v bigint")
    roots = connected_components(_links(rows, materialise(tied)))
    whole = reps.select("same", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("root"))
    id_, rn = fresh(docs, "gone"), fresh(docs, "rn")
    gone = sketches.select("doc_id", "same").join(whole.hint("merge"), "same").where("doc_id <> root").select(F.col("doc_id").alias(id_)).distinct()
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text_col, F.spark_partition_id()))  # rows without an id share no window
    first = F.row_number().over(Window.partitionBy(id_col, spread).orderBy(text_col))
    left = docs.join(gone, F.col(id_col) == F.col(id_), "left_anti").withColumn(rn, first)
    return left.where((F.col(rn) == 1) | F.col(id_col).isNull()).drop(rn)
