"""SimHash near-dedup by exact comparison in tiles.

Each text gives a 64-bit fingerprint. Distinct fingerprints are packed into tiles by the population
counts of their two halves; a pair of tiles is formed only if these counts differ by the radius at
most, for no other pair can hold a link. Within a pair, smaller tiles, ordered by the counts of the
four quarters, are skipped in the same way, and what remains is compared with numpy's exclusive-or
and bit counts. A pair of tiles reports links that connect all that it finds linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, for_texts, fresh, materialise, tidy
from .graph import connected_components

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile that is dealt to tasks, and of the smaller tiles inside it.
TILE, INNER_TILE = 16_384, 512

_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def simhash(text: str | None) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; null or no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the same six characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE_WORDS + 1].tolist()
    digest, counts, done = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    ends = ends[SHINGLE_WORDS - 1 :].tolist()
    for at in range(0, len(begins), 65_536):
        h = np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begins[at : at + 65_536], ends[at : at + 65_536], strict=True)), np.uint64)
        done += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > done, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long), a row for each row of ``docs``."""
    return for_texts(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(_fingerprints), "doc_id bigint, fp bigint")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Inner tiles: positions, fingerprints, least and largest counts of the quarters."""
    q = _quarters(fp)
    order = np.lexsort((q[:, 3], q[:, 1], q[:, 2], q[:, 0]))
    return [(i, fp[i], q[i].min(axis=0), q[i].max(axis=0)) for i in (order[k : k + INNER_TILE] for k in range(0, len(fp), INNER_TILE))]


def linked_pairs(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` that are linked, by inner tiles; ``b`` None: within ``a``."""
    left = _tiles(a)
    right = left if b is None else _tiles(b)
    for k, (i, x, low, high) in enumerate(left):
        for j, y, low2, high2 in right[k:] if b is None else right:
            if np.maximum(np.maximum(low - high2, low2 - high), 0).sum() > radius:
                continue
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if b is None and j is i:
                near = np.triu(near, 1)
            if near.any():
                u, v = np.nonzero(near)
                yield i[u], j[v]


class Forest:
    """Union-find that tells which links join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = z = up.get(y, y)
            x = z
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def joining(found: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of links between positions below ``size``, those that join two trees, so that a large group is no pair loop."""
    forest, root = Forest(), np.arange(size)
    for i, j in found:
        while (apart := root[i] != root[j]).any():
            i, j = i[apart], j[apart]
            x, y = root[i], root[j]
            _, first = np.unique(x, return_index=True)
            kept = [k for k in first.tolist() if forest.join(int(x[k]), int(y[k]))]
            yield i[kept], j[kept]
            now = np.arange(size)
            for r in {*x[first].tolist(), *y[first].tolist()}:
                now[r] = forest.find(r)
            root = now[root]


def compare(row: pa.ListScalar, links: Callable[[np.ndarray, np.ndarray | None], Iterator], width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First columns of the fingerprints (rows of ``width`` longs) of the links that join all linked ones of a pair of tiles."""
    tiles = [np.ascontiguousarray((x.values if width == 1 else x.values.flatten()).to_numpy(zero_copy_only=False)).view(np.uint64) for x in row.values if x.is_valid]
    tiles = [t if width == 1 else t.reshape(-1, width) for t in tiles]
    a, b = tiles[0], tiles[1] if len(tiles) > 1 else None
    both, shift = (a, 0) if b is None else (np.concatenate((a, b)), len(a))
    name = both if width == 1 else both[:, 0]
    kept = list(joining(((i, j + shift) for i, j in links(a, b)), len(both)))
    u, v = (np.concatenate([x[k] for x in kept]) if kept else np.zeros(0, np.int64) for k in (0, 1))
    return name[u].view(np.int64), name[v].view(np.int64)


def compare_tiles(links: Callable[[np.ndarray, np.ndarray | None], Iterator], width: int = 1) -> Callable[[Iterator], Iterator]:
    """Work on the rows of ``tile_pairs``: links ``u, v``; ``links`` finds the positions of a pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("tiles"):
                u, v = compare(row, links, width)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def tile_pairs(rows: DataFrame, steps: list[tuple[int, int]], tile: int) -> DataFrame:
    """``rows``: a cell ``hi, lo`` (few) and ``fp``. A row ``tiles`` for each pair of tiles of cells one of ``steps`` apart.

    A cell of more than ``tile`` fingerprints is dealt into several tiles. Each tile goes to every tile
    of the cells at the steps, half of the directions being enough, and once to itself.
    """
    cells = rows.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    cells = F.broadcast(materialise(cells.coalesce(1)))  # at most 1,089 rows for halves, 65 for sizes
    rows = rows.join(cells, ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = rows.groupBy("hi", "lo", "parts", "part").agg(F.collect_list("fp").alias("fps"))
    step = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(e).alias("e")) for d, e in steps)))
    own = ["hi", "lo", "part"]
    # Towards the cells at each step, and as the partner of the cells for which this one is at the step.
    first = tiles.withColumn("s", step).withColumns({"hi2": F.col("hi") + F.col("s.d"), "lo2": F.col("lo") + F.col("s.e")})
    first = first.join(cells.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2")), ["hi2", "lo2"])
    first = first.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    same = (F.col("hi") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    first = first.where(~same | (F.col("part") <= F.col("part2"))).select(*own, "hi2", "lo2", "part2", F.lit(0).alias("side"), "fps")
    second = tiles.withColumn("s", step).withColumns({"hi2": F.col("hi") - F.col("s.d"), "lo2": F.col("lo") - F.col("s.e")})
    second = second.join(cells.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2")), ["hi2", "lo2"])
    second = second.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    second = second.where(~same | (F.col("part2") < F.col("part"))).select(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("part2").alias("part"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("part").alias("part2"), F.lit(1).alias("side"), "fps")
    pairs = first.unionByName(second).groupBy(*own, "hi2", "lo2", "part2").agg(F.array_sort(F.collect_list(F.struct("side", "fps")))["fps"].alias("tiles"))
    alone = same & (F.col("part") == F.col("part2"))  # else its partner has no rows
    return pairs.where(alone | (F.size("tiles") == 2)).select("tiles")


def tile_links(distinct: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """``distinct``: one column ``fp`` without repetition. Links ``u, v`` that join all linked ones.

    A cell is a pair of population counts of the halves, so there are at most 33 x 33, and only cells
    within the radius are paired.
    """
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    rows = distinct.select("fp", half(32).cast("int").alias("hi"), half(0).cast("int").alias("lo"))
    steps = [(d, e) for d in range(-radius, radius + 1) for e in range(-radius, radius + 1) if abs(d) + abs(e) <= radius and (d, e) >= (0, 0)]
    links = lambda a, b: linked_pairs(a, b, radius)
    return tile_pairs(rows, steps, tile).mapInArrow(tidy(compare_tiles(links)), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs`` with an id.

    The component is the smallest id reachable over fingerprints at most ``RADIUS`` bits apart, its
    own included; ``n_links`` counts the documents of the component besides this one. Null and
    wordless texts have fingerprint zero and are linked like any other; repeated rows stay; rows
    with a null id can't be named and are left out.
    """
    fps = materialise(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = connected_components(tile_links(fps.select("fp").distinct()))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = members.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    by_fp = members.join(whole, "root").select("fp", "component_id", (F.col("size") - 1).alias("n_links"))
    # A fingerprint that many copies share is one row here; the copies' side is split where it is large.
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group; columns as in ``docs``.

    Of rows that repeat an id one stays, that with the least text. Rows with a null id stay.
    """
    id_, rn = fresh(docs, "gone"), fresh(docs, "rn")
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_))
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    left = docs.join(gone, F.col(id_col) == F.col(id_), "left_anti").withColumn(rn, first)
    return left.where((F.col(rn) == 1) | F.col(id_col).isNull()).drop(rn)
