"""Stupid-backoff language-model scores, computed relationally.

The documents are dealt into blocks. Each block explodes its n-grams and counts them, and its
counts, partitioned by the n-gram's hash, meet those of all blocks in the count tables; each
partition joins the totals back to the n-grams that each block asked for. A block then scores its
documents' n-grams from the joined counts and sums them per document. No table is broadcast or
collected. What crosses the network is compressed: texts by packs of a block, and a block's n-grams
of one partition as one pack of sorted hashes, by their differences. A pack holds one n-gram at
least, so there are never more of them than rows in a plain table of (block, n-gram, count), and a
frequent n-gram is no hot key, since each block asks for it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an n-gram, factor of each step back.
ORDER, BACKOFF = 3, 0.4
#: Code points of a block of documents and n-grams of a partition of the count tables, on average.
BLOCK_CHARS, PARTITION_GRAMS = 12_000_000, 2_000_000
#: Bytes of texts that a task holds before it packs them by block.
PACK_BYTES = 50_000_000
#: Code points of a word with its space, on average, from which the number of partitions is guessed.
WORD_CHARS = 6
#: Partitions for each block, over which blocks are dealt by hash.
SPREAD = 3

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, which the white space of ASCII ends."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def gram_hashes(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text; for n = 1..order the hashes of the n-grams that end at each word.

    An n-gram that would begin before its text is marked by 0.
    """
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = tokens(t)
        sizes[i] = len(words)
        for w in words:
            if w not in known:
                known[w] = digest(w) or 1
        flat.extend(map(known.__getitem__, words))
    one = np.array(flat, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [one]
    for n in range(2, order + 1):
        longer = np.zeros_like(one)
        longer[1:] = _mix(out[-1][:-1] * _MULTIPLIER + one[1:] + np.uint64(n))
        longer[place < n - 1] = 0
        out.append(longer)
    return sizes, out


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, count = np.unique(grams[grams != 0], return_counts=True)
    return found, count


def _squeezed(b: bytes, level: int = 1) -> bytes:
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", level).compress(b, asbytes=True)


def _expanded(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """Bytes by place of value, so that differences of sorted hashes and small counts compress well."""
    return _squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_expanded(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_sorted(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, docs``: the rows of a block that a task has met, as one compressed Arrow stream."""

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by("block")
        block = table.column("block").to_numpy()
        bounds = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(block)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = table.slice(a, b - a).drop_columns("block").combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int64()), pa.array([_squeezed(sink.getvalue().to_pybytes(), 3)], pa.binary())], names=["block", "docs"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= PACK_BYTES:
            yield from packs(held)
            held, size = [], 0
    if held:
        yield from packs(held)


def _docs(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(_expanded(x.as_py())).read_all() for x in table.column("docs")])


def _parts(grams: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """The partitions that have any of the sorted hashes, equal ranges of these, and where each one's begin and end."""
    part = ((grams >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    bounds = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    return part[bounds[:-1]], bounds


def _ask(order: int, partitions: int):  # noqa: ANN202
    def work(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, grams = gram_hashes(_docs(table).column("text").to_pylist(), order)
        rows: dict[str, list] = {"part": [], "block": [], "n": [], "grams": [], "counts": []}
        words = np.array([len(grams[0])], np.int64)
        for n, (found, count) in enumerate([(np.ones(1, np.uint64), words), *map(_counted, grams)]):  # the empty n-gram occurs at each word
            parts, bounds = _parts(found, partitions)
            for p, a, b in zip(parts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k, v in zip(rows, (p, block, n, _packed_sorted(found[a:b]), _packed(count[a:b].astype(np.uint32))), strict=True):
                    rows[k].append(v)
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]))

    return work


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one partition's n-grams of one length, for each block in the order in which it asked."""
    asked = [_unpacked_sorted(x.as_py()) for x in table.column("grams")]
    counts = [_unpacked(x.as_py(), np.uint32) for x in table.column("counts")]
    every, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)[at]
    bounds = np.cumsum([0, *map(len, asked)])
    totals = [_packed(total[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"part": table.column("part"), "block": table.column("block"), "n": table.column("n"), "totals": pa.array(totals, pa.binary())})


def backoff_logs(counts: list[np.ndarray], present: list[np.ndarray], words: np.ndarray, factor: float = BACKOFF) -> np.ndarray:
    """log10 of the stupid-backoff score of each word.

    ``counts[n-1]``: corpus counts of the n-grams that end at it; ``present[n-1]``: whether its text has
    such an n-gram, that is, whether n words stand there; ``words``: words of the corpus.
    """
    score = np.log10(np.maximum(counts[0], 1) / np.maximum(words, 1))
    for n in range(2, len(counts) + 1):
        context = np.concatenate(([1], counts[n - 2][:-1]))
        step = np.where(present[n - 1], math.log10(factor) + score, score)
        score = np.where(counts[n - 1] > 0, np.log10(np.maximum(counts[n - 1], 1) / np.maximum(context, 1)), step)
    return score


def _joined(grams: np.ndarray, doc: np.ndarray, known: np.ndarray, held_out: bool) -> np.ndarray:
    """The total of each word's n-gram, less those of its own document if ``held_out``; ``known``: totals of the distinct n-grams in order."""
    if not len(grams):
        return np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    ranked, owner = grams[order], doc[order]
    new = np.concatenate(([ranked[0] != 0], ranked[1:] != ranked[:-1]))  # those that begin before their text have none
    at = np.cumsum(new) - 1
    total = np.where(at >= 0, known[np.maximum(at, 0)], 0) if len(known) else np.zeros(len(grams), np.int64)
    if held_out:
        bounds = np.concatenate(([0], np.nonzero(new[1:] | (owner[1:] != owner[:-1]))[0] + 1, [len(grams)]))
        sizes = np.diff(bounds)
        total = np.where(at >= 0, total - np.repeat(sizes, sizes), 0)
    out = np.empty(len(grams), np.int64)
    out[order] = total
    return out


def _score(order: int, factor: float, held_out: bool, kind: pa.DataType):  # noqa: ANN202
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(docs)
        sizes, grams = gram_hashes(docs.column("text").to_pylist(), order)
        answers = answers.sort_by([("n", "ascending"), ("part", "ascending")])
        known_of = lambda n: np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_py(), np.int64) for x in answers.filter(pa.compute.equal(answers.column("n"), n)).column("totals"))])
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        counts = [_joined(g, doc, known_of(n), held_out) for n, g in enumerate(grams, 1)]
        words = known_of(0)[0] - (np.repeat(sizes, sizes) if held_out else 0)
        logs = np.concatenate((backoff_logs(counts, [g != 0 for g in grams], words, factor), [0.0]))
        begin = np.minimum(np.cumsum(sizes) - sizes, len(logs) - 1)
        sums = np.where(sizes > 0, np.add.reduceat(logs, begin), 0.0) if len(sizes) else np.zeros(0)
        return pa.table({"id": docs.column("id"), "n_words": pa.array(sizes), "log10_score": pa.array(sums)}, schema=pa.schema([("id", kind), ("n_words", pa.int64()), ("log10_score", pa.float64())]))

    return work


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, factor: float = BACKOFF, held_out: bool = True) -> DataFrame:
    """``id, n_words, log10_score, mean_log10`` of every row under the counts of all rows.

    The score of a word is count(n-gram) / count(its context) at the greatest length from ``order``
    down at which the n-gram occurs, times ``factor`` for each step back; a single word's is its share
    of all words, one that does not occur counting as one. With ``held_out`` all counts are those of the
    other rows, since every n-gram of a text occurs in the text itself; without, no step back is ever
    taken. Words at the start of a text begin with shorter n-grams. Null and wordless texts have no
    words, sum 0 and null mean; repeated rows count and are scored as often as they stand; rows with
    null ids are scored under a null id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    total = docs.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    partitions = max(1, -(-(total // WORD_CHARS) // PARTITION_GRAMS))
    salted = F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.spark_partition_id())  # repeated rows part as well
    rows = docs.select(F.pmod(salted, F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_pack_texts, "block bigint, docs binary").repartition(SPREAD * blocks, "block")  # so that few blocks meet in one task
    asked = rows.groupBy("block").applyInArrow(_ask(order, partitions), "part int, block bigint, n int, grams binary, counts binary")
    answers = asked.groupBy("part", "n").applyInArrow(_answer, "part int, block bigint, n int, totals binary")
    kind = docs.schema[id_col].dataType
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, factor, held_out, to_arrow_type(kind)), f"id {kind.simpleString()}, n_words bigint, log10_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log10_score", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")).alias("mean_log10"))
