"""Shared helpers: tables on the shared checkpoint folder, column defaults, native text pieces."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, remove, scratch, shared_folder  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A table of at most so many rows of a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows with whole texts that cross to Python at once.
TEXT_ROWS = 1_000


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on batches, at whose end freed memory goes back to the system, since idle workers wait for other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def for_texts(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on hands Python at most TEXT_ROWS rows at once, whole texts being long."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return docs


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a counted table of at most ``limit`` rows, else Spark's shuffled join."""
    return F.broadcast(df) if rows <= limit else df
