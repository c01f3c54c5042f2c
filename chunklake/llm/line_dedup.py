"""Line dedup by overlapping windows of three lines.

Every run of three consecutive non-blank lines is hashed; a window that occurs more than once
anywhere keeps its first occurrence (smallest document id, then position), and the lines that later
occurrences cover are removed, the covered positions of a document being merged first.

``dedup_passages`` does the same with sentences instead of lines, so that passages inside long lines,
or between other neighbours, are found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 3
#: Where a line is cut into units, and words from which a unit is a window of its own.
SENTENCE_END, LONG_UNIT_WORDS = r"(?<=[.!?][ ])|(?<=[。！？])", 50
#: A unit's position is that of its line times this, and its ordinal in the line.
LINE_STEP = 1 << 32


def _lines(text: Column) -> Column:
    """The non-blank lines as ``struct<at,line>``: position in the text and the trimmed line."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"))), lambda x: x["line"] != "")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: ``id, at`` (ordinal of its first non-blank line), ``h1, h2``, ``a, b, c``.

    Two 64-bit hashes under different seeds stand for the three lines; a, b, c are the lines'
    positions in the text.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _lines(F.col(text_col)).alias("lines")).where(F.size("lines") >= WINDOW)
    rows = rows.select("id", F.col("lines.at").alias("ats"), F.col("lines.line").alias("lines"))
    rows = rows.select("id", "ats", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("at"))
    three = [F.get("lines", F.col("at") + i) for i in range(WINDOW)]
    return rows.select("id", "at", F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *three).alias("h2"), *(F.get("ats", F.col("at") + i).alias(n) for i, n in enumerate("abc")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``gone``, the merged set of line positions that later occurrences cover."""
    w = windows(docs, id_col, text_col)
    repeated = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1").drop("n")
    later = w.join(repeated, ["h1", "h2"]).where(F.struct("id", "at") != F.col("first"))
    return later.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b", "c")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """``docs`` with the texts that remain and ``count_col``, the number of lines taken out.

    All rows and other columns stay. A null text stays null; a text of under three non-blank lines
    has no window and stays; blank lines are neither counted nor removed; lines are compared without
    spaces at their ends; rows with a null id are left alone; rows that share an id share their
    removals. An emptied text is the empty string (or its blank lines).
    """
    id_, gone_, lines_ = (fresh(docs, n) for n in ("id", "gone", "lines"))
    gone = removed_lines(docs, id_col, text_col).select(F.col("id").alias(id_), F.col("gone").alias(gone_))
    both = docs.join(gone, F.col(id_col) == F.col(id_), "left")
    both = both.withColumn(lines_, F.split(F.col(text_col), "\n"))  # a column, since a lambda would split again for each line
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), gone_)
    left = F.array_join(F.transform(kept, lambda i: F.get(lines_, i)), "\n")
    text = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(left)
    return both.withColumns({text_col: text, count_col: F.coalesce(F.size(gone_), F.lit(0))}).drop(id_, gone_, lines_)


def _units(text: Column) -> Column:
    """The non-blank units as ``struct<at,line>``, lines being cut after sentences."""
    of_line = lambda x, i: F.transform(F.split(x, SENTENCE_END), lambda u, j: F.struct((i.cast("bigint") * LINE_STEP + j).alias("at"), F.trim(u).alias("line")))
    return F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of_line)), lambda x: x["line"] != "")


def passage_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, at, h1, h2, ats``: three units, a unit of LONG_UNIT_WORDS words, or all of a text of fewer units.

    ``at`` is the ordinal of the first unit, ``ats`` the positions of all.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _units(F.col(text_col)).alias("units")).where(F.size("units") > 0)
    rows = rows.select("id", F.col("units.at").alias("ats"), F.col("units.line").alias("lines"))

    def window(k: Column, n: int) -> Column:
        of = [F.get("lines", k + i) for i in range(n)]
        return F.struct(k.alias("at"), F.xxhash64(F.lit(n), *of).alias("h1"), F.xxhash64(F.lit(-n), *of).alias("h2"), F.array(*(F.get("ats", k + i) for i in range(n))).alias("ats"))

    ordinals = F.sequence(F.lit(0), F.size("lines") - 1)
    three = F.transform(F.filter(ordinals, lambda k: k <= F.size("lines") - WINDOW), lambda k: window(k, WINDOW))
    long = F.transform(F.filter(ordinals, lambda k: (F.size(F.split(F.get("lines", k), " +")) >= LONG_UNIT_WORDS) | (F.size("lines") == 1)), lambda k: window(k, 1))
    two = F.transform(F.filter(ordinals, lambda k: (k == 0) & (F.size("lines") == 2)), lambda k: window(k, 2))
    return rows.select("id", F.explode(F.concat(three, two, long)).alias("w")).select("id", "w.*")


def _without(text: Column, gone: Column) -> Column:
    """The text without the units at ``gone``; a line goes if nothing but spaces is left of it."""
    kept = lambda x, i: F.array_join(F.filter(F.split(x, SENTENCE_END), lambda u, j: ~F.array_contains(gone, i.cast("bigint") * LINE_STEP + j)), "")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), kept(x, i).alias("kept")))
    left = F.filter(lines, lambda s: (s["kept"] == s["line"]) | (F.trim(s["kept"]) != ""))
    return F.array_join(F.transform(left, lambda s: s["kept"]), "\n")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """As ``dedup_lines``, by units; ``count_col`` counts these. A line goes if nothing but spaces is left of it."""
    id_, gone_ = fresh(docs, "id"), fresh(docs, "gone")
    w = passage_windows(docs, id_col, text_col)
    repeated = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1").drop("n")
    later = w.join(repeated, ["h1", "h2"]).where(F.struct("id", "at") != F.col("first"))
    gone = later.groupBy(F.col("id").alias(id_)).agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias(gone_))
    both = docs.join(gone, F.col(id_col) == F.col(id_), "left")
    text = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(gone_)))
    return both.withColumns({text_col: text, count_col: F.coalesce(F.size(gone_), F.lit(0))}).drop(id_, gone_)
