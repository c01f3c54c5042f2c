"""Palettes and packed longs: widths, packing, unpacking; no index crosses a 64-bit word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_for(entries: Column, least: int) -> Column:
    """Bits of an index into a palette of ``entries``: ceil(log2), ``least`` at least."""
    return F.greatest(F.lit(least), F.when(entries <= 1, 0).otherwise(F.length(F.bin(entries - 1)))).cast("int")


def palette_index(data: Column, entries: Column, least: int, at: Column) -> Column:
    """The index packed at ``at``; without data 0; beyond data or palette null."""
    bits = bits_for(entries, least)
    per_word = F.floor(F.lit(64) / bits).cast("int")
    word = F.get(data, F.floor(at / per_word).cast("int"))
    index = F.call_function("shiftrightunsigned", word, ((at % per_word) * bits).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    return F.when(F.coalesce(F.size(data), F.lit(0)) <= 0, F.when(entries > 0, F.lit(0).cast("bigint"))).when(index < entries, index)


def pack4(index: Column, slot: Column) -> Column:
    """A 4-bit index moved to its slot; the sum (or bit_or) over a word's slots is the word."""
    return F.call_function("shiftleft", index.cast("bigint"), (slot * 4).cast("int"))


def unpack4(word: Column, slot: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, (slot * 4).cast("int")).bitwiseAND(15)


def block_text(name: Column, props: Column) -> Column:
    """``name[k=v,...]`` with properties (a map) sorted by key; no brackets without properties."""
    pairs = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.when(F.size(pairs) > 0, F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(""))
