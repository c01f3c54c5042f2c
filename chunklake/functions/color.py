"""Map colours of blocks: an ordered rule list, then a hash of the name."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a name must hold which words, and its colour; the first rule that holds decides.
RULES: list[tuple[tuple[tuple[str, str], ...], tuple[int, int, int]]] = [
    ((("contains", "water"),), (63, 118, 228)),
    ((("contains", "lava"),), (224, 108, 29)),
    ((("equals", "grass_block"), ("equals", "grass"), ("equals", "tall_grass"), ("equals", "fern"), ("equals", "large_fern"), ("contains", "moss")), (98, 160, 75)),
    ((("contains", "leaves"),), (62, 124, 49)),
    ((("ends with", "log"), ("contains", "planks"), ("contains", "wood"), ("contains", "stem")), (120, 90, 55)),
    ((("contains", "sandstone"),), (199, 182, 130)),
    ((("contains", "sand"),), (219, 205, 158)),
    ((("contains", "podzol"), ("contains", "mud"), ("contains", "dirt"), ("contains", "farmland"), ("contains", "path")), (134, 96, 67)),
    ((("contains", "snow"),), (245, 247, 250)),
    ((("contains", "ice"),), (150, 190, 240)),
    ((("contains", "clay"),), (160, 166, 179)),
    ((("contains", "gravel"),), (130, 127, 124)),
    ((("contains", "deepslate"),), (70, 70, 75)),
    ((("contains", "blackstone"),), (42, 40, 46)),
    ((("contains", "basalt"),), (78, 78, 84)),
    ((("contains", "obsidian"),), (24, 20, 38)),
    ((("contains", "netherrack"), ("contains", "nether_wart")), (97, 38, 38)),
    ((("contains", "bedrock"),), (40, 40, 40)),
    ((("contains", "stone"), ("contains", "andesite"), ("contains", "granite"), ("contains", "diorite"), ("equals", "tuff")), (122, 122, 122)),
    ((("contains", "gold"),), (232, 206, 99)),
    ((("contains", "diamond"),), (110, 221, 213)),
    ((("contains", "coal"),), (54, 54, 58)),
    ((("contains", "glass"),), (200, 225, 235)),
    ((("contains", "brick"),), (150, 90, 80)),
]
AIR = ("air", "cave_air", "void_air")


def short_name(name: Column) -> Column:
    return F.regexp_replace(name, "^minecraft:", "")


def is_air(name: Column) -> Column:
    return short_name(name).isin(*AIR)


def name_hash(name: Column) -> Column:
    """31-multiplier hash over the characters, modulo 2^32."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def hash_color(name: Column) -> Column:
    """Three channels of 80 to 159 from the hash."""
    h = name_hash(name)
    return F.struct(*((F.lit(80) + F.shiftright(h, s).bitwiseAND(0x4F)).cast("int").alias(c) for c, s in (("r", 0), ("g", 6), ("b", 12))))


def _holds(name: Column, how: str, word: str) -> Column:
    return {"equals": name == word, "ends with": name.endswith(word), "contains": name.contains(word)}[how]


def block_color(name: Column) -> Column:
    """``struct<r,g,b>`` of a block name."""
    short = short_name(name)
    out = hash_color(short)
    for words, rgb in reversed(RULES):
        color = F.struct(*(F.lit(v).alias(c) for c, v in zip("rgb", rgb, strict=True)))
        out = F.when(reduce(or_, (_holds(short, *w) for w in words)), color).otherwise(out)
    return out


def shaded(channel: Column, height: Column, north: Column) -> Column:
    """1.12 times brighter if higher than the block to the north, 0.86 if lower; null heights: as is."""
    factor = F.when(height > north, 1.12).when(height < north, 0.86).otherwise(1.0)
    return F.least(F.lit(255), F.floor(channel * factor)).cast("int")
