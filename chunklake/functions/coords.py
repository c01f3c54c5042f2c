"""Region and chunk coordinates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION_NAME = r"(?:^|/)r\.(-?\d+)\.(-?\d+)\.mca$"


def region_of(chunk: Column) -> Column:
    """The region that holds a chunk coordinate (32 chunks a side, negatives included)."""
    return F.shiftright(chunk, 5)


def chunk_index(x: Column, z: Column) -> Column:
    """Place of a chunk in its region's header, 0 to 1023."""
    return x.bitwiseAND(31) + z.bitwiseAND(31) * 32


def chunk_of_index(index: Column, rx: Column, rz: Column) -> tuple[Column, Column]:
    """Chunk coordinates of a header place."""
    return rx * 32 + index % 32, rz * 32 + F.floor(index / 32).cast("int")


def region_from_name(name: Column) -> tuple[Column, Column]:
    """``r.X.Z.mca`` to (X, Z); null where the name does not fit."""
    part = lambda i: F.regexp_extract(name, REGION_NAME, i).try_cast("int")
    return part(1), part(2)


def parse_pair(text: Column) -> tuple[Column, Column]:
    """``x,z`` to two ints; null where it is not exactly that."""
    ok = text.rlike(r"^-?\d+,-?\d+$")
    parts = F.split(text, ",")
    return tuple(F.when(ok, F.get(parts, i).try_cast("int")) for i in (0, 1))


def is_region_path(path: Column) -> Column:
    """Whether a path names a region file in one of the three chunk folders."""
    return F.lower(path).endswith(".mca") & F.concat(F.lit("/"), path).rlike("/(region|entities|poi)/")


def path_class(path: Column) -> Column:
    """region, nbt or blob."""
    return F.when(is_region_path(path), "region").when(F.lower(path).endswith(".dat"), "nbt").otherwise("blob")


#: Names of the dimensions and their folders; every other name means the overworld.
DIMENSION_FOLDERS = {"nether": "DIM-1", "the_nether": "DIM-1", "-1": "DIM-1", "end": "DIM1", "the_end": "DIM1", "1": "DIM1"}


def dimension_folder(name: str) -> str:
    return DIMENSION_FOLDERS.get(name.removeprefix("minecraft:"), "")
