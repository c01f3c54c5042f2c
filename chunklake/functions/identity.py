"""Identity of list entries, id filters, and other small expressions on records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_key(uuid: Column | None = None, most: Column | None = None, least: Column | None = None, xyz: tuple[Column, Column, Column] | None = None, slot: Column | None = None, name: Column | None = None) -> Column:
    """First of UUID (four ints), legacy UUID halves, block coordinates, slot, id; else null."""
    found = []
    if uuid is not None:
        found.append(F.when(F.size(uuid) == 4, F.concat(F.lit("uuid:"), F.array_join(uuid.cast("array<string>"), ","))))
    if most is not None and least is not None:
        found.append(F.when(most.isNotNull() & least.isNotNull(), F.concat(F.lit("uuid:"), most.cast("string"), F.lit(","), least.cast("string"))))
    if xyz is not None:
        x, y, z = (c.cast("string") for c in xyz)
        found.append(F.concat(F.lit("block:"), x, F.lit(","), y, F.lit(","), z))  # null if any is
    if slot is not None:
        found.append(F.concat(F.lit("slot:"), slot.cast("string")))
    if name is not None:
        found.append(F.concat(F.lit("id:"), name))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def id_matches(name: Column, wanted: str | None) -> Column:
    """No filter, the id itself, ``minecraft:`` before the filter, or a namespaced id that ends in it."""
    if wanted is None:
        return F.lit(True)
    return (name == wanted) | (name == f"minecraft:{wanted}") | name.endswith(f":{wanted}")


def sign_lines(front: Column, back: Column, old: list[Column]) -> Column:
    """Messages of both sides; without any the four old text fields; nulls left out."""
    none = F.expr("cast(array() as array<string>)")
    new = F.array_compact(F.concat(F.coalesce(front, none), F.coalesce(back, none)))
    return F.when(F.size(new) > 0, new).otherwise(F.array_compact(F.array(*old)))


def is_object_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def safe_ref_name(name: Column) -> Column:
    """255 characters at most, none of ``..``, backslash, NUL, a leading slash or dot."""
    bad = name.contains("..") | name.contains("\\") | name.contains("\0") | name.startswith("/") | name.startswith(".")
    return (F.length(name) > 0) & (F.length(name) <= 255) & ~bad


def passes_since_until(time: Column, since: int | None, until: int | None) -> Column:
    """Bounds on a text of unix seconds; a time that can't be read passes."""
    at = time.try_cast("bigint")
    out = F.lit(True)
    if since is not None:
        out = out & F.coalesce(at >= since, F.lit(True))
    if until is not None:
        out = out & F.coalesce(at <= until, F.lit(True))
    return out


def typed_value(text: Column) -> Column:
    """Tag of a JSON scalar's text: int, double, string, list, compound or none."""
    return (
        F.when(text.isNull(), "none")
        .when(text.rlike(r"^-?\d+$"), "int")
        .when(text.rlike(r"^-?\d+\.\d+([eE][-+]?\d+)?$"), "double")
        .when(text.startswith("["), "list")
        .when(text.startswith("{"), "compound")
        .otherwise("string")
    )
