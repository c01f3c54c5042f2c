"""Listings and small documents on any file system that Spark reaches, through Hadoop's own client."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

#: Versions of a document that are kept beside the latest.
KEPT_VERSIONS = 20
_VERSION = re.compile(r"v(\d{12})\.json")


class Conflict(OSError):
    """Somebody else has written meanwhile."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's file sources name what is below it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def listing(spark: SparkSession, root: str) -> list[tuple[str, int, bool]]:
    """Relative path, length and whether it is a folder, of everything below ``root``; no name is left out."""
    fs, p = _fs(spark, root)
    base = len(qualified(spark, root)) + 1
    out, todo = [], [p]
    while todo:
        for s in fs.listStatus(todo.pop()):
            folder = s.isDirectory()
            out.append((s.getPath().toString()[base:], s.getLen(), folder))
            if folder:
                todo.append(s.getPath())
    return sorted(out)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))  # noqa: SLF001
    finally:
        stream.close()


# Versioned documents: ``v<number>.json`` in a folder, each written once -----------------------------------


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(p) if (m := _VERSION.fullmatch(s.getPath().getName())))


def read_latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The number of the last version and the document of the last whole one; a crash leaves a part at most."""
    numbers = _versions(spark, folder)
    for n in reversed(numbers):
        try:
            return numbers[-1], json.loads(read_bytes(spark, f"{folder}/v{n:012d}.json"))
        except ValueError:
            continue
    raise FileNotFoundError(folder)


def write_next(spark: SparkSession, folder: str, last: int, value: dict) -> int:
    """Write the version after ``last``, which fails if somebody else has written it; the number written."""
    fs, p = _fs(spark, f"{folder}/v{last + 1:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"{folder} has changed meanwhile") from e
        raise
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    for n in _versions(spark, folder):
        if n < last - KEPT_VERSIONS:
            delete(spark, f"{folder}/v{n:012d}.json")
    return last + 1
