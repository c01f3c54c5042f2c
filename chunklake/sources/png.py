"""A map of at most 2,560 pixels a side as PNG."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHUNKS = 160


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(width: int, height: int, rgb: bytes) -> bytes:
    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + _part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _part(b"IDAT", zlib.compress(rows, 6)) + _part(b"IEND", b"")


def render(pixels: DataFrame, most_chunks: int = MOST_CHUNKS) -> tuple[bytes, dict]:
    """The image and ``width, height, truncated``; a map of more chunks a side is cut around its middle.

    The rows that reach the driver are bounded by the side of the image.
    """
    box = pixels.agg(*(f(c).alias(n + c) for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max)))).first()
    if box["minx"] is None:
        return encode(1, 1, b"\0\0\0"), {"width": 0, "height": 0, "truncated": False}
    side, cut, low, size = 16 * most_chunks, False, {}, {}
    for c in ("x", "z"):
        a, b = box[f"min{c}"] // 16 * 16, box[f"max{c}"] // 16 * 16 + 15
        if b - a + 1 > side:
            a, b, cut = (a + b) // 32 * 16 - side // 2, (a + b) // 32 * 16 + side // 2 - 1, True
        low[c], size[c] = a, b - a + 1
    kept = pixels.where(F.col("x").between(low["x"], low["x"] + size["x"] - 1) & F.col("z").between(low["z"], low["z"] + size["z"] - 1))
    rgb = bytearray(3 * size["x"] * size["z"])
    for r in kept.select("x", "z", "r", "g", "b").toLocalIterator():
        at = 3 * ((r["z"] - low["z"]) * size["x"] + r["x"] - low["x"])
        rgb[at : at + 3] = bytes((r["r"], r["g"], r["b"]))
    return encode(size["x"], size["z"], bytes(rgb)), {"width": size["x"], "height": size["z"], "truncated": cut}
