"""Region files: 32 x 32 chunks in sectors of 4 KiB, their compression, and oversized bodies beside them."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from typing import NamedTuple

import pyarrow as pa

SECTOR, HEADER, CHUNKS = 4096, 8192, 1024
GZIP, ZLIB, PLAIN, LZ4, CUSTOM = 1, 2, 3, 4, 127
MOST_INFLATED = MOST_EXTERNAL = 128 << 20
MOST_SECTORS = 255
_NAME = re.compile(r"(?:^|/)r\.(-?\d+)\.(-?\d+)\.mca$")


class BadRegion(ValueError):
    """A region name, chunk or body that can't be read."""


class Chunk(NamedTuple):
    x: int
    z: int
    compression: int
    payload: bytes | None
    external: bool
    timestamp: int


def region_name(path: str) -> tuple[int, int]:
    m = _NAME.search(path)
    if not m:
        raise BadRegion(f"{path} is no region's name")
    return int(m[1]), int(m[2])


def parse(path: str, data: bytes) -> list[Chunk]:
    """The chunks that are there; those with places, lengths or schemes that make no sense are left out.

    An external chunk has no payload here: its body is the file ``c.X.Z.mcc`` beside the region.
    """
    rx, rz = region_name(path)
    out = []
    if len(data) < HEADER:
        return out
    places, times = struct.unpack_from(">1024I", data), struct.unpack_from(">1024i", data, SECTOR)
    for i, place in enumerate(places):
        start, sectors = (place >> 8) * SECTOR, place & 255
        if not start or not sectors or start + 5 > len(data):
            continue
        length, kind = struct.unpack_from(">iB", data, start)
        scheme = kind & 127
        if length <= 0 or scheme not in (GZIP, ZLIB, PLAIN, LZ4, CUSTOM):
            continue
        body = None if kind & 128 else data[start + 5 : start + 4 + length]
        if body == b"":
            continue
        out.append(Chunk(rx * 32 + i % 32, rz * 32 + i // 32, scheme, body, bool(kind & 128), times[i]))
    return out


def build(chunks: list[Chunk]) -> tuple[bytes, dict[str, bytes]]:
    """A region file and the external bodies by name; chunks go by their place in the header."""
    places, times, body, outside = [0] * CHUNKS, [0] * CHUNKS, bytearray(), {}
    sector = HEADER // SECTOR
    for c in sorted(chunks, key=lambda c: (c.z & 31, c.x & 31)):
        i = (c.x & 31) + (c.z & 31) * 32
        large = -(-(len(c.payload) + 5) // SECTOR) > MOST_SECTORS
        if large:
            outside[f"c.{c.x}.{c.z}.mcc"] = c.payload
        raw = struct.pack(">iB", 1 if large else len(c.payload) + 1, c.compression | (128 if large else 0)) + (b"" if large else c.payload)
        n = -(-len(raw) // SECTOR)
        body += raw.ljust(n * SECTOR, b"\0")
        places[i], times[i] = sector << 8 | n, c.timestamp
        sector += n
    return struct.pack(">1024I", *places) + struct.pack(">1024i", *times) + bytes(body), outside


def inflate(scheme: int, payload: bytes, most: int = MOST_INFLATED) -> bytes:
    """The bytes under a scheme; more than ``most`` is an error, and so are custom schemes."""
    if scheme == PLAIN:
        out = payload
    elif scheme in (GZIP, ZLIB):
        d = zlib.decompressobj(31 if scheme == GZIP else 15)
        try:
            out = d.decompress(payload, most + 1)
        except zlib.error as e:
            raise BadRegion(str(e)) from e
        if not d.eof and len(out) <= most:
            raise BadRegion("compressed data ends early")
    elif scheme == LZ4:
        try:
            with pa.input_stream(pa.BufferReader(payload), compression="lz4") as s:
                out = s.read(most + 1)
        except OSError as e:
            raise BadRegion(str(e)) from e
    else:
        raise BadRegion(f"scheme {scheme} can't be read")
    if len(out) > most:
        raise BadRegion("inflated data is too large")
    return out


def deflate(scheme: int, data: bytes, level: int = 6) -> bytes:
    if scheme == PLAIN:
        return data
    if scheme == GZIP:
        return gzip.compress(data, level, mtime=0)
    if scheme == ZLIB:
        return zlib.compress(data, level)
    if scheme == LZ4:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as s:
            s.write(data)
        return sink.getvalue().to_pybytes()
    raise BadRegion(f"scheme {scheme} can't be written")


def unpack_file(data: bytes) -> bytes:
    """A stand-alone file's tree: gzip, zlib or plain by its first bytes."""
    if data[:2] == b"\x1f\x8b":
        return inflate(GZIP, data)
    if data[:1] == b"\x78":
        return inflate(ZLIB, data)
    return data
