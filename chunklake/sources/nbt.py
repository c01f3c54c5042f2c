"""Typed trees: binary form, canonical bytes, tagged JSON, identity, paths.

A node is a pair ``(tag, value)``. Numbers hold int or float, 7 bytes, 8 str, 9 a list of nodes, 10 a
dict of nodes, 11 and 12 lists of ints.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct

Node = tuple

BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(1, 13)
#: The names of the tags in JSON.
TAG_NAMES = {BYTE: "byte", SHORT: "short", INT: "int", LONG: "long", FLOAT: "float", DOUBLE: "double", BYTES: "byteArray", STRING: "string", LIST: "list", COMPOUND: "compound", INTS: "intArray", LONGS: "longArray"}
TAGS_BY_NAME = {v: k for k, v in TAG_NAMES.items()}
_NUMBER = {BYTE: struct.Struct(">b"), SHORT: struct.Struct(">h"), INT: struct.Struct(">i"), LONG: struct.Struct(">q"), FLOAT: struct.Struct(">f"), DOUBLE: struct.Struct(">d")}
_WIDTH = {INTS: ("i", 4), LONGS: ("q", 8)}
MOST_DEPTH = 512


class BadData(ValueError):
    """Bytes, JSON or a path that can't be read."""


# Binary form --------------------------------------------------------------------------------------------


def _text(raw: bytes) -> str:
    """Java's modified UTF-8: NUL in two bytes, characters beyond the base plane as two surrogates."""
    try:
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    except UnicodeDecodeError as e:
        raise BadData(str(e)) from e


def _raw(text: str) -> bytes:
    units = text.encode("utf-16-le", "surrogatepass")
    halves = "".join(map(chr, struct.unpack(f"<{len(units) // 2}H", units)))
    return halves.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadData("data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, tag: int) -> float:
        return _NUMBER[tag].unpack(self.take(_NUMBER[tag].size))[0]

    def text(self) -> str:
        return _text(self.take(int.from_bytes(self.take(2), "big")))

    def payload(self, tag: int, depth: int) -> Node:
        if depth > MOST_DEPTH:
            raise BadData("nested too deeply")
        if tag in _NUMBER:
            return tag, self.number(tag)
        if tag == STRING:
            return tag, self.text()
        if tag == BYTES:
            return tag, self.take(self.number(INT))
        if tag in _WIDTH:
            n = self.number(INT)
            code, width = _WIDTH[tag]
            return tag, list(struct.unpack(f">{max(n, 0)}{code}", self.take(n * width)))
        if tag == LIST:
            kind, n = self.take(1)[0], self.number(INT)
            if n > len(self.data):
                raise BadData("list longer than its data")
            return tag, [self.payload(kind, depth + 1) for _ in range(n)] if n > 0 else []
        if tag == COMPOUND:
            out: dict[str, Node] = {}
            while kind := self.take(1)[0]:
                name = self.text()
                out[name] = self.payload(kind, depth + 1)
            return tag, out
        raise BadData(f"unknown tag {tag}")


def read(data: bytes) -> tuple[str, Node]:
    """Name and root of a binary tree; the root must be a compound."""
    r = _Reader(data)
    if r.take(1) != bytes([COMPOUND]):
        raise BadData("the root is no compound")
    name = r.text()
    return name, r.payload(COMPOUND, 0)


def _payload(node: Node, ordered: bool, out: bytearray) -> None:
    tag, v = node
    if tag in _NUMBER:
        out += _NUMBER[tag].pack(v)
    elif tag == STRING:
        raw = _raw(v)
        out += len(raw).to_bytes(2, "big") + raw
    elif tag == BYTES:
        out += len(v).to_bytes(4, "big") + bytes(v)
    elif tag in _WIDTH:
        out += len(v).to_bytes(4, "big") + struct.pack(f">{len(v)}{_WIDTH[tag][0]}", *v)
    elif tag == LIST:
        kind = v[0][0] if v else 0
        if any(x[0] != kind for x in v):
            raise BadData("a list holds one type")
        out += bytes([kind]) + len(v).to_bytes(4, "big")
        for x in v:
            _payload(x, ordered, out)
    else:
        for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass")) if ordered else v:
            raw = _raw(k)
            out += bytes([v[k][0]]) + len(raw).to_bytes(2, "big") + raw
            _payload(v[k], ordered, out)
        out.append(0)


def write(root: Node, name: str = "", ordered: bool = False) -> bytes:
    raw = _raw(name)
    out = bytearray(bytes([COMPOUND]) + len(raw).to_bytes(2, "big") + raw)
    _payload(root, ordered, out)
    return bytes(out)


def canonical(root: Node) -> bytes:
    """Bytes that equal trees share: keys sorted at every level, no root name."""
    return write(root, "", True)


def object_id(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


# Tagged JSON --------------------------------------------------------------------------------------------


def _plain_float(x: float) -> str:
    return "NaN" if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else repr(x)


def to_tagged(node: Node) -> dict:
    tag, v = node
    if tag == LONG:
        body = str(v)
    elif tag in (FLOAT, DOUBLE):
        body = _plain_float(v)
    elif tag == BYTES:
        body = [x - 256 if x > 127 else x for x in v]
    elif tag == LIST:
        body = [to_tagged(x) for x in v]
    elif tag == COMPOUND:
        body = {k: to_tagged(x) for k, x in v.items()}
    elif tag == LONGS:
        body = [str(x) for x in v]
    else:
        body = v
    return {TAG_NAMES[tag]: body}


def from_tagged(value: object) -> Node:
    if not isinstance(value, dict) or len(value) != 1:
        raise BadData("a value is an object with one tag")
    (name, body), = value.items()
    if name not in TAGS_BY_NAME:
        raise BadData(f"unknown tag {name!r}")
    tag = TAGS_BY_NAME[name]
    try:
        if tag in (BYTE, SHORT, INT, LONG):
            bits = 8 * _NUMBER[tag].size
            n = int(body) & (1 << bits) - 1
            return tag, n - (1 << bits) if n >> bits - 1 else n
        if tag in (FLOAT, DOUBLE):
            return tag, float(body)
        if tag == BYTES:
            return tag, bytes(int(x) & 255 for x in body)
        if tag == STRING:
            return tag, str(body)
        if tag == LIST:
            return tag, [from_tagged(x) for x in body]
        if tag == COMPOUND:
            return tag, {k: from_tagged(x) for k, x in body.items()}
        return tag, [int(x) for x in body]
    except (TypeError, AttributeError, ValueError) as e:
        raise BadData(str(e)) from e


def to_json(node: Node) -> str:
    return json.dumps(to_tagged(node), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> Node:
    try:
        return from_tagged(json.loads(text))
    except json.JSONDecodeError as e:
        raise BadData(str(e)) from e


def brief(node: Node | None) -> str | None:
    """A short form for people."""
    if node is None:
        return None
    tag, v = node
    if tag == STRING:
        return f'"{v}"'
    if tag == LIST:
        return f"[{len(v)} items]"
    if tag == COMPOUND:
        return f"{{{len(v)} keys}}"
    if tag in (BYTES, INTS, LONGS):
        return f"[{len(v)} {'bytes' if tag == BYTES else TAG_NAMES[tag].removesuffix('Array') + 's'}]"
    if tag in (FLOAT, DOUBLE):
        return str(int(v)) if math.isfinite(v) and v == int(v) and abs(v) < 1e16 else repr(v)
    return str(v)


def same(a: Node, b: Node) -> bool:
    """Equality of trees: NaN differs from itself, key order doesn't count, 0.0 equals -0.0."""
    if a[0] != b[0]:
        return False
    x, y = a[1], b[1]
    if a[0] == COMPOUND:
        return x.keys() == y.keys() and all(same(v, y[k]) for k, v in x.items())
    if a[0] == LIST:
        return len(x) == len(y) and all(map(same, x, y))
    return x == y


# Identity and paths -------------------------------------------------------------------------------------


def _int(node: Node | None) -> int | None:
    return node[1] if node is not None and node[0] in (BYTE, SHORT, INT, LONG) else None


def identity(node: Node) -> str | None:
    """UUID of four ints, legacy halves, coordinates, slot, id; null without any."""
    if node[0] != COMPOUND:
        return None
    v = node[1]
    if (u := v.get("UUID")) is not None and u[0] == INTS and len(u[1]) == 4:
        return "uuid:" + ",".join(map(str, u[1]))
    if (m := v.get("UUIDMost")) is not None and (n := v.get("UUIDLeast")) is not None and m[0] == n[0] == LONG:
        return f"uuid:{m[1]},{n[1]}"
    xyz = [v.get(c) for c in "xyz"]
    if all(c is not None and c[0] == INT for c in xyz):
        return "block:" + ",".join(str(c[1]) for c in xyz)
    if (s := v.get("Slot")) is not None and s[0] == BYTE:
        return f"slot:{s[1]}"
    if (i := v.get("id")) is not None and i[0] == STRING:
        return f"id:{i[1]}"
    return None


def parse_path(text: str) -> list[str | int]:
    """``a.b[0][id:x]`` to segments: names, indices, identities (which keep their brackets' text with a ``\\0`` before)."""
    out: list[str | int] = []
    at = 0
    while at < len(text):
        if text[at] == "[":
            end = text.find("]", at)
            inner = text[at + 1 : end] if end >= 0 else ""
            if not inner:
                raise BadData("a bracket is empty or not closed")
            out.append(int(inner) if inner.isdecimal() else f"\0{inner}")
            at = end + 1
        else:
            end = min((i for i in (text.find(".", at), text.find("[", at)) if i >= 0), default=len(text))
            if end == at and text[at] == ".":
                at += 1
                continue
            out.append(text[at:end])
            at = end + (end < len(text) and text[end] == ".")
    if not out:
        raise BadData("the path is empty")
    return out


def path_text(segments: list[str | int]) -> str:
    out = ""
    for s in segments:
        out += f"[{s}]" if isinstance(s, int) else f"[{s[1:]}]" if s.startswith("\0") else f".{s}" if out else s
    return out


def _place(node: Node | None, s: str | int) -> int | str | None:
    """Where segment ``s`` stands in ``node``, else null."""
    if node is None:
        return None
    if isinstance(s, int):
        return s if node[0] == LIST and s < len(node[1]) else None
    if s.startswith("\0"):
        return next((i for i, x in enumerate(node[1]) if identity(x) == s[1:]), None) if node[0] == LIST else None
    return s if node[0] == COMPOUND and s in node[1] else None


def get(root: Node, path: list[str | int]) -> Node | None:
    node: Node | None = root
    for s in path:
        at = _place(node, s)
        node = None if at is None else node[1][at]
    return node


def put(root: Node, path: list[str | int], value: Node) -> bool:
    """Replace, add a key, append at an index equal to the length or under a new identity; False without the parent."""
    parent = get(root, path[:-1])
    s = path[-1]
    if parent is None:
        return False
    if (at := _place(parent, s)) is not None:
        parent[1][at] = value
    elif parent[0] == COMPOUND and isinstance(s, str) and not s.startswith("\0"):
        parent[1][s] = value
    elif parent[0] == LIST and (s == len(parent[1]) or isinstance(s, str) and s.startswith("\0")):
        parent[1].append(value)
    else:
        return False
    return True


def drop(root: Node, path: list[str | int]) -> bool:
    parent = get(root, path[:-1])
    at = _place(parent, path[-1])
    if at is None:
        return False
    del parent[1][at]
    return True


# Differences --------------------------------------------------------------------------------------------


def _keyed(items: list[Node]) -> dict[str, Node] | None:
    """Entries by identity if each has one of its own; an empty list has no identities."""
    found = {k: x for x in items if (k := identity(x)) is not None}
    return found if items and len(found) == len(items) else None


def changes(a: Node, b: Node, path: tuple = ()) -> list[tuple[tuple, str, Node | None, Node | None]]:
    """``(segments, kind, old, new)``: added, removed, modified, type_changed; arrays are one value."""
    if a[0] != b[0]:
        return [(path, "type_changed", a, b)]
    pairs: list[tuple[str | int, Node | None, Node | None]]
    if a[0] == COMPOUND:
        pairs = [(k, a[1].get(k), b[1].get(k)) for k in sorted({*a[1], *b[1]})]
    elif a[0] == LIST:
        x, y = _keyed(a[1]), _keyed(b[1])
        if x is not None and y is not None:
            pairs = [(f"\0{k}", x.get(k), y.get(k)) for k in sorted({*x, *y})]
        else:
            pairs = [(i, a[1][i] if i < len(a[1]) else None, b[1][i] if i < len(b[1]) else None) for i in range(max(len(a[1]), len(b[1])))]
    else:
        return [] if a[1] == b[1] else [(path, "modified", a, b)]
    out = []
    for s, old, new in pairs:
        here = (*path, s)
        if old is None:
            out.append((here, "added", None, new))
        elif new is None:
            out.append((here, "removed", old, None))
        else:
            out += changes(old, new, here)
    return out


def apply(root: Node, ops: list[tuple[tuple, Node | None, Node | None]], force: bool = False) -> list[str]:
    """Do ``(segments, from, to)`` in place where the tree is as ``from`` says; the paths that conflict.

    Removals from a list go from its end, so that the indices of the others hold.
    """
    bad = []
    removals = sorted((o for o in ops if o[2] is None), key=lambda o: [(isinstance(s, int), s if isinstance(s, int) else 0, str(s)) for s in o[0]], reverse=True)
    for path, old, new in [o for o in ops if o[2] is not None] + removals:
        now = get(root, list(path))
        fits = now is None if old is None else now is not None and same(now, old)
        if not fits and not force or not (drop(root, list(path)) if new is None else put(root, list(path), new)):
            bad.append(path_text(list(path)))
    return bad
