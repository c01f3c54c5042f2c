"""SentencePiece encoding and decoding by suffix-array matching.

A text is cut where no piece can cross; the distinct segments of a batch are concatenated and their
suffixes sorted. A binary search for every piece gives its range of occurrences, each of which is
an edge of the segment's lattice. The edges, sorted by position, are then relaxed: the best way to
an end is the edge after which the segmentation is the one that the model's merges give. For a
byte-pair model that holds exactly if every two neighbouring pieces come out as themselves when
their joined text is merged alone, so one look at the last piece decides an edge, and the result
equals that of the model's own greedy merging.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_texts, tidy

SPACE = "▁"
#: Code points that one suffix array indexes, texts that are worked on at once, segments that a worker remembers.
INDEX_CHARS, BATCH_CHARS, REMEMBERED = 200_000, 2_000_000, 400_000
#: Longer segments are not remembered; those beyond the second are relaxed one edge after the other.
LONGEST_REMEMBERED, LONGEST_TOGETHER = 64, 200
#: Places of the table that keeps decisions on neighbouring pieces.
DECISIONS = 1 << 20


@dataclass
class Pieces:
    """What the codec needs of a model; plain data, so that it travels to executors.

    ``kinds``: n(ormal), b(yte), c(ontrol or unused), u(nknown).
    """

    pieces: list[str]
    scores: list[float]
    kinds: str
    unk_id: int
    dummy_prefix: bool = True
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    @property
    def codec(self) -> Codec:
        if "codec" not in self._made:
            self._made["codec"] = Codec(self)
        return self._made["codec"]


def load_pieces(model_path: str) -> Pieces:
    """Read a byte-pair model file on the driver; its normaliser must be the identity."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    kinds = "".join("u" if sp.is_unknown(i) else "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unused(i) else "n" for i in range(n))
    probe = sp.encode("a  Ａ", out_type=str)
    if "".join(probe).count(SPACE) < 2 or "Ａ" not in sp.decode(sp.encode("a  Ａ")):
        raise ValueError("only models with the identity normaliser are supported")
    return Pieces([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds, sp.unk_id(), probe[0].startswith(SPACE))


class Codec:
    def __init__(self, p: Pieces) -> None:
        self.p = p
        self.id_of = {s: i for i, (s, k) in enumerate(zip(p.pieces, p.kinds, strict=True)) if k == "n" and s}
        self.longest = max(map(len, self.id_of), default=1)
        self.bytes_of = {int(s[3:5], 16): i for i, (s, k) in enumerate(zip(p.pieces, p.kinds, strict=True)) if k == "b"}
        multi = [s for s in self.id_of if len(s) > 1]
        self.cuts = all(SPACE not in s.lstrip(SPACE) for s in multi)
        joined = "".join(re.escape(c) for c in sorted({c for s in multi for c in s} - {SPACE}))
        word = f"[{joined}]+" if joined else "(?!)"
        self.segments = re.compile(f"{SPACE}*{word}|{SPACE}+|." if self.cuts else ".+", re.DOTALL).findall
        names = sorted(self.id_of)
        self.piece_ids = np.array([self.id_of[s] for s in names])
        self.piece_len = np.array([len(s) for s in names])
        self.width = self.longest + 1
        keys = np.zeros((len(names), self.width), np.uint32)
        for row, s in zip(keys, names, strict=True):
            row[: len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32) + 1
        upper = keys.copy()
        upper[np.arange(len(names)), self.piece_len] = 0x110001  # above every code
        self.lower_keys, self.upper_keys = (k.view(f"<U{self.width}").ravel() for k in (keys, upper))
        self.steps_of: dict[int, list[tuple[float, str, str]]] = {}
        self.keys, self.values = np.full(DECISIONS, -1, np.int64), np.zeros(DECISIONS, bool)
        self.sizes = np.array([len(s) for s in p.pieces])
        self.seen: dict[str, bytes] = {}
        self.out = [b"" if k == "c" else bytes([int(s[3:5], 16)]) if k == "b" else " ⁇ ".encode() if k == "u" else s.replace(SPACE, " ").encode() for s, k in zip(p.pieces, p.kinds, strict=True)]

    def merged(self, text: str) -> list[tuple[float, str, str]]:
        """The model's merging: again and again the pair with the best score, the leftmost of equals.

        Gives the score of each merge (the first entry stands for none) and the first and last part after it.
        """
        parts, score, id_of = list(text), self.p.scores, self.id_of
        steps = [(0.0, parts[0], parts[-1])]
        while len(parts) > 1:
            found = [(-score[i], k) for k in range(len(parts) - 1) if (i := id_of.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            worst, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            steps.append((-worst, parts[0], parts[-1]))
        return steps if len(parts) == 1 else []

    def steps(self, piece: int) -> list[tuple[float, str, str]]:
        """The merges by which a piece comes about; none if merging its text gives others."""
        if (known := self.steps_of.get(piece)) is None:
            known = self.steps_of[piece] = self.merged(self.p.pieces[piece])
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: the segment's start; under -1: an unknown character).

        Both pieces' merges go on side by side in the order of their scores; the pieces stay apart
        unless joining the parts that meet has the best score at some time (of equals the leftmost).
        """
        if b < -1:
            return True
        right = self.steps(b)
        if a < 0 or not right:
            return bool(right)
        left, score, id_of = self.steps(a), self.p.scores, self.id_of
        i = j = 0
        while True:
            own = left[i + 1][0] if i + 1 < len(left) else -math.inf
            other = right[j + 1][0] if j + 1 < len(right) else -math.inf
            joint = id_of.get(left[i][2] + right[j][1])
            if joint is not None and score[joint] > own and score[joint] >= other:
                return False
            if own == other == -math.inf:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fit` of many pairs; what is known is looked up in a table that new pairs overwrite."""
        key = (a.astype(np.int64) + 2) * (len(self.p.pieces) + 1) + b
        place = (key * 0x9E3779B1 >> 7) & DECISIONS - 1
        out, unknown = self.values[place], np.flatnonzero(self.keys[place] != key)
        if len(unknown):
            _, first, which = np.unique(key[unknown], return_index=True, return_inverse=True)
            new = unknown[first]
            found = np.fromiter(map(self.fit, a[new].tolist(), b[new].tolist()), bool, len(new))
            out[unknown] = found[which]
            self.keys[place[new]], self.values[place[new]] = key[new], found
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and piece of every occurrence in ``codes`` (code points + 1; 0 between segments)."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(self.width, np.uint32)))
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[:n]).view(f"<U{self.width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        low = np.searchsorted(suffixes, self.lower_keys)
        count = np.searchsorted(suffixes, self.upper_keys) - low
        hit = np.flatnonzero(count)
        low, count = low[hit], count[hit]
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return order[at], np.repeat(self.piece_len[hit], count), np.repeat(self.piece_ids[hit], count)

    def bare(self, char: str) -> bytes:
        """The ids (int32) of a character that is no piece."""
        ids = [self.bytes_of.get(x, self.p.unk_id) for x in char.encode()] if self.bytes_of else [self.p.unk_id]
        return np.array(ids, np.int32).tobytes()

    def relax(self, segments: list[str]) -> list[bytes]:
        """The ids (int32) of segments of at most LONGEST_TOGETHER characters, all of which are pieces.

        The edges are sorted by where they end in their segment, and all segments go forward together.
        """
        out: list[bytes] = []
        for run in _runs([len(s) + 1 for s in segments], INDEX_CHARS):
            part = segments[run]
            size = np.array([len(s) for s in part])
            codes = np.frombuffer(("\0".join(part) + "\0").encode("utf-32-le"), np.uint32) + np.uint32(1)
            stops = np.cumsum(size + 1) - 1
            codes[stops] = 0
            starts = stops - size
            offset = np.arange(len(codes)) - np.repeat(starts, size + 1)
            begin, length, piece = self.edges(codes)
            stop_at = (offset[begin] + length).astype(np.int16)
            order = np.argsort(stop_at, kind="stable")
            begin, length, piece = begin[order], length[order], piece[order]
            bounds = np.searchsorted(stop_at[order], np.arange(1, size.max() + 2))
            last = np.full(len(codes), -2, np.int32)  # the piece that ends at a place; -2: no way leads there
            last[starts] = -1
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                b, p = begin[low:high], piece[low:high]
                a = last[b]
                way = a != -2
                b, p, n = b[way], p[way], length[low:high][way]
                ok = self.fit_all(a[way], p)
                last[b[ok] + n[ok]] = p[ok]
            at, own, found = stops.copy(), np.arange(len(part)), []
            while len(own):
                p = last[at]
                found.append((own, p))
                at = at - self.sizes[p]
                more = at > starts[own]
                at, own = at[more], own[more]
            owner = np.concatenate([o for o, _ in found][::-1])
            ids = np.concatenate([p for _, p in found][::-1])[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
            cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(part))) * 4)).tolist()
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def relax_long(self, segment: str) -> bytes:
        """The ids (int32) of one segment of any length, its edges taken in order, an index's share at a time."""
        codes = np.frombuffer(segment.encode("utf-32-le"), np.uint32) + np.uint32(1)
        n = len(codes)
        last: list[int | None] = [None] * (n + 1)
        last[0] = -1
        known: dict[tuple[int, int], bool] = {}
        later: list[tuple[int, int, int]] = []
        for at in range(0, n, INDEX_CHARS):
            part = codes[at : at + INDEX_CHARS + self.longest]
            begin, length, piece = self.edges(part)
            single = np.zeros(len(part), bool)
            single[begin[length == 1]] = True
            bare = np.flatnonzero(~single[:INDEX_CHARS])  # characters that are no piece
            begin, length = np.concatenate((begin, bare)), np.concatenate((length, np.ones(len(bare), np.int64)))
            piece = np.concatenate((piece, -1 - part[bare].astype(np.int64)))
            order = np.lexsort((begin, begin + length))
            order = order[begin[order] < INDEX_CHARS]
            here = zip((begin[order] + at).tolist(), (begin[order] + length[order] + at).tolist(), piece[order].tolist(), strict=True)
            rest, later, limit = sorted([*later, *here], key=lambda x: x[1]) if later else here, [], at + INDEX_CHARS
            for b, e, p in rest:
                if e > limit:  # edges of the next share may end before
                    later.append((b, e, p))
                elif last[e] is None and (a := last[b]) is not None:
                    if (ok := known.get((a, p))) is None:
                        ok = known[a, p] = self.fit(a, p)
                        if len(known) > DECISIONS:
                            known.clear()
                    if ok:
                        last[e] = p
        out, at = [], n
        while at:
            p = last[at]
            out.append(np.array([p], np.int32).tobytes() if p >= 0 else self.bare(chr(-2 - p)))
            at -= len(self.p.pieces[p]) if p >= 0 else 1
        return b"".join(reversed(out))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids (int32) of each text; null and empty texts have none."""
        cut = [self.segments((SPACE if self.p.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = {s for s in set().union(*cut) if s not in self.seen}
        made = {s: self.bare(s) for s in new if len(s) == 1 and s not in self.id_of}  # no piece to look for
        rest = sorted((s for s in new if s not in made), key=len)
        short = [s for s in rest if len(s) <= LONGEST_TOGETHER] if self.cuts else []
        made.update(zip(short, self.relax(short), strict=True))
        made.update((s, self.relax_long(s)) for s in rest[len(short) :])
        self.seen.update((s, x) for s, x in made.items() if len(s) <= LONGEST_REMEMBERED)
        look = self.seen if all(len(s) <= LONGEST_REMEMBERED for s in made) else self.seen | made
        return [b"".join(map(look.__getitem__, s)) for s in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.p.dummy_prefix and text[:1] == " " else text


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``id, token_ids`` (array of int) for every row: whole texts, equal to the model's own encoding.

    With ``decoded``, a column of that name holds what the ids decode to, made in the same pass.

    Null and empty texts have no tokens; repeated rows stay; characters that the model lacks become
    byte pieces, or the unknown piece in a model without these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec
        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_pylist()
            for part in _runs(sizes, BATCH_CHARS):
                rows = b.slice(part.start, part.stop - part.start)
                got = codec.encode(rows.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, got)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), np.int32)))
                out = {id_col: rows.column(0), "token_ids": ids}
                if decoded:
                    out[decoded] = pa.array([codec.decode(np.frombuffer(x, np.int32)) for x in got], pa.string())
                yield pa.RecordBatch.from_pydict(out)
        codec.seen.clear()

    return for_texts(docs).select(id_col, text_col).mapInArrow(tidy(work), f"`{id_col}` {kind}, token_ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(tokens: DataFrame, pieces: Pieces, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each row's ids; null ids give null, ids out of range an error.

    Control pieces have no text; byte pieces that form no UTF-8 become replacement characters.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def text_of(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.value.codec
        for rows in ids:
            yield pa.array([None if x is None else codec.decode(np.asarray(x, np.int64)) for x in rows.to_pylist()], pa.string())

    return tokens.withColumn(out_col, text_of(ids_col))
