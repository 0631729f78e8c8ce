"""SentencePiece BPE: exact encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tallyloom.llm import common

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Encoded segments and checked pairs that a worker remembers, and the longest segment worth remembering.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64

codecs.register_error("tallyloom-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file; its size is that of the vocabulary, not of any text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    add_prefix: bool
    begin: int
    end: int
    unknown: int
    mergeable: frozenset[int] = field(default=frozenset())


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a BPE model file, read by the driver.

    Models that normalise characters, drop repeated blanks, put blanks behind words, or hold user-defined or unused
    pieces encode by further rules and are refused.
    """
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules, trainer = proto.normalizer_spec, proto.trainer_spec
    kinds = tuple(p.type for p in proto.pieces)
    if trainer.model_type != trainer.BPE or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models without user-defined and unused pieces are supported")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("only models that keep the text as it is and mark blanks before words are supported")
    if kinds.count(BYTE) not in (0, 256):
        raise ValueError("byte pieces must be complete")
    pieces = tuple(p.piece for p in proto.pieces)
    vocabulary = Vocabulary(pieces, tuple(p.score for p in proto.pieces), kinds, rules.add_dummy_prefix, trainer.bos_id,
                            trainer.eos_id, trainer.unk_id)
    merger = Merger(vocabulary)
    good = frozenset(i for i, p in enumerate(pieces) if kinds[i] == NORMAL and merger.merge(p) == [i])
    return Vocabulary(**{**vars(vocabulary), "mergeable": good})


class Merger:
    """Plain merging of a short string: the best-scored pair first, the left one among equals."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == NORMAL}
        self.scores = vocabulary.scores

    def steps(self, parts: list[str]) -> Iterator[tuple[float, list[str]]]:
        """The score of each merge, and the parts after it."""
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            yield best, parts

    def merge(self, text: str) -> list[int]:
        """Ids of the merged parts; -1 for a character without a piece."""
        parts = list(text)
        for _ in self.steps(parts):
            pass
        return [self.ids.get(p, -1) for p in parts]


class Edges:
    """What merging a piece by itself does to its outer parts: the score of each merge, and the first and last part after it."""

    def __init__(self, merger: Merger, piece: str) -> None:
        self.first, self.last, self.scores = [piece[0]], [piece[-1]], []
        for score, parts in merger.steps(list(piece)):
            self.scores.append(score)
            self.first.append(parts[0])
            self.last.append(parts[-1])
        self.scores.append(float("-inf"))


class LongestMatches:
    """Aho-Corasick over the reversed pieces: read from the end, every character tells the longest piece that starts with it.

    Each state keeps the longest of the pieces that end there, so no shorter match is ever listed.
    """

    def __init__(self, pieces: dict[str, int]) -> None:
        leaf: dict[str, int] = {}
        go, best = [{}], [-1]
        for piece, number in pieces.items():
            state = 0
            for c in reversed(piece):
                if go[state] is leaf:
                    go[state] = {}
                state = go[state].setdefault(c, len(go))
                if state == len(go):
                    go.append(leaf)
                    best.append(-1)
            best[state] = number
        fail = [0] * len(go)
        level = [(0, c, s) for c, s in go[0].items()]
        while level:
            for parent, c, state in level:
                at = fail[parent]
                while at and c not in go[at]:
                    at = fail[at]
                fail[state] = go[at].get(c, 0) if parent else 0
                if best[state] < 0:
                    best[state] = best[fail[state]]
            level = [(state, c, s) for _, _, state in level for c, s in go[state].items()]
        self.go, self.fail, self.best = go, fail, best

    def starting(self, text: str) -> list[int]:
        """The longest piece that starts at each place of the text, all of whose characters are pieces."""
        go, fail, best = self.go, self.fail, self.best
        state, out = 0, []
        for c in reversed(text):
            follow = go[state].get(c)
            while follow is None:
                state = fail[state]
                follow = go[state].get(c)
            state = follow
            out.append(best[state])
        out.reverse()
        return out


class Encoder:
    """Encodes whole texts exactly as merging does, in time linear in the text.

    A sequence of pieces is what merging yields if each piece merges to itself and every two neighbours, merged again from
    their characters, stay the same two pieces. So the encoder walks from left to right with the longest piece that
    starts at each place (one Aho-Corasick pass over the reversed segment finds them all), takes the next shorter
    prefix piece where neighbours do not fit, and goes back one piece where none fits. A bit for each place remembers that
    no way leads on from there, so no place is tried twice.

    Merges never cross a character without a piece, nor a place between two characters that no piece holds side by side;
    the text is cut there, and recurring segments are looked up.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.merger = vocabulary, Merger(vocabulary)
        self.text = vocabulary.pieces
        self.size = [len(p) for p in vocabulary.pieces]
        usable = {vocabulary.pieces[i]: i for i in sorted(vocabulary.mergeable)}
        self.matches = LongestMatches(usable)
        self.shorter = [-1] * len(self.text)
        for piece, i in usable.items():
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in usable:
                    self.shorter[i] = usable[piece[:n]]
                    break
        self.single = {p: struct.pack("<I", i) for p, i in usable.items() if len(p) == 1}
        self.bytes = dict(zip((int(p[3:5], 16) for i, p in enumerate(self.text) if vocabulary.kinds[i] == BYTE),
                              (i for i, k in enumerate(vocabulary.kinds) if k == BYTE)))
        self.inside = {pair for p in usable for pair in zip(p, p[1:])}
        self.cut = re.compile(self._segments(), re.S)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.edges: dict[int, Edges] = {}
        self.fits: list[dict[int, bool]] = [{} for _ in self.text]
        self.checked = 0

    def _segments(self) -> str:
        """Where texts are cut for lookup: before blanks and behind words, if no piece goes on there, and around unknown characters."""
        letters = "".join(re.escape(c) for c in self.single if c.isalpha())
        others = "".join(re.escape(c) for c in self.single if not c.isalpha() and c != SPACE)
        known = letters + others + (SPACE if SPACE in self.single else "")
        if not (letters and others) or any(a != SPACE and b == SPACE for a, b in self.inside):
            return f"[{known}]+|." if known else "."
        if any(a.isalpha() and not b.isalpha() for a, b in self.inside):
            return f"{SPACE}+[{letters}{others}]*|[{letters}{others}]+|."
        return f"{SPACE}++[{others}]*+[{letters}]*+|[{others}]++[{letters}]*+|[{letters}]++|."

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, merged again from their characters, stay apart where they are.

        Until a merge crosses the place between them, each side merges as it does alone. So the next merge is the best of
        the next one on the left, the one across, and the next one on the right, in this order among equals.
        """
        a, b = self._edges(left), self._edges(right)
        ids, scores, i, j, fits = self.merger.ids, self.merger.scores, 0, 0, True
        while True:
            across = ids.get(a.last[i] + b.first[j])
            most = float("-inf") if across is None else scores[across]
            if a.scores[i] >= max(most, b.scores[j]) and i + 1 < len(a.scores):
                i += 1
            elif across is not None and most >= b.scores[j]:
                fits = False
                break
            elif j + 1 < len(b.scores):
                j += 1
            else:
                break
        if self.checked >= REMEMBERED:
            self.checked = 0
            for row in self.fits:
                row.clear()
        self.checked += 1
        self.fits[left][right] = fits
        return fits

    def _edges(self, piece: int) -> Edges:
        found = self.edges.get(piece)
        if found is None:
            found = self.edges[piece] = Edges(self.merger, self.text[piece])
        return found

    def backtrack(self, segment: str) -> list[int]:
        """Ids of a segment all of whose characters have a piece."""
        n, size, shorter, rows = len(segment), self.size, self.shorter, self.fits
        longest = self.matches.starting(segment)
        failed, some_failed = bytearray(n // 8 + 1), False
        piece = longest[0]
        out, at = [piece], size[piece]  # a single piece always fits the start; shorter ones follow by going back
        while at < n:
            left, piece = out[-1], longest[at]
            row = rows[left]
            while True:
                end = at + size[piece]
                if not (some_failed and failed[end >> 3] >> (end & 7) & 1):
                    fits = row.get(piece)
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if fits:
                        out.append(piece)
                        at = end
                        break
                piece = shorter[piece]
                if piece >= 0:
                    continue
                while piece < 0:  # no piece fits here, so the one before is at fault: its next shorter prefix
                    failed[at >> 3] |= 1 << (at & 7)
                    some_failed = True
                    at -= size[out[-1]]
                    piece = shorter[out.pop()]
                if out:
                    left = out[-1]
                    row = rows[left]
                else:
                    piece = self._first(piece, failed)
                    out.append(piece)
                    at = size[piece]
                    break
        return out

    def _first(self, piece: int, failed: bytearray) -> int:
        """The longest prefix piece from ``piece`` on that does not end where no way leads on."""
        while failed[self.size[piece] >> 3] >> (self.size[piece] & 7) & 1:
            piece = self.shorter[piece]
        return piece

    def segment(self, segment: str) -> bytes:
        """Packed ids of a segment that was not used lately; the older half of what is remembered is dropped in turn."""
        found = self.known.get(segment) or self.older.get(segment)
        if found is None:
            ends = [] if segment[1:].isalpha() else [
                i for i, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in self.inside]
            if ends:
                known = self.known.get
                parts = [segment[a:b] for a, b in zip([0, *ends], [*ends, len(segment)])]
                found = b"".join([known(p) or self.remember(p, self.older.get(p) or self.whole(p)) for p in parts])
            else:
                found = self.whole(segment)
        return self.remember(segment, found)

    def remember(self, segment: str, ids: bytes) -> bytes:
        if len(segment) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[segment] = ids
        return ids

    def whole(self, segment: str) -> bytes:
        """Packed ids of characters that have pieces, or of one that has none."""
        if len(segment) > 1 or segment in self.single:
            ids = self.backtrack(segment)
        elif self.bytes:
            ids = [self.bytes[b] for b in segment.encode()]
        else:
            ids = [self.vocabulary.unknown]
        return array("I", ids).tobytes()

    def encode(self, text: str | None, begin: bool, end: bool) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        marked = (text or "").replace(" ", SPACE)
        if marked and self.vocabulary.add_prefix:
            marked = SPACE + marked
        known, made = self.known.get, self.segment
        body = [known(s) or made(s) for s in self.cut.findall(marked)]
        if not self.bytes:
            body = _unknown_runs(body, struct.pack("<I", self.vocabulary.unknown))
        first = struct.pack("<I", self.vocabulary.begin) if begin else b""
        last = struct.pack("<I", self.vocabulary.end) if end else b""
        return b"".join([first, *body, last])


def _unknown_runs(body: list[bytes], unknown: bytes) -> list[bytes]:
    """Without byte pieces, neighbouring unknown characters form one unknown piece."""
    return [x for i, x in enumerate(body) if not (x == unknown and i and body[i - 1] == unknown)]


class Decoder:
    """Texts of id sequences: byte pieces join to characters, a broken byte becomes U+FFFD, control pieces vanish."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.raw = []
        self.control = np.array([i for i, kind in enumerate(vocabulary.kinds) if kind == CONTROL], np.uint32)
        for piece, kind in zip(vocabulary.pieces, vocabulary.kinds):
            if kind == BYTE:
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                self.raw.append(b"")
            else:
                self.raw.append((UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(SPACE, " ")).encode())

    def decode(self, ids: bytes | None) -> str:
        found = np.frombuffer(ids or b"", "<u4")
        raw = list(map(self.raw.__getitem__, found.tolist()))
        if self.vocabulary.add_prefix:
            first = next((i for i, x in enumerate(raw) if x), None)  # the blank that encoding put before the text
            if first is not None and raw[first][:1] == b" " and self.vocabulary.kinds[found[first]] == NORMAL:
                raw[first] = raw[first][1:]
        parts, start = [], 0
        for at in [*np.flatnonzero(np.isin(found, self.control)).tolist(), len(raw)]:  # bytes do not join across these
            parts.append(b"".join(raw[start:at]).decode("utf-8", "tallyloom-each-byte"))
            start = at
        return "".join(parts)


_WORKER: dict[tuple[type, int], tuple[Vocabulary, Encoder | Decoder]] = {}


def _tool(kind: type, shared: Broadcast) -> Encoder | Decoder:
    """The worker's encoder or decoder, built once for each vocabulary."""
    held = _WORKER.get((kind, hash(shared.value)))
    if held is None or held[0] != shared.value:
        held = (shared.value, kind(shared.value))
        _WORKER[kind, hash(shared.value)] = held
    return held[1]


def encode(docs: DataFrame, model: str, *, text: str = "text", begin: bool = True, end: bool = True,
           carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``, the ids of the whole text as little-endian unsigned 32-bit integers.

    ``model``: path of a BPE model file that the driver reads; executors get its vocabulary. Ids equal those of the
    library that the file belongs to. ``carry``: the input columns to keep (all by default).

    A null text counts as empty, and an empty text has no ids but those of ``begin`` and ``end``. Repeated rows are all
    returned; an empty table gives no rows. Input columns named n_tokens or ids are replaced. A text of any length is
    one row: it needs memory for its ids, and for one number a character of a run without a blank.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    known = common.without(docs, *[c for c in ("n_tokens", "ids") if c != text])
    kept = [c for c in known.columns if (carry is None or c in carry) and c.lower() not in ("n_tokens", "ids")]
    ready = known.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(Encoder, shared)
        for batch in batches:
            ids = [tool.encode(x.as_py(), begin, end) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens", "ids"])

    added = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    return ready.mapInArrow(run, StructType([*ready.drop("__text").schema.fields, *added]))


def decode(encoded: DataFrame, model: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of each id sequence.

    Null ids give an empty text. Repeated rows are all returned; an empty table gives no rows. An input column named decoded
    is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    ready = common.without(encoded, "decoded").withColumn("__ids", F.col(f"`{ids}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(Decoder, shared)
        for batch in batches:
            texts = [tool.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], "decoded"])

    return ready.mapInArrow(run, StructType([*ready.drop("__ids").schema.fields, StructField("decoded", StringType())]))


@F.pandas_udf(ArrayType(LongType()))
def as_array(ids: pd.Series) -> pd.Series:
    """Packed ids as an array of longs; null as an empty one."""
    return ids.map(lambda x: np.frombuffer(x or b"", "<u4").astype(np.int64))
