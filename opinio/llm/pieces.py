"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

Merging symbol pairs by score, leftmost first among equals, gives one sequence of pieces
for a text, and that sequence is the only one in which every two adjacent pieces are
*compatible*: merging the characters of the two alone gives the two again (a merge across
their border would show in any text that holds them). So a text is encoded without
merging it as a whole:

* an Aho-Corasick automaton of the pieces, run over the text, gives the longest piece after
  each one put; where a shorter one was taken, a walk down the automaton's tree of pieces
  gives the longest from there. Shorter ones are that piece's prefixes;
* pieces are put one after another, the longest first that is compatible with its
  predecessor (a pair's answer comes from re-merging its characters, and is kept);
* where none fits, the position is marked in a bitfield of failed positions, the last
  piece is taken back and a shorter one tried; a marked position is never ended at again,
  as the sequence up to a position is unique. So the work is linear in the text.

Characters outside the vocabulary stand as their UTF-8 bytes and end a stretch, as do line
breaks and tabs if no longer piece holds them. If no piece holds a space mark after another
character, the stretches between are encoded for themselves and kept in a bounded table
a worker (a pure saving: results don't depend on it).

Decoding puts the pieces' bytes together, drops the space that encoding put first, and gives
U+FFFD for each byte that belongs to no character.

The model file's path is a parameter; the driver reads the file (its size is checked) and
sends it along with the function. Supported are models of merge type with byte fallback,
no normalisation table and no user-defined pieces; others raise ``ValueError``. Nothing is shuffled or
collected; a worker holds the model, bounded tables and one batch of rows.

Edge cases: a null text is empty (begin and end ids only), null ids decode to an empty text;
repeated rows and ids give a row each; very long texts are worked off in slices cut between
stretches, never shortened; an empty table gives an empty result; other columns are kept as they are, a
column named like the result (``out``) is replaced.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import small_batches

MAX_MODEL_BYTES = 64 << 20
#: Bounds of a worker's tables: kept stretches, their longest length, kept pairs.
KEPT_STRETCHES = 1 << 17
KEPT_LENGTH = 32
KEPT_PAIRS = 1 << 19
_SLICE = 1 << 18
_SPACE = "▁"
#: Fixed numbers of the model file's format: piece kinds and model type.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MERGE_TYPE = 2

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class PieceModel:
    """A parsed model with the tables of encoding and decoding."""

    def __init__(self, data: bytes):
        trainer: dict = {}
        normalizer: dict = {}
        pieces = []
        for field, value in _message(data):
            if field == 1:
                entry = dict(_message(value))
                pieces.append((entry[1].decode(), struct.unpack("<f", entry.get(2, b"\0" * 4))[0], entry.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normalizer = dict(_message(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != _MERGE_TYPE or not trainer.get(35, 0) or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("not a merge-type model with byte fallback and plain pieces")
        if trainer.get(24, 0) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model normalises texts beyond escaping spaces")
        self.prefix = _SPACE if normalizer.get(3, 1) else ""
        self.begin, self.end = (struct.pack("<I", trainer.get(field, default)) for field, default in ((41, 1), (42, 2)))
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.scores = {piece: score for piece, score, kind in pieces if kind == _NORMAL}
        self.pieces = [piece for piece, _, _ in pieces]
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == _NORMAL}
        if 0 in self.ids.values():
            raise ValueError("id 0 is not the unknown piece")  # 0 stands for "no piece" below
        self.lengths = [len(piece) for piece in self.pieces]
        self.most = max(map(len, self.ids), default=0)
        self.packed = [struct.pack("<I", i) for i in range(len(pieces))]
        self.bytes = [b""] * 256
        self.control, self.byte = set(), set()
        self.surface: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                value = int(piece[1:-1], 16)
                self.bytes[value] = struct.pack("<I", i)
                self.byte.add(i)
                self.surface.append(bytes([value]))
            elif kind == _CONTROL:
                self.control.add(i)
                self.surface.append(b"")
            else:
                self.surface.append(unknown if kind == _UNKNOWN else piece.replace(_SPACE, " ").encode())
        self.spaced = {i for i, (piece, _, kind) in enumerate(pieces) if kind == _NORMAL and piece[:1] == _SPACE}
        known = sorted(self.ids)
        self.known = {piece for piece in known if len(piece) == 1}
        longer = set("".join(piece for piece in known if len(piece) > 1))
        alone = re.escape("".join(c for c in "\n\t\r" if c not in longer))
        apart = f"|[{alone}]" if alone else ""
        if any(_SPACE in piece.lstrip(_SPACE) for piece in known):
            self.stretches = re.compile(f"[^{alone}]+{apart}" if alone else "(?s:.+)")
            self.spaces_split = False
        else:
            self.stretches = re.compile(f"{_SPACE}+[^{_SPACE}{alone}]*|[^{_SPACE}{alone}]+{apart}")
            self.spaces_split = True
        self.pairs = _Pairs(self)
        self.kept = _Kept(self)

    @cached_property
    def shorter(self) -> list[int]:
        """By id: the longest piece that is a true prefix, or 0."""
        out = [0] * len(self.pieces)
        for piece, i in self.ids.items():
            out[i] = next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), 0)
        return out

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, i)
        found.make_automaton()
        return found

    @cached_property
    def longest(self) -> dict[str, int]:
        """By begin of a piece: the longest piece that it begins with."""
        out: dict[str, int] = {}
        for piece in sorted(self.ids):  # a piece's prefixes come before it
            known = 0
            for n in range(1, len(piece) + 1):
                known = out[piece[:n]] = self.ids.get(piece[:n], known)
        return out

    def merged(self, text: str) -> list[str]:
        """Pieces by merging adjacent ones, best score first, leftmost among equals."""
        score, none = self.scores.get, -inf
        parts = list(text)
        scores = [score(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, before: int, piece: int) -> bool:
        """Whether merging the characters of two pieces (ids; ``before`` 0: of one) gives them again."""
        texts = [self.pieces[i] for i in (before, piece) if i]
        return self.merged("".join(texts)) == texts

    def backtracked(self, text: str) -> list[int]:
        """Ids of a stretch of known characters."""
        pairs, width = self.pairs, len(self.pieces)
        out: list[int] = []
        before = 0
        for _, piece in self.automaton.iter_long(text):
            if not pairs[before * width + piece]:
                break
            out.append(piece)
            before = piece
        else:
            return out
        lengths, shorter, longest, most, size = self.lengths, self.shorter, self.longest, self.most, len(text)
        walk = self.automaton.longest_prefix
        failed, any_failed = bytearray(size // 8 + 1), False
        at = sum(map(lengths.__getitem__, out))
        piece = shorter[piece]
        while True:
            while piece:
                end = at + lengths[piece]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1) and pairs[before * width + piece]:
                    break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                if end == size:
                    return out
                at, before = end, piece
                ahead = text[at:at + most]
                piece = longest[ahead[:walk(ahead)]]
            else:  # no piece goes on from here
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = out.pop()
                at -= lengths[piece]
                before = out[-1] if out else 0
                piece = shorter[piece]

    def stretch(self, text: str) -> bytes:
        """Ids (little-endian) of one stretch; unknown characters as bytes."""
        if self.known.issuperset(text):
            return b"".join(map(self.packed.__getitem__, self.backtracked(text)))
        out, begin = [], 0
        for at, char in enumerate(text):
            if char not in self.known:
                if begin < at:
                    out.extend(map(self.packed.__getitem__, self.backtracked(text[begin:at])))
                out.extend(map(self.bytes.__getitem__, char.encode("utf-8", "surrogatepass")))
                begin = at + 1
        if begin < len(text):
            out.extend(map(self.packed.__getitem__, self.backtracked(text[begin:])))
        return b"".join(out)

    def _slices(self, text: str) -> Iterator[str]:
        begin = 0
        while self.spaces_split and len(text) - begin > _SLICE:
            cut = text.find(_SPACE, begin + _SLICE)
            while 0 < cut and text[cut - 1] == _SPACE:  # a run of spaces belongs together
                cut = text.find(_SPACE, cut + 1)
            if cut < 0:
                break
            yield text[begin:cut]
            begin = cut
        yield text[begin:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, begin and end ids included."""
        parts = [self.begin]
        if text:
            for piece in self._slices(self.prefix + text.replace(" ", _SPACE)):
                parts.extend(map(self.kept.__getitem__, self.stretches.findall(piece)))
        parts.append(self.end)
        return b"".join(parts)

    def decode(self, data: bytes) -> str:
        ids = np.frombuffer(data, dtype="<u4").tolist()
        first = next((i for i in ids if i not in self.control), None)
        parts, run = [], []
        for i in ids if not self.control.isdisjoint(ids[1:-1]) else ():
            if i in self.control:  # bytes before and after a control id are no character together
                parts.append(b"".join(run))
                run = []
            run.append(self.surface[i])
        parts.append(b"".join(run if parts else map(self.surface.__getitem__, ids)))
        whole = "".join(part.decode("utf-8", "each_byte") for part in parts)
        return whole[1:] if self.prefix and first in self.spaced else whole


class _Pairs(dict):
    """Whether two pieces are compatible by both ids (first * pieces + second), filled on demand;
    a full table begins anew."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, pair: int) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        fits = self[pair] = self.model.compatible(*divmod(pair, len(self.model.pieces)))
        return fits


class _Kept(dict):
    """Ids by stretch, filled on demand in two generations: a full table becomes the older
    one, from which stretches still in use come back. Long stretches are not kept."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.model.stretch(text)
            if len(text) > KEPT_LENGTH:
                return ids
        if len(self) >= KEPT_STRETCHES:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: more than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        data = file.read()
    _model(data)  # raises here for a model that isn't supported
    return data


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with ``out``: struct of ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit integers with begin and end ids) of each text."""
    data = _read(model_path)

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary>")
    def ids_of(texts: pa.Array) -> pa.Array:
        model = _model(data)
        ids = [model.encode(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                                          names=["n_tokens", "ids"])

    return small_batches(docs).withColumn(out, ids_of(F.col(text)))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text of the binary ``ids``. An id outside the model raises."""
    data = _read(model_path)

    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        model = _model(data)
        return pa.array([model.decode(r.as_py() or b"") for r in rows], pa.string())

    return small_batches(docs).withColumn(out, text_of(F.col(ids)))
