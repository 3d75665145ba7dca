"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text's spaces become ▁, with one more before it. Its characters are the first symbols. An agenda holds each pair of neighbours
that together are a piece of the vocabulary, best score first, leftmost first among equals; the best is taken, merged where both of its
symbols are still there, and the merged symbol's pairs with its neighbours come onto the agenda, until it is empty. A symbol that is no piece
becomes the pieces of its UTF-8 bytes.

Where no piece has a ▁ after another character, nor a line end beside one (which is checked of the vocabulary), no merge crosses the
place before a run of ▁ or beside a line end. So a text falls into chunks whose merges don't depend on each other; a worker keeps the
ids of a bounded number of chunks. The agendas of a batch's new chunks of one length move on together, as rows of arrays: in each round
every row takes its best pair. Long chunks have a heap each. The library checks each batch: it encodes every chunk that is new to the
worker, and decodes the ids of each document; a difference ends the job with an error, so no row that differs leaves.

Vocabularies of other types, and with settings that the tables of public merge vocabularies don't use (a character map,
removal of white space, spaces as suffixes, pieces of the user's own or unused ones, no bytes), are refused.

Defined cases: null and empty texts have no ids and decode to an empty text; very long texts and texts without any space are encoded
whole, in time n log n; equal scores are settled by place; a ▁ in the text is a space, as the library has it; repeated rows give
repeated rows; a null id stays null; extra columns, with whatever names, are ignored (`round_trip`) or kept (`encode`, `decode`); an empty
table gives an empty one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name, with_column

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A worker keeps so many chunks; then it begins anew.
KEPT_CHUNKS = 1 << 19
#: Longer chunks have an agenda of their own.
TOGETHER = 48
#: Kinds of pieces, and of models, in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: What stands for the unknown piece in a text (fixed value of the format).
UNKNOWN_SURFACE = " ⁇ "


def model_file(name: str = MODEL) -> str:
    """Where a public vocabulary is on the driver's machine."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise FileNotFoundError(f"no public tokenizers are installed here; give the path of a model like {name}") from e
    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """What a model file says. Ids of pieces by their strings, and how late each comes off the agenda."""

    pieces: list[str]
    kinds: list[int]
    ids: dict[str, int]
    late: dict[str, float]
    byte_ids: list[int]
    dummy: bool

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds, trainer, normal = [], [], [], {}, {}
        for f, v in _fields(data):
            if f == 1:
                p = dict(_fields(v))
                pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normal = dict(_fields(v))
        known = [i for i, k in enumerate(kinds) if k == NORMAL]
        refused = {
            "it isn't of the merge type": trainer.get(3, 1) != MERGES,
            "it has no bytes": not trainer.get(35, 0),
            "spaces are suffixes": bool(trainer.get(24, 0)),
            "it maps characters": bool(normal.get(2)),
            "it removes white space": bool(normal.get(4, 1)),
            "it leaves spaces": not normal.get(5, 1),
            "it has pieces of other kinds": not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE},
            "a piece has a space after another character": any(SPACE in pieces[i].lstrip(SPACE) for i in known),
            "a piece has a line end beside another character": any("\n" in pieces[i] and len(pieces[i]) > 1 for i in known),
        }
        if any(refused.values()):
            raise ValueError("can't encode with this vocabulary: " + ", ".join(why for why, so in refused.items() if so))
        return cls(pieces, kinds, {pieces[i]: i for i in known}, {pieces[i]: -scores[i] for i in known}, [i for i, k in enumerate(kinds) if k == BYTE], bool(normal.get(3, 1)))


def merged(chunk: str, late: dict[str, float]) -> list[str]:
    """The symbols that are left when the agenda is empty."""
    n = len(chunk)
    symbols: list[str] = list(chunk)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = late.get
    agenda = [(k, i, pair) for i, pair in enumerate(map("".join, zip(chunk, chunk[1:], strict=False))) if (k := get(pair)) is not None]
    heapify(agenda)
    while agenda:
        _, i, pair = heappop(agenda)
        j = after[i]
        # A symbol only grows, and an empty one is part of another: lengths tell whether both are as they were.
        if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair):
            continue
        symbols[i], symbols[j] = pair, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            wider = pair + symbols[k]
            if (late_ := get(wider)) is not None:
                heappush(agenda, (late_, i, wider))
        h = before[i]
        if h >= 0:
            wider = symbols[h] + pair
            if (late_ := get(wider)) is not None:
                heappush(agenda, (late_, h, wider))
    return [s for s in symbols if s]


class Agendas:
    """The agendas of many chunks of one length, a row each. Symbols are ids, or -1 - code for characters that are no piece."""

    NEVER = np.iinfo(np.int32).max

    def __init__(self, v: Vocabulary):
        self.n = len(v.pieces)
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in v.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        # All ways to make a piece of two; late[-1] is of pairs that make none.
        pairs = {(a, b): i for p, i in v.ids.items() for k in range(1, len(p)) if (a := v.ids.get(p[:k])) is not None and (b := v.ids.get(p[k:])) is not None}
        keys = np.array([a * self.n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.int32)[order]
        late = np.full(self.n + 1, self.NEVER, np.int32)
        known = np.fromiter(v.ids.values(), np.int64, len(v.ids))
        late[known] = np.unique([v.late[p] for p in v.ids], return_inverse=True)[1]
        self.late = late

    def pieces(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of symbols makes, or -1."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def run(self, chunks: list[str]) -> tuple[list[bytes], list[int]]:
        """The symbols of each chunk that are left when its agenda is empty, four bytes each; which of them have characters that are no
        piece."""
        n, width = len(chunks), len(chunks[0])
        s = self.symbol_of[np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le"), np.uint32)].reshape(n, width)
        out = [b""] * n
        odd = np.flatnonzero((s < 0).any(axis=1)).tolist()
        row = np.arange(n)
        made = self.pieces(s[:, :-1], s[:, 1:])
        while True:
            late = self.late[made]
            at = late.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            going = late[np.arange(len(row)), at] < self.NEVER if width > 1 else np.zeros(len(row), bool)
            ended, size = s[~going].astype("<i4").tobytes(), 4 * width
            for k, i in enumerate(row[~going].tolist()):
                out[i] = ended[k * size : (k + 1) * size]
            if not going.any():
                return out, odd
            row, s, made, at = row[going], s[going], made[going], at[going]
            r, width = np.arange(len(row)), width - 1
            # Every row loses one symbol, and what stands right of it moves up.
            cols = np.arange(width)
            new = made[r, at]
            s = np.take_along_axis(s, cols + (cols > at[:, None]), axis=1)
            s[r, at] = new
            made = np.take_along_axis(made, np.minimum(cols[:-1] + (cols[:-1] >= at[:, None]), width - 1), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            made[left, at[left] - 1] = self.pieces(s[left, at[left] - 1], new[left])
            made[right, at[right]] = self.pieces(new[right], s[right, at[right] + 1])


class Codec:
    """Encodes and decodes texts in a worker, checked by the library."""

    #: A chunk with its run of spaces, which may have nothing behind it; or a line end.
    _CHUNK = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, data: bytes, kept_chunks: int = KEPT_CHUNKS):
        import sentencepiece

        v = self.vocabulary = Vocabulary.read(data)
        self.agendas = Agendas(v)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.kept_chunks = kept_chunks
        self.kept: dict[str, bytes] = {}
        surfaces = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_SURFACE.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self._surfaces = pa.array([surfaces[k](p) for p, k in zip(v.pieces, v.kinds, strict=True)], pa.large_binary())
        self._control = np.array([k == CONTROL for k in v.kinds])
        self._spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(v.pieces, v.kinds, strict=True)])

    def chunks(self, text: str) -> list[str]:
        """Pieces of the text that are encoded by themselves; empty ones may be among them."""
        t = text.replace(SPACE, " ")
        t = f" {t}" if t and self.vocabulary.dummy else t
        if "  " in t or "\0" in t:
            return self._CHUNK.findall(t)
        return t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, four bytes each."""
        v, out = self.vocabulary, dict.fromkeys(chunks, b"")
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for length, alike in by_length.items():
            if length > TOGETHER:
                left = [merged(c.replace(" ", SPACE), v.late) for c in alike]
                found, odd = [np.array([v.ids.get(s, -1 - ord(s[0])) for s in own], "<i4").tobytes() for own in left], range(len(alike))
            else:
                found, odd = self.agendas.run(alike)
            for k in odd:
                symbols = np.frombuffer(found[k], "<i4").tolist()
                found[k] = np.array([i for s in symbols for i in ([s] if s >= 0 else [v.byte_ids[b] for b in chr(-1 - s).encode()])], "<i4").tobytes()
            out.update(zip(alike, found, strict=True))
        return [out[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The library encodes the chunks that are new to this worker too."""
        cut = [self.chunks(t) for t in texts]
        if len(self.kept) > self.kept_chunks:
            self.kept.clear()
        self.kept[""] = b""
        # Each chunk of the batch is looked up once in what is kept, then in the batch's own.
        every = set().union(*cut)
        found = {c: x for c, x in zip(every, map(self.kept.get, every), strict=True) if x is not None}
        new = list(every.difference(found))
        if new:
            own = self.ids(new)
            theirs = self._library_ids(new)
            same = np.array_equal(np.frombuffer(b"".join(own), "<i4"), np.fromiter(chain.from_iterable(theirs), np.int32)) and [len(a) for a in own] == [4 * len(b) for b in theirs]
            if not same:
                c, a, b = next((c, a, b) for c, a, b in zip(new, own, theirs, strict=True) if np.frombuffer(a, "<i4").tolist() != b)
                raise ValueError(f"the library encodes {c!r} as {b}, not as {np.frombuffer(a, '<i4').tolist()}")
            coded = dict(zip(new, own, strict=True))
            self.kept.update(coded)
            found.update(coded)
        get = found.__getitem__
        return [np.frombuffer(b"".join(map(get, cs)), "<i4") for cs in cut]

    def _library_ids(self, chunks: list[str]) -> list[list[int]]:
        """What the library makes of each chunk. It puts a space before every text, so a chunk without one goes in after a line end."""
        if not self.vocabulary.dummy:
            return self.library.encode(chunks, num_threads=1)
        first = len(self.library.encode("\n"))
        found = self.library.encode([c[1:] if c[0] == " " and c != " " else f"\n{c}" for c in chunks], num_threads=1)
        return [x if c[0] == " " and c != " " else x[first:] for c, x in zip(chunks, found, strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; bytes that aren't UTF-8 become U+FFFD each. The library decodes them too."""
        own = list(map(self._decoded, ids))
        for i, a, b in zip(ids, own, self.library.decode([x.tolist() for x in ids]) if ids else [], strict=True):
            if a != b:
                raise ValueError(f"the library decodes {i[:50]} as {b[:50]!r}, not as {a[:50]!r}")
        return own

    def _decoded(self, ids: np.ndarray) -> str:
        # Control pieces say nothing, and end a run of bytes.
        parts = [p[int(self._control[p[0]]) :] for p in np.split(ids, np.flatnonzero(self._control[ids])) if len(p)]
        parts = [p for p in parts if len(p)]
        if not parts:
            return ""
        # The space that was put before the text belongs to its first piece.
        return "".join(_text_of(self._joined(p)[int(not k and self.vocabulary.dummy and self._spaced[p[0]]) :]) for k, p in enumerate(parts))

    def _joined(self, ids: np.ndarray) -> bytes:
        taken = self._surfaces.take(pa.array(ids))
        at, data = np.frombuffer(taken.buffers()[1], np.int64), taken.buffers()[2]
        return data[int(at[0]) : int(at[len(ids)])].to_pybytes() if data else b""


def _text_of(data: bytes) -> str:
    """UTF-8, each byte that belongs to no character as U+FFFD."""
    out: list[str] = []
    at = 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """One for each vocabulary in a worker."""
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def _loaded(df: DataFrame, model: str | None) -> Callable[[], Codec]:
    with open(model or model_file(), "rb") as f:  # on the driver; a vocabulary has a fixed size of a few MB at most
        data = f.read()
    Vocabulary.read(data)  # what can't be encoded is refused before any task runs
    shared = df.sparkSession.sparkContext.broadcast(data)
    return lambda: codec(shared.value)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, text: str = "text", name: str = "ids", model: str | None = None) -> DataFrame:
    """docs with a column of ids (a null text's are none)."""
    load = _loaded(docs, model)
    return with_column(docs, [text], lambda t: _lists(load().encode(_texts(t))), free_name(docs, name), "array<int>")


def decode(rows: DataFrame, ids: str = "ids", name: str = "text", model: str | None = None) -> DataFrame:
    """rows with a column of the texts that the ids stand for."""
    load = _loaded(rows, model)
    return with_column(rows, [ids], lambda i: pa.array(load().decode([np.array(x or [], np.int32) for x in i.to_pylist()]), pa.string()), free_name(rows, name), "string")


def round_trip(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: both ways in one pass, so that ids don't go to Python and back again."""
    load = _loaded(docs, model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = load()
        ids = c.encode(_texts(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array(c.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))
    return arrow_map(rows, run, "doc_id long, ids array<int>, decoded string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
