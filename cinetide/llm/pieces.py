"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file:
* N, the normaliser: arcs that rewrite characters by the model's character map
  (longest match first), squeeze spaces if the model says so, put U+2581 for every
  space and the dummy prefix in front;
* L, the lexicon: a trie of states whose paths spell pieces, with weight -score for
  unigram models, plus byte fallback: a character that is no piece becomes the
  pieces of its UTF-8 bytes;
* A, an acceptor over pieces for models of the merging (BPE) kind, with a state
  per last piece.  The arc from u to v weighs 0 if merging the characters of uv
  ends in u, v, and infinity otherwise.  A sequence whose neighbours all pass is
  what merging the whole text gives, and there is just one: merges inside of two
  neighbours never depend on anything beyond them.  Arcs of A are made when they
  are first asked for and kept.
An input's encoding is the shortest path, in the tropical semiring (least sum of
weights), of input o N o L o A; for unigram models A has one state and weight 0.
The composition is lazy: its states are pairs of a place in the normalised input
and a state of A, and arcs are made as the search reaches them.  The search takes
the lightest state first, of equals the furthest.  The result equals the
SentencePiece library's ids for the public BPE model, and for a made-up unigram
model with a character map; both are tested.  Decoding runs the machines backwards:
pieces to bytes, spaces restored, the dummy prefix dropped.

Speed without loss: no piece has U+2581 after another character, and a line feed
is no piece, so texts fall apart before each run of spaces and around line feeds
into segments that are encoded on their own (this is checked for the model).
Each distinct segment is looked up by its bytes and encoded if new; a worker keeps
at most `CACHE` segments in two generations.  A text is read whole, whatever its
size; a segment without blanks costs some 200 bytes a character while it is encoded.

The model's path is a parameter, or the setting `spark.cinetide.pieces.model`; the
driver reads the file and sends its pieces.

Defined results: a null text is empty and has no ids; a null id stays null; U+2581 in a text reads as
a space, so round_trip is false for such texts, as it is where the character map
changed something; repeated rows are encoded alike; an empty table gives an empty
result; other columns, also those named like the operator's own, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import chunks
from .common import table

#: The public model, where neither a parameter nor the setting names one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SETTING = "spark.cinetide.pieces.model"
CACHE = 800_000
ARCS = 600_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SPACE_BYTES = SPACE.encode()


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces, scores and kinds of a model file, and its normaliser's settings."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.strip, self.map = False, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                self.map, self.prefix, self.strip = own.get(2) or b"", bool(own.get(3, 1)), bool(own.get(4, 1))
                if not own.get(5, 1):
                    raise ValueError("plain spaces are not supported")
        usable = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in usable):
            raise ValueError("pieces reach over words")


INFINITY = float("inf")
#: States of the composition are (place, last piece) as one number; piece -1 is a character without one, or the start.
BITS = 20
PIECE = (1 << BITS) - 1


class CharacterMap:
    """The rewriting arcs of N: a double-array trie over bytes, and the texts that its keys become."""

    def __init__(self, raw: bytes):
        size = struct.unpack("<I", raw[:4])[0] if raw else 0
        self.units = np.frombuffer(raw[4 : 4 + size], "<u4").tolist()
        self.texts = raw[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """End and replacement of the longest key at a place."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, best = step(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = self.units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= step(unit)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                best = k + 1, self.texts[start : self.texts.index(b"\0", start)]
        return best


class Normaliser:
    """N: two states, whether a space came last (it matters where spaces are squeezed), and arcs by the character map."""

    def __init__(self, model: Model):
        self.map, self.prefix, self.strip = CharacterMap(model.map), model.prefix, model.strip
        #: Without a map every arc reads one character: all of them at once, by character.
        self.single = None if model.map or model.strip else {ord(" "): SPACE}

    def arc(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Where the arc from a place of the input ends, and what it gives."""
        found = self.map.longest(raw, at)
        if found is None:
            lead = raw[at]
            end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            return end, raw[at:end]
        return found

    def output(self, text: str, whole: bool = True) -> str:
        """What N makes of the text; without `whole`, of a piece of a text, so without dummy prefix."""
        if self.single is not None:
            return (SPACE if self.prefix and whole and text else "") + text.translate(self.single)
        raw, at, out, spaced = text.encode(), 0, [], self.strip
        while at < len(raw):
            at, made = self.arc(raw, at)
            if spaced:
                made = made.lstrip(b" ")
            if made:
                out.append(made)
                spaced = self.strip and made.endswith(b" ")
        result = b"".join(out).decode().replace(" ", SPACE)
        result = (SPACE if self.prefix and whole and result else "") + result
        return result.rstrip(SPACE) if self.strip else result


class Lexicon:
    """L: the trie's states, each with its arcs by character and the piece that ends there."""

    def __init__(self, model: Model):
        self.next: list[dict[str, int]] = [{}]
        self.piece = [-1]
        used = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)]
        for text, i in used:
            state = 0
            for c in text:
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                state = to
            self.piece[state] = i
        self.weight = [0.0] * len(model.pieces) if model.bpe else [-score for score in model.scores]
        self.rare = 0.0 if model.bpe else 10.0 - min((model.scores[i] for _, i in used), default=0.0)  # of a character without a piece

    def arcs(self, text: str, at: int) -> list[int]:
        """The states that the paths from the trie's root along the text lead to, nearest first; with the character itself, if it is no piece."""
        out: list[int] = []
        end, size, state, next_, piece = at, len(text), 0, self.next, self.piece
        while end < size:
            state = next_[state].get(text[end], 0)
            if not state:
                break
            end += 1
            i = piece[state]
            if i >= 0:
                out.append(end << BITS | (i + 1))
        if not out or out[0] >> BITS > at + 1:
            out.insert(0, (at + 1) << BITS)
        return out

    def weight_of(self, state: int) -> float:
        """Weight of the arc that leads to a state."""
        piece = (state & PIECE) - 1
        return self.weight[piece] if piece >= 0 else self.rare


class Pairs:
    """A: a state for each last piece, and weights of the arcs between them."""

    def __init__(self, model: Model):
        self.pieces, self.scores, self.bpe = model.pieces, model.scores, model.bpe
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
        self.arcs: dict[int, float] = {}

    def merged(self, text: str) -> list[str]:
        """Merging of characters by score, leftmost first among equals; only ever used on two pieces."""
        parts = list(text)
        scores, ids = self.scores, self.ids
        while True:
            best = at = None
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, u: int, v: int) -> float:
        """Weight of the arc from piece u to v; a character without a piece, and the start, merge with nothing."""
        if not self.bpe or u < 0 or v < 0:
            return 0.0
        key = u << BITS | v
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            pair = [self.pieces[u], self.pieces[v]]
            known = self.arcs[key] = 0.0 if self.merged(pair[0] + pair[1]) == pair else INFINITY
        return known


class Transducer:
    """N, L and A of a model, their composition with an input, and the shortest path in it."""

    def __init__(self, model: Model):
        self.model = model
        self.normaliser, self.lexicon, self.pairs = Normaliser(model), Lexicon(model), Pairs(model)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)

    def path(self, text: str) -> list[tuple[int, int]]:
        """The shortest path of normalised text: (end, piece or -1) of each arc.

        A state's arcs are taken one by one, lightest first, and an arc's weight in A is
        asked for when the search comes to it, so arcs that no light path needs are never
        looked at.
        """
        arcs, weight, known, own = self.lexicon.arcs, self.pairs.weight, self.pairs.arcs.get, self.lexicon.weight_of
        weighted, last = not self.model.bpe, len(text) << BITS
        reached: dict[int, int] = {}
        todo: list[tuple] = []
        # weight so far, state (the furthest first), the state before, its arcs that are still to come; None once A's weight is in
        so_far, turned, before, rest = 0.0, 0, -1, None
        while True:
            state = -turned
            if rest is not None:
                if rest:
                    to = rest.pop()
                    base = so_far - own(state) + own(to) if weighted else so_far
                    heapq.heappush(todo, (base, -to, before, rest))
                u, v = (before & PIECE) - 1, (state & PIECE) - 1
                more = known(u << BITS | v) if u >= 0 <= v else 0.0
                if more is None:
                    more = weight(u, v)
                if more and more < INFINITY:
                    heapq.heappush(todo, (so_far + more, turned, before, None))
            else:
                more = 0.0
            if more or state in reached:
                if not todo:
                    raise AssertionError("no path")
                so_far, turned, before, rest = heapq.heappop(todo)
                continue
            reached[state] = before
            if state >= last:
                out = []
                while before >= 0:
                    out.append((state >> BITS, (state & PIECE) - 1))
                    state, before = before, reached[before]
                return out[::-1]
            rest = arcs(text, state >> BITS)
            if weighted:
                rest.sort(key=lambda to: (-own(to), to))
            to = rest.pop()
            so_far, turned, before, rest = heapq.heappushpop(todo, (so_far + own(to) if weighted else so_far, -to, state, rest))

    def segment_ids(self, text: str) -> list[int]:
        """Ids of normalised text."""
        out, at = [], 0
        for end, piece in self.path(text) if text else ():
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes.get(b, self.unknown) for b in text[at:end].encode()] if self.bytes else [self.unknown]
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        return self.segment_ids(self.normaliser.output(text))

    def table(self) -> list[bytes]:
        """Bytes that each id stands for."""
        out = []
        for piece, kind in zip(self.model.pieces, self.model.kinds, strict=True):
            out.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.table()
        raw = b"".join(pieces[i] for i in ids)
        return (raw[1:] if self.model.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Encoder:
    """Encodes and decodes chunks, keeping what it knows of segments."""

    def __init__(self, model: Model):
        self.machine = Transducer(model)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        raw = self.machine.table()
        self.sizes = np.array([len(x) for x in raw])
        self.places = np.r_[0, np.cumsum(self.sizes)]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        #: N rewrites characters on their own then, so segments can be cut before it.
        self.plain = not model.map and not model.strip

    def ids_of(self, segment: bytes) -> bytes:
        known = self.young.get(segment)
        if known is None:
            known = self.old.get(segment)
            if known is None:
                text = segment.decode()
                ids = self.machine.segment_ids(self.machine.normaliser.output(text, whole=False) if self.plain else text.replace(" ", SPACE))
                known = struct.pack(f"<{len(ids)}i", *ids)
            if len(self.young) >= CACHE // 2:
                self.young, self.old = {}, self.young
            self.young[segment] = known
        return known

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if not self.plain:
            raw = buf.tobytes()
            texts = [self.machine.normaliser.output(raw[a:b].decode(), whole=False).replace(SPACE, " ").encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]
        sizes = np.diff(offs)
        if self.machine.model.prefix:
            buf = np.insert(buf, offs[:-1][sizes > 0], 0x20)
            offs = offs + np.r_[0, np.cumsum(sizes > 0)]
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        blank, line = buf == 0x20, buf == 0x0A
        head = line | (blank & ~np.r_[False, blank[:-1]]) | np.r_[False, line[:-1]]
        head[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(head)
        raw, limits = buf.tobytes(), [*starts.tolist(), len(buf)]
        own: dict[bytes, int] = {}
        which = np.fromiter((own.setdefault(raw[a:b], len(own)) for a, b in zip(limits, limits[1:])), np.int64, len(starts))
        ids = [self.ids_of(segment) for segment in own]
        return spread(np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids]), which, np.searchsorted(starts, offs))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with those ids, and where each text's begin."""
        flat, offs = spread(self.flat, self.sizes, ids, first)
        if self.machine.model.prefix and len(flat):
            some = np.diff(offs) > 0
            drop = offs[:-1][some]
            drop = drop[flat[drop] == 0x20]
            gone = np.zeros(len(flat) + 1, np.int64)
            gone[drop + 1] = 1
            flat = np.delete(flat, drop)
            offs = offs - np.cumsum(gone)[offs]
        return flat, offs


def spread(values: np.ndarray, sizes: np.ndarray, which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs number `which` of the values, put after each other, and where the groups that begin at `first` begin now."""
    starts = np.r_[0, np.cumsum(sizes)][:-1][which] if len(which) else np.empty(0, np.int64)
    size = sizes[which]
    ends = np.r_[0, np.cumsum(size)]
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], size)
    return values[at], ends[first]


SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, n_bytes bigint, decoded_sha256 string, round_trip boolean"
_encoders: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for the model, made once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Model(raw))
    return _encoders[key]


def encoded(batches: Iterable[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA: ids, and what their decoding gives."""
    own = encoder(raw)
    for batch in batches:
        for part, buf, offs in chunks(batch):
            marks = _without_marks(buf, offs)
            ids, first = own.encode(*marks)
            back, at = own.decode(ids, first)
            texts = [back[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            same = [x == buf[a:b].tobytes() for x, a, b in zip(texts, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(same, pa.bool_()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )


def _without_marks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+2581 as spaces."""
    raw = buf.tobytes()
    if _SPACE_BYTES not in raw:
        return buf, offs
    texts = [raw[a:b].replace(_SPACE_BYTES, b" ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]


def model_bytes(spark: SparkSession, model: str | None = None) -> bytes:
    """The model's file, read by the driver."""
    with open(model or spark.conf.get(SETTING, MODEL), "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Ids of each document, with the digest of their decoding."""
    raw = model_bytes(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: encoded(it, raw), SCHEMA)


def decoded(batches: Iterable[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) for batches of (doc_id, ids)."""
    own = encoder(raw)
    for batch in batches:
        lists = batch.column("ids")
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
        first = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[first[0] : first[-1]]
        flat, at = own.decode(ids, first - first[0])
        texts = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def detokenized(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """Texts of (doc_id, ids)."""
    raw = model_bytes(tokens.sparkSession, model)
    return tokens.select("doc_id", "ids").mapInArrow(lambda it: decoded(it, raw), "doc_id bigint, text string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
