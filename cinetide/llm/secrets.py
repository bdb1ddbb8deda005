"""Secret scans: fixed patterns plus a linear-chain conditional random field.

The base spans are those of three patterns (`assign`, `access`, `hex`), matched
on whole texts.  The field tags every blank-separated token as begin, inside or
outside of a secret, from its shape, its own and its neighbours' words and
shapes, and features of the whole file; a run of begin and inside tags that
meets no base span is a further span of kind `crf`.

Training: the field is fitted by gradient ascent of the likelihood on at most
`TRAIN_DOCS` documents (those with the smallest hash of their id, `TRAIN_BYTES` of
texts at most), read whole, in which the base spans are tagged and secrets of other
forms, made by rule from a seed, are planted.  Every epoch ascends on all windows of
tokens that hold a secret and `CLEAR` times as many of those that hold none, drawn
anew from all of them.  Windows lie within texts and cover each to its end; a short text is
a window of its own.  Only the weights, some 100 kB, go to the executors.

Decoding is exact Viterbi.  A token whose outside score leads by more than any
transitions can win back is outside in every best path, so texts fall apart
there, and the recursion runs only on the few tokens in between.

Scale: one scan, no shuffle; memory is bounded by the chunk of a batch.

Defined results: a null text is empty and has no spans; null ids and repeated rows
are scanned like others; of equally good tags the path keeps outside, then begin; a
very long text is scanned whole; an empty table gives an empty result (and an
untrained field); other columns, also those named like the operator's own, are kept
by redact() and ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import U64, Words, chunks
from .common import sampled_ids, table, texts_of

KINDS = ("assign", "access", "hex", "crf")
_any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)  # noqa: E731  no other letters fold into these
ASSIGN = re.compile("(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
LEAST_VALUE = 6

TRAIN_DOCS = 300
TRAIN_BYTES = 8 << 20
CLEAR = 5
#: Words of a training text for each planted secret.
EVERY = 60
EPOCHS = 100
WINDOW = 24
BUCKETS = 4096
OUT, BEGIN, IN = 0, 1, 2
#: Of the tokens' shapes, and of files.
SHAPES, FILES = 7 * 4 * 4 * 3 * 2, 27
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns in code points, by kind as listed and by start."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def rendered(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# ---- features ----

_CLASSES = np.zeros((5, 256), np.int32)  # digits, upper, lower, symbols, other
for _row, _codes in enumerate((range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B))):
    _CLASSES[_row, list(_codes)] = 1
_CLASSES[4, 0x80:] = 1
_CLASSES[3] = 1 - _CLASSES[[0, 1, 2, 4]].sum(axis=0)


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape and word bucket of each token, and file bucket of each text."""
    n = len(words)
    sums = np.zeros((5, len(words.buf) + 1), np.int32)
    for c in range(5):
        np.cumsum(_CLASSES[c][words.buf], out=sums[c, 1:])
    digit, upper, lower, symbol, other = (s[words.ends] - s[words.starts] for s in sums)
    size = words.ends - words.starts
    first_upper = _CLASSES[1][words.buf[words.starts]] if n else np.zeros(0, np.int32)
    part = lambda x: (x > 0).astype(np.int64) + (x * 5 >= size) + (x * 2 >= size)  # noqa: E731  0..3
    shape = np.searchsorted((4, 8, 12, 16, 24, 36), size, "right")
    shape = ((shape * 4 + part(digit)) * 4 + part(upper - first_upper)) * 3 + np.minimum(symbol, 2)
    shape = shape * 2 + ((lower > 0) & (other == 0))
    bucket = (words.hashes() >> U64(64 - 12)).astype(np.int64)
    size_of = np.maximum(np.diff(words.offs), 1)
    share = lambda c, cuts: np.searchsorted(cuts, (sums[c][words.offs[1:]] - sums[c][words.offs[:-1]]) / size_of, "right")
    return shape, bucket, share(0, (0.01, 0.1)) * 9 + share(3, (0.25, 0.4)) * 3 + share(1, (0.05, 0.3))


def neighbours(ids: np.ndarray, doc: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The previous and next token's value, `none` at the ends of a text."""
    before, after = np.full(len(ids), none), np.full(len(ids), none)
    same = doc[1:] == doc[:-1]
    before[1:][same] = ids[:-1][same]
    after[:-1][same] = ids[1:][same]
    return before, after


#: Where each kind of feature starts in the weights: own, previous, next shape; own, previous, next word; file.
_STARTS = np.cumsum([0, SHAPES + 1, SHAPES + 1, SHAPES + 1, BUCKETS + 1, BUCKETS + 1, BUCKETS + 1, FILES])


def feature_ids(words: Words) -> np.ndarray:
    """Rows of the weights that each token uses, one column per kind of feature."""
    shape, bucket, files = features(words)
    doc = words.doc_of_word()
    cols = (shape, *neighbours(shape, doc, SHAPES), bucket, *neighbours(bucket, doc, BUCKETS), files[doc])
    return np.stack([start + c for start, c in zip(_STARTS, cols, strict=False)], axis=1)


class Field:
    """Weights of the field: per feature and tag, and per pair of tags; outside never goes to inside."""

    def __init__(self) -> None:
        self.w = np.zeros((_STARTS[-1], 3), np.float32)
        self.w[:, OUT] = 0
        self.t = np.zeros((3, 3), np.float32)
        self.t[OUT, IN] = -1e4
        self.first = np.array([0, 0, -1e4], np.float32)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.w[ids[:, 0]]
        for c in range(1, ids.shape[1]):
            out += self.w[ids[:, c]]
        return out

    def fit(self, all_ids: np.ndarray, all_tags: np.ndarray, valid: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, decay: float = 1e-5, seed: int = 6) -> None:
        """Ascends the likelihood of windows: ids (n, WINDOW, kinds), tags (n, WINDOW); places that are not valid are behind a text's end, and outside."""
        rng = np.random.default_rng(seed)
        with_one = all_tags.any(axis=1)
        some, rest = np.flatnonzero(with_one), np.flatnonzero(~with_one)
        size, kinds = all_ids.shape[1:]
        seen_w, seen_t = np.full(self.w.shape, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(epochs):
            pick = np.r_[some, rng.choice(rest, min(len(rest), max(1, CLEAR * len(some))), replace=False)] if len(rest) else some
            n, tags, real = len(pick), all_tags[pick], valid[pick]
            flat = all_ids[pick].reshape(-1, kinds)
            gold = np.eye(3)[tags]
            pairs = np.zeros((3, 3))
            np.add.at(pairs, (tags[:, :-1][real[:, 1:]], tags[:, 1:][real[:, 1:]]), 1)
            e = self.scores(flat).reshape(n, size, 3).astype(np.float64)
            e[~real] = (0, -1e4, -1e4)
            t = self.t.astype(np.float64)
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + self.first
            for i in range(1, size):
                a[:, i] = e[:, i] + np.logaddexp.reduce(a[:, i - 1, :, None] + t, axis=1)
            for i in range(size - 2, -1, -1):
                b[:, i] = np.logaddexp.reduce(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None])
            both = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])[real[:, 1:]].sum(axis=0)
            diff = ((gold - p) * real[..., None]).reshape(-1, 3)
            grad = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, k], kinds), len(self.w)) for k in range(3)], axis=1) / n - decay * self.w
            grad_t = (pairs - both) / n - decay * self.t
            grad_t[OUT, IN] = 0
            seen_w += grad**2
            seen_t += grad_t**2
            self.w += rate * grad / np.sqrt(seen_w)
            self.t += rate * grad_t / np.sqrt(seen_t)

    def viterbi(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Best tags of the sequences e[start : start + size], all decoded side by side.

        after, before: whether an outside token comes before, or after, the sequence.
        """
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, after, before = starts[order], sizes[order], after[order], before[order]
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # sequences longer than each step
        best, back = e[starts] + np.where(after[:, None], self.t[OUT], self.first), []
        closing = np.where(before[:, None], self.t[:, OUT], np.float32(0))
        ends = np.empty(len(starts), np.int64)
        for i in range(1, len(live)):
            n, m = live[i], live[i - 1]
            ends[n:m] = (best[n:m] + closing[n:m]).argmax(axis=1)
            total = best[:n, :, None] + self.t
            back.append(total.argmax(axis=1).astype(np.int8))
            best = total.max(axis=1) + e[starts[:n] + i]
        ends[: len(best)] = (best + closing[: len(best)]).argmax(axis=1)
        tags = np.zeros(len(e), np.int8)
        tags[starts + sizes - 1] = ends
        now = ends.copy()
        for i in range(len(live) - 1, 0, -1):
            n = live[i]
            now[:n] = back[i - 1][np.arange(n), now[:n]]
            tags[starts[:n] + i - 1] = now[:n]
        return tags

    def spans(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first byte, end) of each tagged secret."""
        if not len(words):
            return
        e = self.scores(feature_ids(words))
        free = self.t[self.t > -1e3]
        # Putting a token outside changes three transitions at most, and makes a following inside a begin.
        gain = np.full(len(e), 3 * float(free.max() - free.min()), np.float32)
        gain[:-1] += np.maximum(e[1:, IN] - e[1:, BEGIN], 0)
        places = np.flatnonzero(e[:, OUT] - np.maximum(e[:, BEGIN], e[:, IN]) <= gain)
        if not len(places):
            return
        doc = words.doc_of_word()
        own = doc[places]
        head = np.r_[True, (np.diff(places) > 1) | (np.diff(own) > 0)]
        tail = np.r_[head[1:], True]
        first, last = places[head], places[tail]
        tags = self.viterbi(e, first, last - first + 1, first > words.first[doc[first]], last + 1 < words.first[doc[last] + 1])
        for k in places[tags[places] == BEGIN].tolist():
            to, last = k + 1, int(words.first[doc[k] + 1])
            while to < last and tags[to] == IN:
                to += 1
            yield int(doc[k]), int(words.starts[k]), int(words.ends[to - 1])


# ---- training ----

_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_secret(rng: np.random.Generator) -> str:
    """A secret of a form made by rule: keyed values, prefixed keys, bare keys."""
    draw = lambda chars, lo, hi: "".join(rng.choice(list(chars), rng.integers(lo, hi)))
    name = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth_token", "pwd"])
    name = (name, name.upper())[rng.integers(2)]
    key = (draw(_B64, 16, 44), draw("0123456789abcdef", 24, 64), draw(_B64 + "+/_-", 20, 60))[rng.integers(3)]
    return (
        f'{name} = "{key}"', f"{name}={key}", f"{name}: {key}", f"{name} = '{key}'",
        "AKIA" + draw(_B64[:26] + _B64[52:], 16, 17), key, "_".join((draw(_B64[26:52], 2, 4), draw(_B64, 30, 40))),
        ".".join(draw(_B64 + "_-", 20, 40) for _ in range(3)),
    )[rng.integers(8)]


def tagged(texts: list[str], seed: int = 5, every: int = EVERY) -> tuple[Words, np.ndarray]:
    """Texts with planted secrets, one and another for each `every` words, and the tags of their tokens."""
    rng = np.random.default_rng(seed)
    raw, marks, at = [], [], 0
    for text in texts:
        pieces = text.split(" ")
        spans = []
        for _ in range(1 + len(pieces) // every):
            pieces.insert(int(rng.integers(len(pieces) + 1)), "\0" + made_secret(rng) + "\1")
        joined, out = " ".join(pieces), []
        for part in re.split("(\0[^\1]*\1)", joined):
            planted = part[:1] == "\0"
            body = part.strip("\0\1").encode()
            start = at + sum(map(len, out))
            out.append(body)
            if planted:
                spans.append((start, start + len(body)))
            else:
                clear = part.strip("\0\1")
                spans += [(start + len(clear[:a].encode()), start + len(clear[:b].encode())) for _, a, b in base_spans(clear)]
        raw.append(b"".join(out))
        marks += spans
        at += len(raw[-1])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(buf, np.cumsum([0, *map(len, raw)]))
    tags = np.zeros(len(words), np.int64)
    for a, b in marks:
        lo, hi = np.searchsorted(words.ends, a, "right"), np.searchsorted(words.starts, b)
        if hi > lo:
            tags[lo:hi] = IN
            tags[lo] = BEGIN
    return words, tags


def windows(first: np.ndarray) -> np.ndarray:
    """Places of the tokens of each window, -1 behind a text's end: windows stay within texts, a text's last one ends where it does."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        starts = [*range(a, b - WINDOW + 1, WINDOW)] or [a]
        starts += [b - WINDOW] if b - a > WINDOW and (b - a) % WINDOW else []
        if b > a:
            rows = np.array(starts)[:, None] + np.arange(WINDOW)
            out.append(np.where(rows < b, rows, -1))
    return np.concatenate(out) if out else np.empty((0, WINDOW), np.int64)


def fitted(texts: list[str]) -> Field:
    """A field trained on all windows of the texts."""
    field = Field()
    words, tags = tagged(texts)
    places = windows(words.first)
    if not len(places):
        return field
    valid = places >= 0
    tags = np.where(valid, tags[places], OUT)
    tags[:, 0][tags[:, 0] == IN] = BEGIN
    field.fit(np.where(valid[..., None], feature_ids(words)[places], 0), tags, valid)
    return field


def train(docs: DataFrame) -> Field:
    """A field for the documents, from at most TRAIN_DOCS of them."""
    ids = [doc_id for _, doc_id in sampled_ids(docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("one")), "one", TRAIN_DOCS)]
    return fitted([text for _, text in sorted(texts_of(docs, ids, TRAIN_BYTES))])


# ---- scanning ----


def found_in(part: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each row of a chunk, in code points."""
    out = [base_spans(x or "") for x in part.column("text").to_pylist()]
    if not part.num_rows:
        return out
    before = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]  # characters before each byte
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for d, a, b in field.spans(Words(buf, offs)):
        place, end = int(before[a] - before[offs[d]]), int(before[b] - before[offs[d]])
        if d not in taken:  # the base spans as places covered, in order
            own = sorted(out[d], key=lambda x: x[1:])
            taken[d] = [x for _, x, _ in own], list(accumulate((y for _, _, y in own), max))
        starts, ends = taken[d]
        k = bisect_left(starts, end)  # base spans that start before this one's end
        if not k or ends[k - 1] <= place:
            out[d].append(("crf", place, end))
    return out


def scan(batches: Iterable[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            spans = found_in(part, buf, offs, field)
            count = lambda kind, spans=spans: pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64())
            digest = [hashlib.sha256(rendered(x for x in s if x[0] != "crf").encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array(digest), pa.array([rendered(s) for s in spans], pa.string()), count("crf")],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by MASK."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_batches(batches: Iterable[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            spans = found_in(part, buf, offs, field)
            if not any(spans):
                yield part
                continue
            texts = [masked(x, s) if s else x for x, s in zip(part.column("text").to_pylist(), spans, strict=True)]
            cols = {n: part.column(n) for n in part.schema.names}
            cols["text"] = pa.array(texts, part.schema.field("text").type)
            if "n_chars" in cols:
                sizes = [len(x) if s else n for x, s, n in zip(texts, spans, cols["n_chars"].to_pylist(), strict=True)]
                cols["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)


def spans(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    field = train(docs)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: scan(it, field), SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found secret masked and n_chars brought up to date."""
    field = train(docs)
    return docs.mapInArrow(lambda it: redact_batches(it, field), docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
