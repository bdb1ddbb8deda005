"""Vectorised word handling on the UTF-8 bytes of Arrow string columns.

Every operator of this subpackage that reads words works on whole Arrow
buffers with numpy instead of on Python strings: a byte table marks word
bytes, sums of byte values give one hash per word, and prefix sums of word
hashes give one hash per window of words.  Nulls are empty texts.  Chunks are
cut by bytes, so memory stays bounded whatever the number of rows per Arrow
batch; a single text longer than the bound is a chunk of its own.

Hashes are polynomials over the field of 2**61 - 1 elements at a base drawn at
random, one base per lane.  Two unequal words of at most n bytes have equal
hashes in a lane with a chance of n / 2**61 over the draw of the base, windows
of k words with k / 2**61 more; no pair of words collides for every base, as
pairs do modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: Separators of the "words" of the deduplication operators: space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~BLANK
#: Word bytes of the licence operator: digits, letters and all non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: The field's size, a prime.
P = (1 << 61) - 1
_P, _S31, _S30, _S61 = U64(P), U64(31), U64(30), U64(61)
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
_BASE = tuple(int(x) for x in np.random.default_rng(61).integers(1 << 40, P - 1, 2))
#: Bytes of a coefficient; words above LONG bytes are hashed one by one.
STEP, LONG = 7, 700
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(STEP + 1)], np.uint64)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(33))
    h *= _MIX1
    h ^= h >> U64(33)
    h *= _MIX2
    h ^= h >> U64(33)
    return h


def folded(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo P."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements as upper 30 and lower 31 bits."""
    return x >> _S31, x & _LOW31


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**31 + low modulo P, for any high and low below 2**62."""
    return folded((high >> _S30) + ((high & _LOW30) << _S31) + low)


def times(x: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products of elements x with elements given as halves."""
    high, low = halves(x)
    middle = high * by[1] + low * by[0]
    return folded(U64(2) * high * by[0] + (middle >> _S30) + ((middle & _LOW30) << _S31) + low * by[1])


def powers(n: int, lane: int = 0, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the lane's base, or of its inverse, as halves."""
    have = _powers.get((lane, inverse))
    if have is None or len(have[0]) <= n:
        base = pow(_BASE[lane], -1, P) if inverse else _BASE[lane]
        row = np.ones(1, np.uint64)
        while len(row) <= max(n, 1 << 12):  # each turn doubles what there is
            row = np.r_[row, times(row, halves(np.array([pow(base, len(row), P)], np.uint64)))]
        _powers[lane, inverse] = have = halves(row)
    return have[0][: n + 1], have[1][: n + 1]


class Words:
    """Words of some texts: byte places, hashes, and the first word of each text."""

    __slots__ = ("buf", "offs", "starts", "ends", "first", "_fields", "_hash")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = WORD):
        self.buf, self.offs = buf, offs
        inside = np.empty(len(buf) + 2, bool)
        inside[0] = inside[-1] = False
        np.take(is_word, buf, out=inside[1:-1])
        mid = inside[1:-1]
        cut = np.zeros(len(buf) + 1, bool)
        cut[offs] = True
        self.starts = np.flatnonzero(mid & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(mid & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self._hash: dict[int, np.ndarray] = {}
        self._fields: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def elements(self, lane: int = 0) -> np.ndarray:
        """One field element per word: its size, and its runs of STEP bytes, as coefficients of a polynomial."""
        if lane not in self._fields:
            size = self.ends - self.starts
            padded = np.r_[self.buf, np.zeros(8, np.uint8)]
            runs = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
            high, low = powers(LONG // STEP + 1, lane)
            out = size.astype(np.uint64)
            at, k = np.flatnonzero(size <= LONG), 0
            while len(at):
                run = runs[self.starts[at] + STEP * k] & _TAIL[np.minimum(size[at] - STEP * k, STEP)]
                k += 1
                out[at] = folded(out[at] + times(run, (high[k], low[k])))
                at = at[size[at] > STEP * k]
            for w in np.flatnonzero(size > LONG).tolist():
                places = np.arange(self.starts[w], self.ends[w], STEP)
                up = powers(len(places), lane)
                parts = halves(times(runs[places] & _TAIL[np.minimum(self.ends[w] - places, STEP)], (up[0][1:], up[1][1:])))
                out[w] = (int(out[w]) + (int(parts[0].sum()) << 31) + int(parts[1].sum())) % P
            self._fields[lane] = out
        return self._fields[lane]

    def hashes(self, lane: int = 0) -> np.ndarray:
        """One 64-bit hash per word."""
        if lane not in self._hash:
            self._hash[lane] = mix(self.elements(lane))
        return self._hash[lane]

    def windows(self, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within one text, and the place of its first word."""
        n = len(self)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        up, down = powers(n, lane), powers(n, lane, inverse=True)
        sums = np.zeros((2, n + 1), np.uint64)
        for half, out in zip(halves(times(self.elements(lane), (up[0][:n], up[1][:n]))), sums, strict=True):
            np.cumsum(half, out=out[1:])
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= k)
        return mix(times(joined(sums[0, at + k] - sums[0, at], sums[1, at + k] - sums[1, at]), (down[0][at], down[1][at]))), at

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and text limits (from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offs = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts have at most `limit` bytes, or one text, with their buffers."""
    buf, offs = buffers(batch.column(text))
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def hash_word(word: str, lane: int = 0) -> int:
    """Hash of one word, as Words gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hashes(lane)[0])


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which 64-bit values are in the sorted table; a bit filter spares most searches."""
    if not len(table):
        return np.zeros(len(values), bool)
    bits = max(12, int(len(table)).bit_length() + 4)
    seen = np.zeros(1 << bits, bool)
    seen[table >> U64(64 - bits)] = True
    out = seen[values >> U64(64 - bits)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
    out[at] = table[place] == values[at]
    return out
