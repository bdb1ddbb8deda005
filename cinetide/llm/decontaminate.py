"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z) runs of non-blank bytes, shingles are five words
(an item with fewer words is one shingle of all its words).  A shingle's weight
in a window or an item is how often it stands there.  A document holds an item
if some window of as many words as the item (or the whole document, if it is
shorter) has a weighted-shingle similarity of `SIMILARITY` or more to it: the
sum of the smaller weights over the sum of the larger ones.

Method.  A shingle in common is necessary for any similarity, so a window is compared
with the items that have one of its shingles; with all others its similarity is 0.
Its fingerprint is the SimHash of its weighted shingles, of `BITS` bits in `BLOCKS` blocks of
64.  Within the radius of an item's fingerprint at least one block is within radius //
BLOCKS bits of the item's, so the blocks decide first, and lose nothing; then the
whole distance does.  What is within the radius is verified exactly, on the counts of all
shingles.

The radius follows from the number of shingles.  A window that is just similar
enough has m shingles of n that the item lacks; the chance that a bit of the two
fingerprints differs is then a sum of binomials, and `radius` is the least number
of differing bits that such a window exceeds with a chance below `MISS`.  It is 150 at
most, so a block may differ in 18 of 64 bits; blocks of unrelated fingerprints differ in
32 with a deviation of 4, and fewer than 1 in 100 of such pairs pass the blocks (tests
measure it).

The sum holds for shingles that stand once.  Windows or items that repeat a
shingle need not obey it; there the fingerprint is not asked, and every window
that holds enough of an item's shingles is verified.  That the result is the
brute-force one is tested.

Scale: documents are scanned once without a shuffle, whatever the benchmark's
size.  The benchmark is written to the shared folder, and tasks build its index
from there in blocks of at most `BLOCK_ITEMS` items and `BLOCK_BYTES` bytes.  A worker
keeps the indexes that fit in `KEPT_BYTES` (some 300,000 items of 50 words) as long as it
lives, so each is built once a worker, however large the corpus; what does not fit is built
again for each `GROUP_BYTES` of texts.  Memory is linear in a text and in an item.  Only hits
leave a task; the driver holds nothing of the benchmark.

Defined results: null or wordless texts and items match nothing; null ids of
documents and items are ids like any other; repeated rows and equal items each get
their own rows; very long texts and items are compared whole; an empty table gives
an empty result; other columns, also those named like the operator's own, are
ignored, and kept by clean().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import LOWER, U64, Words, chunks, member, mix
from .common import scratch, table

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS = 512, 8
#: Chance that a window of just that similarity is beyond the radius.
MISS = 1e-6
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 8 << 20
#: Texts that a task holds while it goes through several blocks of the benchmark.
GROUP_BYTES = 8 << 20
#: Bytes of indexes that a worker keeps, and counts of items' shingles.
KEPT_BYTES, KEPT_COUNTS = 512 << 20, 1024
#: Windows whose votes are held at once, and pairs of windows and items that are compared at once.
REACH, PAIRS = 1 << 14, 1 << 16
SCHEMA = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_windows bigint"

def fewest(one: int, other: int) -> int:
    """Shingles that two multisets of those sizes have in common at least at the similarity wanted."""
    return int(-(-SIMILARITY * (one + other) // (1 + SIMILARITY)))


@lru_cache(4096)
def radius(one: int, other: int) -> int:
    """Differing bits beyond which a window of `one` shingles like an item of `other` is with a chance below MISS only."""
    both = fewest(one, other)
    if both > min(one, other):
        return -1  # no window of that size can be similar
    if max(one, other) > 400:  # the normal law; binomials of that size agree to three digits
        flip = float(np.arccos(both / np.sqrt(one * other)) / np.pi)
    else:
        law = lambda n: np.array([comb(n, k) / 2**n for k in range(n + 1)])  # noqa: E731  of (n + sum of n signs) / 2
        up = lambda n: np.r_[0.0, np.cumsum(law(n))]
        common = 2 * np.arange(both + 1) - both
        # a bit is set if the votes' sum is above 0: common + own > 0
        share = lambda own: 1 - up(own)[np.clip((own - common) // 2 + 1, 0, own + 1)]
        a, b = share(one - both), share(other - both)
        flip = float((law(both) * (a * (1 - b) + b * (1 - a))).sum())
    tail, r = 1.0, -1
    while tail > MISS and r < BITS:
        r += 1
        tail -= comb(BITS, r) * flip**r * (1 - flip) ** (BITS - r)
    return r


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k word hashes; of all words if they are fewer."""
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    return out


def simhash(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash (a column for 64 bits) of the `length` shingles from each start; a repeated shingle votes as often as it stands there."""
    out = np.empty((len(starts), BITS // 64), np.uint64)
    for lane in range(BITS // 64):
        bits = np.unpackbits((mix(shingles + U64(lane)) if lane else shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.zeros((len(shingles) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=votes[1:], dtype=np.int32)
        out[:, lane] = np.packbits(2 * (votes[starts + length] - votes[starts]) > length, axis=1, bitorder="little").view("<u8").ravel()
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of the intervals from lo to hi, both included, as intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + 1])
    return list(zip(lo[head].tolist(), hi[np.r_[head[1:] - 1, len(hi) - 1]].tolist(), strict=True)) if len(lo) else []


class Index:
    """Fingerprints and shingles of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, n_words, sets = [], [], []
        for item_id, text in items:
            raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            words = Words(raw, np.array([0, len(raw)])).hashes()
            if len(words):
                self.ids.append(item_id)
                n_words.append(len(words))
                sets.append(shingle_hashes(words))
        self.n_words = np.array(n_words, np.int64)
        self.flat, self.limits = np.concatenate([np.empty(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)]
        own = [np.unique(x) for x in sets]
        self.repeats = np.array([len(x) < len(y) for x, y in zip(own, sets, strict=True)], bool)
        self.by_length: dict[int, np.ndarray] = {n: np.flatnonzero(self.n_words == n) for n in sorted(set(n_words)) if n < SHINGLE}
        self.prints, self.printed = np.zeros((len(sets), BITS // 64), np.uint64), np.zeros(len(sets), bool)
        self._counts: dict[int, Counter] = {}
        long = np.flatnonzero(self.n_words >= SHINGLE)
        flat = np.concatenate([np.empty(0, np.uint64), *(own[k] for k in long.tolist())])
        of = np.repeat(long, [len(own[k]) for k in long.tolist()])
        order = np.argsort(flat, kind="stable")
        self.holders = of[order]  # the items of each shingle of the table
        self.table, first = np.unique(flat[order], return_index=True)
        self.first = np.r_[first, len(flat)]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.flat, self.limits, self.prints, self.holders, self.table, self.first)) + 200 * len(self.ids)

    def shingles(self, k: int) -> np.ndarray:
        return self.flat[self.limits[k] : self.limits[k + 1]]

    def counts(self, k: int) -> Counter:
        if k not in self._counts:
            if len(self._counts) >= KEPT_COUNTS:
                self._counts.clear()
            self._counts[k] = Counter(self.shingles(k).tolist())
        return self._counts[k]

    def fingerprints(self, items: np.ndarray) -> np.ndarray:
        """Fingerprints of items, made when they are first asked for."""
        for k in np.unique(items[~self.printed[items]]).tolist():
            own = self.shingles(k)
            self.prints[k], self.printed[k] = simhash(own, np.zeros(1, int), len(own))[0], True
        return self.prints[items]

    def near(self, prints: np.ndarray, items: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of windows of `size` shingles and items of n words: whether a block is near enough, and whether the whole is."""
        most = radius(size, n - SHINGLE + 1)
        apart = np.bitwise_count(prints ^ self.fingerprints(items))
        blocks = apart.min(axis=1, initial=64) <= most // BLOCKS
        within = blocks.copy()
        within[blocks] = apart[blocks].sum(axis=1) <= most
        return blocks, within

    def verified(self, shingles: np.ndarray, k: int, starts: np.ndarray, span: int) -> Iterator[tuple[int, float]]:
        """(start, similarity) of the windows of `span` shingles from the starts, in order, that are similar to item k: counts slide along."""
        theirs, size = self.counts(k), len(self.shingles(k))
        mine: Counter[int] = Counter()
        smaller, lo, hi = 0, 0, 0
        values = shingles.tolist() if len(starts) * 4 > len(shingles) else shingles
        for s in starts.tolist():
            if s >= hi:
                mine.clear()
                smaller, lo, hi = 0, s, s
            while hi < s + span:
                h = int(values[hi])
                if h in theirs:
                    mine[h] += 1
                    smaller += mine[h] <= theirs[h]
                hi += 1
            while lo < s:
                h = int(values[lo])
                if h in theirs:
                    smaller -= mine[h] <= theirs[h]
                    mine[h] -= 1
                lo += 1
            similarity = smaller / (span + size - smaller)
            if similarity >= SIMILARITY:
                yield s, similarity

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For each item that the words hold: best similarity, first word of that window, matching windows."""
        found: dict[int, tuple[float, int, int]] = {}
        for n, items in self.by_length.items():
            if n <= len(words):
                runs = shingle_hashes(words, n)
                for k in items.tolist():
                    at = np.flatnonzero(runs == self.shingles(k)[0])
                    if len(at):
                        found[k] = (1.0, int(at[0]), len(at))
        if len(words) < SHINGLE:
            return found
        shingles = shingle_hashes(words)
        places = np.flatnonzero(member(shingles, self.table))
        if not len(places):
            return found
        order = np.argsort(shingles, kind="stable")
        following = np.full(len(shingles), len(shingles) + SHINGLE)
        same = shingles[order[1:]] == shingles[order[:-1]]
        following[order[:-1][same]] = order[1:][same]
        repeated = np.minimum.accumulate(following[::-1])[::-1]  # where the first repetition from each place on is complete
        row = np.searchsorted(self.table, shingles[places])
        each = self.first[row + 1] - self.first[row]
        holder = self.holders[np.arange(each.sum()) + np.repeat(self.first[row] - np.r_[0, np.cumsum(each)[:-1]], each)]
        place = np.repeat(places, each)
        length = self.n_words[holder]
        for n in np.unique(length).tolist():
            size = min(n, len(words))
            span, last = size - SHINGLE + 1, len(words) - size
            own = length == n
            candidates = list(self.likely(shingles, place[own], holder[own], n, span, last))
            candidates.append(self.sharing(place[own], holder[own], n, span, last, repeated))
            start, k = (np.concatenate(x) for x in zip(*candidates, strict=True))
            for item in np.unique(k).tolist():
                for s, similarity in self.verified(shingles, item, np.unique(start[k == item]), span):
                    best, first, count = found.get(item, (-1.0, 0, 0))
                    found[item] = (max(best, similarity), s if similarity > best else first, count + 1)
        return found

    def likely(self, shingles: np.ndarray, place: np.ndarray, holder: np.ndarray, n: int, span: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, item) of windows around an item's shingles whose fingerprint is near that item's."""
        lo, hi = np.clip(place - span + 1, 0, last), np.clip(place, 0, last)
        apart = last + 2  # keeps the intervals of different items from touching
        pairs = np.array(merged(lo + holder * apart, hi + holder * apart), np.int64).reshape(-1, 2)
        items, begin, stop = pairs[:, 0] // apart, pairs[:, 0] % apart, pairs[:, 1] % apart
        for a, b in merged(lo, hi):
            for at in range(a, b + 1, REACH):  # bounds the votes held
                end = min(at + REACH - 1, b)
                prints = simhash(shingles[at : end + span], np.arange(end - at + 1), span)
                on = np.flatnonzero((begin <= end) & (stop >= at))
                size = np.minimum(stop[on], end) - np.maximum(begin[on], at) + 1
                upto = np.r_[0, np.cumsum(size)]
                for low in range(0, int(upto[-1]), PAIRS):
                    number = np.arange(low, min(low + PAIRS, int(upto[-1])))
                    row = np.searchsorted(upto, number, "right") - 1
                    start, item = np.maximum(begin[on[row]], at) + number - upto[row], items[on[row]]
                    within = self.near(prints[start - at], item, span, n)[1]
                    yield start[within], item[within]

    def sharing(self, place: np.ndarray, holder: np.ndarray, n: int, span: int, last: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of windows that hold enough of an item's shingles, where the window or the item repeats one."""
        least = fewest(span, n - SHINGLE + 1)
        out = [(np.empty(0, int), np.empty(0, int))]
        kept = np.flatnonzero(np.bincount(holder, minlength=len(self.ids)) >= least)
        for k in kept.tolist():
            own = np.sort(place[holder == k])
            lo, hi = own[least - 1 :] - span + 1, own[: len(own) - least + 1]
            near = lo <= hi
            for a, b in merged(np.clip(lo[near], 0, last), np.clip(hi[near], 0, last)):
                starts = np.arange(a, b + 1)
                if not self.repeats[k]:
                    starts = starts[repeated[starts] < starts + span]
                out.append((starts, np.full(len(starts), k)))
        start, item = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, item


# ---- Spark ----

_indexes: dict[tuple[str, int], Index] = {}
#: How many blocks the benchmarks have that were read to their end, and how many indexes this worker has built.
_complete: dict[str, int] = {}
built = Counter()


def blocks_of(path: str) -> Iterator[Index]:
    """Indexes of the benchmark written at the path; a worker keeps those that fit in KEPT_BYTES."""
    if path in _complete and all((path, k) in _indexes for k in range(_complete[path])):
        yield from (_indexes[path, k] for k in range(_complete[path]))
        return
    for old in [k for k in _indexes if k[0] != path]:
        del _indexes[old]
    number = -1

    def index(rows: list[tuple[int | None, str | None]]) -> Index:
        nonlocal number
        number += 1
        if (path, number) in _indexes:
            return _indexes[path, number]
        out = Index(rows)
        built[path] += 1
        if out.nbytes + sum(x.nbytes for x in _indexes.values()) <= KEPT_BYTES:
            _indexes[path, number] = out
        return out

    fs, root = pafs.FileSystem.from_uri(path)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    rows, size = [], 0
    for name in names:
        with fs.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(512):
                for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rows.append((item_id, text))
                    size += len(text or "")
                    if len(rows) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
                        yield index(rows)
                        rows, size = [], 0
    if rows:
        yield index(rows)
    _complete[path] = number + 1


def written(benchmark: DataFrame) -> str:
    """The folder of the shared one in which the benchmark now is, in few files."""
    path = scratch(benchmark.sparkSession, "benchmark")
    benchmark.select(F.col("item_id").cast("bigint"), "text").coalesce(8).write.parquet(path)
    return path


def found_in(words: Words, index: Index) -> Iterator[tuple[int, dict]]:
    """The rows of a chunk that hold items, with what Index.search() gives."""
    hashes = words.hashes()
    if index.by_length or len(words) < SHINGLE:
        docs = np.flatnonzero(words.counts)
    else:
        run, left = shingle_hashes(hashes), np.repeat(words.first[1:], words.counts) - np.arange(len(words))
        at = np.flatnonzero(left >= SHINGLE)
        docs = np.unique(words.doc_of_word()[at[member(run[at], index.table)]])
    for d in docs.tolist():
        if found := index.search(hashes[words.first[d] : words.first[d + 1]]):
            yield d, found


def groups(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[list[tuple[pa.RecordBatch, list[tuple[Index, int, dict]]]]]:
    """Chunks with what is found in them, as (index, row, found)."""
    first = list(zip(range(2), blocks_of(path)))  # two at most are looked at to know whether there is one
    held: list[tuple[pa.RecordBatch, Words, list]] = []
    size = 0

    def searched() -> list:
        for index in [first[0][1]] if len(first) == 1 else blocks_of(path):
            for _, words, out in held:
                out += [(index, d, found) for d, found in found_in(words, index)]
        return [(part, out) for part, _, out in held]

    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(LOWER[buf], offs)
            words.hashes()
            held.append((part, words, []))
            size += len(buf)
            if len(first) < 2 or size >= GROUP_BYTES:
                yield searched() if first else [(p, out) for p, _, out in held]
                held, size = [], 0
    if held:
        yield searched()


def hits(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for batches of (doc_id, text)."""
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "similarity": pa.float64(), "first_word": pa.int64(), "n_windows": pa.int64()}
    for group in groups(batches, path):
        rows = [(part.column("doc_id")[d].as_py(), index.ids[k], *best) for part, out in group for index, d, found in out for k, best in found.items()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def without_hits(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The batches without the rows whose text holds an item."""
    for group in groups(batches, path):
        for part, out in group:
            keep = np.ones(part.num_rows, bool)
            keep[[d for _, d, _ in out]] = False
            yield part.filter(pa.array(keep))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and each item that it holds, with the best window."""
    path = written(benchmark)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: hits(it, path), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; all columns, no shuffle."""
    path = written(benchmark)
    return docs.mapInArrow(lambda it: without_hits(it, path), docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
