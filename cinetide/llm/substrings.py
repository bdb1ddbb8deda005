"""Exact substring deduplication with difference-cover anchors.

Words are runs of non-blank bytes, unchanged.  A window is `WINDOW` consecutive
words of one document; each word covered by a window whose words also start in
a document with a smaller id is removed.

Method.  `COVER` is a difference cover modulo `PERIOD`: for any two places some
shift below PERIOD brings both onto cover positions.  A run of ANCHOR words is
hashed only at cover positions of each document, 6 of 31.  Two equal windows of
50 words therefore share an anchor at the same shift, since a shift and an
anchor together are at most 50 words.  Anchors that two different texts share
are then extended: every window around one is hashed in 96 bits, and a window
falls if a smaller id has it.

Steps: (1) anchors of each text; (2) anchors shared by different texts;
(3) candidate windows around those; (4) the smallest id of each window; (5) the
words that are left.  A text is known by the digest of its words (128 bits).  Of
rows with the same words all but the smallest id fall whole, and only that row
brings windows in step 3.

Rows are told apart by id and a salt from their text, so an id that stands on
several rows, with any texts, is handled row by row: what falls is told by the
window's hash, never by its place in a row.

Hot anchors and windows.  Each task first compares what it has itself: rows of
one key that meet in a task are settled there, and only the key's smallest id
goes to the shuffle, so a key that a third of all documents hold has as many
rows as there are tasks, not documents.  Settled rows travel by document.  No
pairs are made anywhere.

Windows are told apart by 96 bits of two polynomial hashes over a field of
2**61 - 1 elements with different random bases (see bytestext): two unequal
windows meet with a chance of 2**-88 or so, for any contents.

Defined results: a null text has no words (0, 0, digest of the empty string);
ids that are null neither remove nor lose anything; rows with one id do not
remove each other's words, whether their texts are equal or not; a very long
text is a chunk of its own, read whole; an empty table gives an empty result;
other columns, also those named like the operator's own, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytestext import U64, Words, chunks, member, mix
from .common import saved, table

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every residue modulo 31 but 0 is one difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors or windows that a task holds before it hands them on.
HELD = 1_500_000

_ON_COVER = np.zeros(PERIOD, bool)
_ON_COVER[list(COVER)] = True

ANCHORS = "key bigint, words bigint, settled boolean"
WINDOWS = "key bigint, rest bigint, doc_id bigint, salt smallint, settled boolean"
#: Values of the salt that tells rows of one id apart, a power of two.
SALTS = 4096


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spread(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A key of its own for each key and document or text; the key again, if applied again."""
    return keys ^ by.astype(np.uint64)


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words of each text with an id and a window or more."""
    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(buf, offs)
            has_id = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((words.counts >= WINDOW) & has_id)
            sums = [_text_digests(words, lane)[rows] for lane in (0, 1)]
            own = [part.column(c).take(pa.array(rows)) for c in ("doc_id", "salt")]
            yield pa.RecordBatch.from_arrays([*own, *map(_signed, sums)], ["doc_id", "salt", "d0", "d1"])


def _text_digests(words: Words, lane: int) -> np.ndarray:
    """One hash of all words of each text."""
    n = len(words)
    place = np.arange(n) - np.repeat(words.first[:-1], words.counts)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.hashes(lane) + mix(place.astype(np.uint64) + U64(1 + lane))), out=sums[1:])
    return mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.counts.astype(np.uint64))


def settle(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of key and text: the first of each key, and whether the key has other texts."""
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.r_[head, len(keys)])
    last = head + size - 1
    return head, np.repeat(texts[head] != texts[last], size) if len(keys) else np.empty(0, bool)


def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ANCHORS: one per anchor and task to be compared, and those known to be shared."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(buf, offs)
            hashes, at = words.windows(ANCHOR)
            doc = words.doc_of_word()[at]
            has_id = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            pick = _ON_COVER[(at - words.first[doc]) % PERIOD] & (words.counts >= WINDOW)[doc] & has_id[doc]
            held.append((hashes[pick], _text_digests(words, 0)[doc[pick]]))
            size += int(pick.sum())
            if size >= HELD:
                yield _anchor_rows(held)
                held, size = [], 0
    if held:
        yield _anchor_rows(held)


def _anchor_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, texts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((texts, keys))
    keys, texts = keys[order], texts[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])] if len(keys) else np.empty(0, bool)
    keys, texts = keys[fresh], texts[fresh]
    head, shared = settle(keys, texts)
    out_keys = np.concatenate([keys[head], _spread(keys, texts)[shared]])
    out_texts = np.concatenate([texts[head], texts[shared]])
    settled = np.arange(len(out_keys)) >= len(head)
    return pa.RecordBatch.from_arrays([_signed(out_keys), _signed(out_texts), pa.array(settled)], ["key", "words", "settled"])


def shared_anchors(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per row that goes on, the anchors of its text that another text has: doc_id, salt, hits."""
    rows = docs.mapInArrow(anchors, ANCHORS)
    by_key = Window.partitionBy("key")
    several = F.min("words").over(by_key) < F.max("words").over(by_key)
    rows = rows.withColumn("several", several).where("several or settled")
    rows = rows.select("words", F.when(F.col("settled"), F.col("key").bitwiseXOR(F.col("words"))).otherwise(F.col("key")).alias("anchor"))
    hits = rows.groupBy(F.col("words").alias("d0")).agg(F.collect_set("anchor").alias("hits"))
    return hits.join(firsts, "d0").groupBy("doc_id", "salt").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of WINDOWS for texts with their shared anchors."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(buf, offs)
            low, at = words.windows(ANCHOR)
            doc = words.doc_of_word()
            start = words.first[doc]
            ids, salts = part.column("doc_id").to_numpy(), part.column("salt").to_numpy()
            near = np.zeros(len(words) + 1, np.int32)
            cover = _ON_COVER[(at - start[at]) % PERIOD]
            hits = part.column("hits")
            for d in range(part.num_rows):
                keys = np.sort(hits[d].values.to_numpy().view(np.uint64))
                lo, hi = np.searchsorted(at, words.first[d]), np.searchsorted(at, words.first[d + 1])
                found = at[lo:hi][cover[lo:hi] & member(low[lo:hi], keys)]
                np.add.at(near, np.maximum(found - (WINDOW - ANCHOR), words.first[d]), 1)
                np.add.at(near, found + 1, -1)
            whole, first = words.windows(WINDOW)
            pick = np.flatnonzero(np.cumsum(near)[first] > 0)
            rest, _ = words.windows(WINDOW, 1)
            first = first[pick]
            held.append((whole[pick], rest[pick] & U64(0xFFFFFFFF), ids[doc[first]], salts[doc[first]]))
            size += len(pick)
            if size >= HELD:
                yield _window_rows(held)
                held, size = [], 0
    if held:
        yield _window_rows(held)


def _window_rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    keys, rest, docs, salts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((salts, docs, rest, keys))
    keys, rest, docs, salts = keys[order], rest[order], docs[order], salts[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (rest[1:] != rest[:-1])] if len(keys) else np.empty(0, bool)
    head = np.flatnonzero(new)
    settled = docs > np.repeat(docs[head], np.diff(np.r_[head, len(keys)]))  # a smaller id of this task has it
    other = np.r_[True, (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1])] if len(keys) else new
    once = np.flatnonzero(new | other)
    keys, rest, docs, salts, settled = keys[once], rest[once], docs[once], salts[once], settled[once]
    keys = np.where(settled, _spread(keys, docs), keys)
    return pa.RecordBatch.from_arrays(
        [_signed(keys), pa.array(rest.astype(np.int64)), pa.array(docs), pa.array(salts.astype(np.int16)), pa.array(settled)],
        ["key", "rest", "doc_id", "salt", "settled"],
    )


def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the hashes of their id's fallen windows, and the digests of its copies, to counts, digest and the text that is left."""
    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(buf, offs)
            gone = np.zeros(len(words) + 1, np.int32)
            whole, start = words.windows(WINDOW)
            falls, copies = part.column("falls"), part.column("copies")
            texts = _text_digests(words, 0).view(np.int64)
            for d in range(part.num_rows):
                a, b = int(words.first[d]), int(words.first[d + 1])
                if copies[d].is_valid and b - a >= WINDOW and texts[d] in copies[d].values.to_numpy():
                    gone[a] += 1
                    gone[b] -= 1
                elif falls[d].is_valid:
                    lo, hi = np.searchsorted(start, (a, b))
                    at = start[lo:hi][member(whole[lo:hi], np.sort(falls[d].values.to_numpy().view(np.uint64)))]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
            left = np.cumsum(gone[:-1]) == 0
            texts = [_joined(words, np.flatnonzero(left[words.first[d] : words.first[d + 1]]) + words.first[d]) for d in range(part.num_rows)]
            removed = np.r_[0, np.cumsum(~left)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array((removed[words.first[1:]] - removed[words.first[:-1]]).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def _joined(words: Words, kept: np.ndarray) -> bytes:
    """The kept words joined by one space: bytes outside of words are dropped, one space goes before each word but the first."""
    if not len(kept):
        return b""
    starts, ends = words.starts[kept], words.ends[kept]
    lo, hi = starts[0], ends[-1]
    mark = np.zeros(hi - lo + 1, np.int8)
    mark[starts - lo] += 1
    mark[ends - lo] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    out = np.full(int(inside.sum()) + len(kept) - 1, 0x20, np.uint8)
    # each word moves right by one space for every kept word before it
    size = ends - starts
    to = np.arange(int(size.sum())) + np.repeat(np.arange(len(kept)), size)
    out[to] = words.buf[lo:hi][inside]
    return out.tobytes()


FINISHED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of FINISHED: each document without the words that earlier documents have."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").bitwiseAND(SALTS - 1).cast("smallint").alias("salt"))
    same = docs.mapInArrow(digests, "doc_id bigint, salt smallint, d0 bigint, d1 bigint")
    firsts = same.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "salt")).alias("first"), F.max("doc_id").alias("last"))
    firsts = saved(firsts.select("d0", "d1", "first.doc_id", "first.salt", "last"), "firsts")  # read from a table, both sides of the join are shuffled and can be split
    several = firsts.where("last > doc_id").select("d0", "d1", F.col("doc_id").alias("stands"))
    copies = saved(same.join(several, ["d0", "d1"]).where("doc_id > stands").select("doc_id", "salt", "d0").distinct(), "copies")
    known = docs.where("doc_id is not null")  # in both joins alike, so their shuffle of the texts is one
    hits = shared_anchors(docs, firsts.select("d0", "doc_id", "salt"))
    windows = known.join(hits, ["doc_id", "salt"]).mapInArrow(candidates, WINDOWS)
    smallest = F.min("doc_id").over(Window.partitionBy("key", "rest"))
    window = F.when(F.col("settled"), F.col("key").bitwiseXOR(F.col("doc_id"))).otherwise(F.col("key"))
    fallen = windows.select("doc_id", "salt", window.alias("window"), (F.col("settled") | (F.col("doc_id") > smallest)).alias("falls")).where("falls")
    falls = fallen.groupBy("doc_id", "salt").agg(F.collect_set("window").alias("falls"))
    whole = copies.groupBy("doc_id", "salt").agg(F.collect_set("d0").alias("copies"))
    marks = falls.join(whole, ["doc_id", "salt"], "full_outer")
    none = F.lit(None).cast("array<bigint>")
    unknown = docs.where("doc_id is null").select("*", none.alias("falls"), none.alias("copies"))
    done = known.join(marks, ["doc_id", "salt"], "left").select(unknown.columns)
    return done.mapInArrow(finished, FINISHED).union(unknown.mapInArrow(finished, FINISHED))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


#: The same result by comparing all windows.
ORACLE_SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as s from t where len(w) >= 50),
windows as (select doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) as h from starts),
firsts as (select h, min(doc_id) as first from windows group by h),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as i from windows join firsts using (h) where doc_id > first),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from t),
kept as (select doc_id, string_agg(word, ' ' order by i) as k from words anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from t left join kept using (doc_id) left join n using (doc_id)"""
