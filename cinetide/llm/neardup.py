"""MinHash near-deduplication with confirmed links and connected components.

A document's set holds its distinct shingles of five lower-cased (A-Z) words;
with fewer words the whole sequence is the one shingle, without words the set
is empty and linked with nothing.  Documents are linked if their sets' Jaccard
similarity is at least 75 / 100; a component's smallest id stands for it.

Method.
1. Each set gets `MINIMA` minima of universal hashes ((a x + b) mod 2**64,
   upper half) and a 128-bit digest.  Rows of equal sets form a class, numbered in
   a table, and only the class goes on, so exact copies cost one row.
2. Banding: `BANDS` bands of `ROWS` minima.  A pair at 0.75 misses all of them
   with a chance of 5e-6.
3. Pairs of a bucket's hub and its members, then what hubs do not hold together, are
   compared by signatures and confirmed on full sets (see links).
4. Links between the classes of one id's rows are added, and components of all
   links found by alternating large-star and small-star.

Hot groups: step 1 folds copies after partial aggregation, so a text on a third of
all rows is one class; buckets of many classes are dealt by links.

Shingles are told apart by 61-bit hashes of words over a prime field, mixed (see
bytestext): two unequal shingles of one pair of texts meet with a chance of 2**-60.

Defined results: a null text is empty; a null id takes no part (component_id
null, kept); every row gives one row; rows of one id belong together, whatever
their texts; a very long text is read whole; an empty table gives an empty
result; other columns, also those named like the operator's own, are ignored by
the query and kept by deduplicated(), where equal rows (id and text) become one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import LOWER, U64, Words, chunks, mix
from .common import discarded, made, saved, table
from .links import Check, buckets, components, hub_links, rest_links

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Equal minima that a pair needs to be compared on its sets: five deviations below 0.75.
LEAST_EQUAL = 72

_rng = np.random.default_rng(75)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_STEP = U64(0x9E3779B97F4A7C15)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin."""
    words = Words(LOWER[buf], offs)
    hashes, counts = words.hashes(), words.counts
    n = len(words)
    doc = words.doc_of_word()
    left = np.repeat(words.first[1:], counts) - np.arange(n)
    run = np.zeros(n, np.uint64)
    for j in range(SHINGLE):  # shorter texts: as many words as there are
        on = np.flatnonzero((left > j) & ((left >= SHINGLE) | (counts[doc] < SHINGLE)))
        run[on] = mix(run[on] * _STEP + hashes[on + j])
    at = np.flatnonzero((left >= SHINGLE) | ((counts[doc] < SHINGLE) & (left == counts[doc])))
    run, doc = run[at], doc[at]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    new = np.r_[True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])] if len(run) else np.empty(0, bool)
    run, doc = run[new], doc[new]
    return run, np.searchsorted(doc, np.arange(len(offs)))


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MINIMA minima of each non-empty set."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), MINIMA), np.uint32)
    for k in range(MINIMA if len(starts) else 0):
        out[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> U64(32), starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        keys = mix(keys * _STEP + parts[:, :, j])
    return keys


SKETCHES = "doc_id bigint, row bigint, n_shingles bigint, d0 bigint, d1 bigint, sig binary"


def set_digests(flat: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    size = np.diff(first).astype(np.uint64)
    out = []
    for lane in (1, 2):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ mix(np.array([lane], np.uint64))), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + size))
    return out


def sketches(make: Callable = signatures) -> Callable:
    """Rows of SKETCHES; digests and sketch are null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in chunks(batch):
                flat, first = shingle_sets(buf, offs)
                size = np.diff(first)
                full = size > 0
                cols = [pa.array(d.view(np.int64), mask=~full) for d in set_digests(flat, first)]
                sig = make(flat, first)
                rows = np.full(len(size), -1)
                rows[full] = np.arange(len(sig))
                blobs = pa.array([sig[r].tobytes() if r >= 0 else None for r in rows.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(size.astype(np.int64)), *cols, blobs], [c.split()[0] for c in SKETCHES.split(", ")])

    return run


def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n_shingles) for each band of (node, n_shingles, sig)."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, MINIMA)
        index = pa.array(np.repeat(np.arange(n), BANDS))
        keys = pa.array(band_keys(sig).ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays([keys, batch.column("node").take(index), batch.column("n_shingles").take(index)], ["key", "node", "n_shingles"])


def equal_minima(a: np.ndarray, b: np.ndarray, *sizes: np.ndarray) -> np.ndarray:
    """Which rows of signatures are likely links."""
    return (a.view(np.uint32) == b.view(np.uint32)).sum(axis=1) >= LEAST_EQUAL


def equal_grid(sig: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of signatures are likely links."""
    sig = sig.view(np.uint32)
    equal = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(MINIMA):
        equal += sig[:, k, None] == sig[None, :, k]
    return equal >= LEAST_EQUAL


CHECK = Check(NUMERATOR, DENOMINATOR, shingle_sets, equal_minima, equal_grid)


# ---- the whole ----


def candidates(first: DataFrame) -> DataFrame:
    """Members of buckets of equal bands."""
    return buckets(first.select("node", "n_shingles", "sig").mapInArrow(banded, "key bigint, node bigint, n_shingles bigint"))


def numbered(docs: DataFrame, make: Callable, number: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row, n_shingles, node), where `row` is a hash of the text; classes (node, first id); sketches of classes.

    `number` gives the numbers of classes (d0, d1).
    """
    sets = saved(docs.mapInArrow(sketches(make), SKETCHES), "sketches")
    with_set = sets.where("doc_id is not null and d0 is not null")
    classes = with_set.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = classes.select("d0", "d1", "first.doc_id", "first.row")
    classes = saved(classes.select("*", number(classes).alias("node")), "classes")
    known = saved(with_set.select("doc_id", "row", "n_shingles", "d0", "d1").join(classes.select("d0", "d1", "node"), ["d0", "d1"]).drop("d0", "d1"), "known")
    first = with_set.join(classes.select("doc_id", "row", "node"), ["doc_id", "row"])
    first = first.groupBy("doc_id", "row").agg(F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))  # rows may stand there twice
    by_id = known.groupBy("doc_id").agg(F.min("node").alias("node"))
    empty = sets.where("doc_id is not null and d0 is null").select("doc_id", "row", "n_shingles").join(by_id, "doc_id", "left")
    without_id = sets.where("doc_id is null").select("doc_id", "row", "n_shingles", F.lit(None).cast("bigint").alias("node"))
    rows = known.unionByName(empty).unionByName(without_id)
    return saved(rows, "rows"), classes.select("node", "doc_id"), saved(first, "class-sketches")


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("row"))


def texts_of_members(docs: DataFrame, members: DataFrame, first: DataFrame) -> DataFrame:
    """(node, text) of the classes that are in a bucket."""
    texts = members.select("node").distinct().join(first.select("node", "doc_id", "row"), "node").join(docs, ["doc_id", "row"])
    return saved(texts.groupBy("doc_id", "row").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")


def joined(rows: DataFrame, classes: DataFrame, members: DataFrame, sketch: DataFrame, texts: DataFrame, check: Check) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of rows, from buckets of candidates."""
    found = saved(hub_links(members, sketch, texts, check), "hub-links")
    more = saved(rest_links(members, components(found), sketch, texts, check), "rest-links")
    ids = rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    of_ids = rows.where("node is not null").join(saved(ids.select("doc_id", "a"), "ids"), "doc_id").where("node > a").select("a", F.col("node").alias("b"))
    parts = classes.join(components(found.union(more).union(of_ids)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = saved(parts.groupBy("component").agg(F.min("doc_id").alias("component_id")), "components")
    named = saved(parts.join(least, "component").select("node", "component_id"), "named")
    alone = rows.where("node is null").withColumn("component_id", F.col("doc_id"))
    out = rows.where("node is not null").join(named, "node").unionByName(alone).select("doc_id", "row", "n_shingles", "component_id")
    out._scratch = named._scratch
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) for each row of documents."""
    mark, docs = made(), rows_of(docs)
    rows, classes, first = numbered(docs, signatures, lambda classes: F.monotonically_increasing_id())
    members = candidates(first)
    out = joined(rows, classes, members, first, texts_of_members(docs, members, first), CHECK)
    discarded(docs.sparkSession, mark, rows, out)  # nothing else is read from now on
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    return labelled(docs).drop("row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which one of each component stays; all columns.  Equal rows of an id that stays become one."""
    rows = labelled(docs)
    gone = saved(rows.where("not kept").select("doc_id").distinct(), "gone")
    twice = saved(rows.where("kept and doc_id is not null").groupBy("doc_id", "row").count().where("count > 1").select("doc_id").distinct(), "twice")
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = docs.join(gone.union(twice), "doc_id", "left_anti").select(docs.columns)
    return once.union(docs.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


#: The same result by counting common shingles of all pairs.
ORACLE_SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * both_have >= 75 * (nx.n + ny.n - both_have)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as node from t union select r.doc_id, e.y from r join e on r.node = e.x),
c as (select doc_id, min(node) as component_id from r group by doc_id)
select c.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)"""
