"""Exact join of documents by the Jaccard similarity of their shingle sets, with prefixes of token combinations.

A document's set holds its distinct shingles of five lower-cased (A-Z) words, as
in neardup; documents are linked if 100 * intersection >= 80 * union.  Nothing
is estimated: every link is found, and confirmed on the full sets.

Method.  Tokens are shingles, rows of equal sets are one class, and one global
order of tokens is used throughout.
1. The order.  Tokens whose hash lies in the lowest `SHARE` come first, by how many
   classes have them (then by hash); all others follow, by the same rule.  A class
   whose low tokens make up a whole prefix hands on only these, others all of theirs,
   so counting moves about a third of the tokens and still covers every class.
   Tokens of one class are never indexed: their number is all that matters.
2. Classes of tokens.  A token of up to `RARE` sets is indexed by itself (k = 1), a
   frequent one in combinations of k = 2 with others of its group; a group is
   a hash modulo a number that grows with the size of the set, so that about four tokens
   of a prefix meet in one.
3. Extended prefixes.  A set x may lack |x| - ceil(0.8 |x|) tokens of a partner.  A
   token of class k adds 1 to what must be lacking for no signature to be shared, but
   for the first k - 1 of its group.  The prefix ends once more must lack than may.
   Of two linked sets let x be the one whose prefix ends first in the global order:
   the partner has all tokens of that prefix which it shares in its own prefix, and
   as too few are lacking, k of one group, or a rare one, are shared: one signature.
4. Sets whose sizes differ by more than 0.8 can't be linked: signatures hold a size
   class (powers of two), and sets near a limit stand in both.
5. Classes that share a signature are members of a bucket; buckets become
   links and components as links.py says.  Sketches are parities of 4096 hash cells:
   they differ in at most as many cells as sets have tokens apart, so none
   that they rule out is a link.

Hot groups: copies are one class after partial aggregation.  A token that `MANY` classes of
one task have costs that task one row where it is counted, and its classes' rows are
dealt by the class; they learn the count by a join in `SALTS` parts.

Defined results: as in neardup (null texts, null ids, rows of one id, empty
tables, extra columns), without `kept`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import U64, chunks, mix
from .common import discarded, made, saved, table
from .links import Check, buckets
from .neardup import joined, numbered, rows_of, set_digests, shingle_sets, texts_of_members

NUMERATOR, DENOMINATOR = 80, 100
#: Tokens with a hash below this come first in the global order.
SHARE = 1 / 3
_LOW = U64(int(SHARE * 2**64))
#: Sets that a token of class 1 is in at most; tokens of a group of class 2 in a prefix, about.
RARE, GROUP = 32, 4
#: Classes of a task that a token needs there to be counted apart; parts in which they learn the count.
MANY, SALTS = 8, 16
#: Tokens that a task holds before it hands them on.
HELD = 1_500_000
#: Cells of a sketch.
CELLS = 4096

_STEP = U64(0x9E3779B97F4A7C15)


def lacking(size: np.ndarray | int) -> np.ndarray | int:
    """How many tokens a partner lacks at most, and one more."""
    return size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1


def size_classes(size: int) -> range:
    """The classes (powers of two) in which the set meets all sets that it may be linked with."""
    least, most = -(-NUMERATOR * size // DENOMINATOR), DENOMINATOR * size // NUMERATOR
    return range(max(least, 1).bit_length(), most.bit_length() + 1)


def groups(size_class: int) -> int:
    """Number of groups of frequent tokens."""
    return max(1, lacking(1 << (size_class - 1)) // GROUP)


def prefix_bound(size: int) -> int:
    """Tokens that a prefix has at most."""
    return lacking(size) + groups(size_classes(size)[-1])


def parities(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each non-empty set, whether each cell has an odd number of tokens."""
    sets = [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a]
    return np.stack([np.packbits(np.bincount((s >> U64(7)) % U64(CELLS), minlength=CELLS).astype(np.uint8) & 1) for s in sets]) if sets else np.empty((0, CELLS // 8), np.uint8)


def near(apart: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets may be linked that are so many tokens apart, at least."""
    return (DENOMINATOR + NUMERATOR) * apart.astype(np.int64) <= (DENOMINATOR - NUMERATOR) * (one + other)


def near_pairs(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    return near(np.bitwise_count(a ^ b).sum(axis=1), a_n, b_n)


def near_grid(sig: np.ndarray, size: np.ndarray) -> np.ndarray:
    signs = np.unpackbits(sig, axis=1).astype(np.float32) * 2 - 1
    apart = (signs.shape[1] - signs @ signs.T) / 2
    return near(np.rint(apart), size[:, None], size[None, :])


CHECK = Check(NUMERATOR, DENOMINATOR, shingle_sets, near_pairs, near_grid)


# ---- the global order ----

#: Kinds of rows: a token of a class; how many classes of a task have a token; a token of a class that is counted so; a class and its low tokens.
PLAIN, COUNT, APART, CLASS = range(4)
TOKENS = "kind tinyint, key bigint, node bigint, n bigint"
FIELDS = ["kind", "key", "node", "n"]


def _numbers(flat: np.ndarray, first: np.ndarray, turn: int) -> np.ndarray:
    one, other = set_digests(flat, first)
    return one ^ (other << U64(turn))


def number(classes: DataFrame, turn: int) -> Column:
    return F.col("d0").bitwiseXOR(F.shiftleft("d1", turn))


def tokens(turn: int):
    """Rows of TOKENS for texts: each class of a task once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for _, buf, offs in chunks(batch):
                flat, first = shingle_sets(buf, offs)
                nodes, sizes = _numbers(flat, first, turn), np.diff(first)
                low = np.r_[0, np.cumsum(flat < _LOW)]
                low = low[first[1:]] - low[first[:-1]]
                fresh = np.zeros(len(sizes), bool)
                for d, node in enumerate(nodes.tolist()):
                    if sizes[d] and node not in seen:
                        seen.add(node)
                        fresh[d] = True
                enough = np.array([low[d] >= prefix_bound(max(int(sizes[d]), 1)) for d in range(len(sizes))], bool)
                own = np.repeat(np.arange(len(sizes)), sizes)
                pick = fresh[own] & ((flat < _LOW) | ~enough[own])
                held.append((flat[pick], nodes[own[pick]]))
                size += int(pick.sum())
                yield _rows(CLASS, mix(nodes[fresh]), nodes[fresh], low[fresh])
                if size >= HELD:
                    yield from _token_rows(held)
                    held, seen, size = [], set(), 0
        if held:
            yield from _token_rows(held)

    return run


def _rows(kind: int, key: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64))], FIELDS)


def _token_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    token, node = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(token, kind="stable")
    token, node = token[order], node[order]
    head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    seen = np.diff(np.r_[head, len(token)])
    many = np.repeat(seen >= MANY, seen)
    zero = np.zeros(len(token), np.int64)
    yield _rows(PLAIN, token[~many], node[~many], zero[~many])
    yield _rows(APART, token[many] ^ mix(node[many]), node[many], zero[many])
    head = head[seen >= MANY]
    yield _rows(COUNT, token[head], zero[: len(head)], seen[seen >= MANY])


def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TOKENS sorted by key to rows of the same columns: tokens of two classes or more with their count (key: token)."""
    rest = [np.empty(0, np.int8), *(np.empty(0, np.int64) for _ in range(3))]
    for batch in batches:
        cols = [np.r_[r, batch.column(c).to_numpy()] for r, c in zip(rest, FIELDS, strict=True)]
        done = int(np.searchsorted(cols[1], cols[1][-1])) if len(cols[1]) else 0
        rest = [c[done:] for c in cols]
        yield from _shared(*(c[:done] for c in cols))
    yield from _shared(*rest)


def _shared(kind: np.ndarray, key: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    order = np.lexsort((node, kind, key))
    kind, key, node, n = kind[order], key[order], node[order], n[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (node[1:] != node[:-1])] | (kind == COUNT)
    kind, key, node, n = kind[fresh], key[fresh], node[fresh], n[fresh]  # a class of several tasks once
    through = kind == CLASS
    yield _rows(CLASS, key[through], node[through], n[through])
    through = kind == APART
    yield _rows(APART, key[through] ^ mix(node[through].view(np.uint64)).view(np.int64), node[through], n[through])
    counted = (kind == PLAIN) | (kind == COUNT)
    kind, key, node, n = kind[counted], key[counted], node[counted], n[counted]
    if not len(key):
        return
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    total = np.add.reduceat(np.where(kind == PLAIN, 1, n), head)
    plain = (kind == PLAIN) & np.repeat(total > 1, size)
    yield _rows(PLAIN, key[plain], node[plain], np.repeat(total, size)[plain])
    tasks = np.add.reduceat((kind == COUNT).astype(np.int64), head) > 0
    yield _rows(COUNT, key[head][tasks], np.zeros(int(tasks.sum()), np.int64), total[tasks])


# ---- signatures ----


def signatures(size: int, low: int, token: np.ndarray, count: np.ndarray) -> list[int]:
    """Signatures of a set of `size` tokens, `low` of them low, from those that other sets have, with their counts."""
    token, at = np.unique(token, return_index=True)
    count = count[at]
    need = lacking(size)
    late = token >= _LOW
    alone = low - int((~late).sum())  # low tokens that no other set has come first
    if alone >= need:
        return []
    order = np.lexsort((token, count, late))
    token, frequent, late = token[order], count[order] > RARE, late[order]
    late_alone = 0 if low >= prefix_bound(size) else size - low - int(late.sum())
    before = alone + np.where(late, late_alone, 0)
    out = []
    for size_class in size_classes(size):
        group = np.where(frequent, (mix(token) % U64(groups(size_class))).astype(np.int64), -1)
        by_group = np.argsort(group, kind="stable")
        head = np.r_[True, group[by_group][1:] != group[by_group][:-1]]
        opens = np.zeros(len(token), bool)
        opens[by_group[head]] = True
        adds = ~(opens & frequent)
        reached = before + np.cumsum(adds)
        end = int(np.searchsorted(reached, need)) + 1  # counts rise along the order
        if late_alone and end <= len(token) and late[min(end, len(token)) - 1] and alone + int(adds[~late].sum()) + late_alone >= need:
            end = int((~late).sum())  # what only this set has ends the prefix before its late tokens
        seed = mix(np.array([size_class], np.uint64))
        prefix, own = token[:end], group[:end]
        out += mix(seed + mix(prefix[own < 0] + U64(1))).tolist()
        for g in np.unique(own[own >= 0]).tolist():
            members = np.sort(prefix[own == g])
            for a, b in itertools.combinations(range(len(members)), 2):
                out.append((a, b, members, seed))
    return _combined(out)


def _combined(parts: list) -> list[int]:
    """Signatures of single tokens, and of pairs, all at once."""
    single = [p for p in parts if isinstance(p, int)]
    pairs = [p for p in parts if not isinstance(p, int)]
    if not pairs:
        return single
    first = np.array([m[a] for a, _, m, _ in pairs], np.uint64)
    second = np.array([m[b] for _, b, m, _ in pairs], np.uint64)
    seed = np.concatenate([s for *_, s in pairs])
    return single + mix(mix(first * _STEP + second) + seed + U64(2)).tolist()


KEYED = "key bigint, node bigint, n_shingles bigint"


def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYED for classes (node, low, n_shingles, tokens) with their shared tokens (token, n)."""
    for batch in batches:
        node, low, size = (batch.column(c).to_numpy() for c in ("node", "low", "n_shingles"))
        lists = batch.column("tokens")
        token = lists.flatten().field("token").to_numpy().view(np.uint64)
        count = lists.flatten().field("n").to_numpy()
        first = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        for at in range(0, len(node), 256):
            keys, own = [], []
            for d in range(at, min(at + 256, len(node))):
                part = slice(first[d], first[d + 1])
                found = signatures(int(size[d]), int(low[d]), token[part], count[part])
                keys += found
                own += [d] * len(found)
            own = np.array(own, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(node[own]), pa.array(size[own])], [c.split()[0] for c in KEYED.split(", ")])


def candidates(docs: DataFrame, first: DataFrame, turn: int) -> DataFrame:
    """Members of buckets of equal signatures."""
    rows = docs.where("doc_id is not null").select("text").mapInArrow(tokens(turn), TOKENS)
    rows = saved(rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared, TOKENS), "tokens")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    counts = rows.where(F.col("kind") == COUNT).select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    apart = rows.where(F.col("kind") == APART).select("node", "key", salt("node").alias("salt")).join(counts.hint("merge"), ["key", "salt"])
    of = rows.where(F.col("kind") == PLAIN).select("node", "key", "n").union(apart.select("node", "key", "n"))
    lists = of.groupBy("node").agg(F.collect_list(F.struct(F.col("key").alias("token"), "n")).alias("tokens"))
    low = rows.where(F.col("kind") == CLASS).groupBy("node").agg(F.max("n").alias("low"))
    sets = lists.join(low, "node").join(first.select("node", "n_shingles"), "node").select("node", "low", "n_shingles", "tokens")
    return buckets(saved(sets.mapInArrow(keyed, KEYED), "signatures"))


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) for each row of documents."""
    mark, docs = made(), rows_of(docs)
    for turn in range(8):  # a class's number is a hash; another one is taken if two classes have the same
        rows, classes, first = numbered(docs, parities, lambda classes, turn=turn: number(classes, turn))
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            break
    members = candidates(docs, first, turn)
    out = joined(rows, classes, members, first, texts_of_members(docs, members, first), CHECK)
    discarded(docs.sparkSession, mark, rows, out)
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


#: The same result by counting common shingles of all pairs.
ORACLE_SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * both_have >= 80 * (nx.n + ny.n - both_have)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as node from t union select r.doc_id, e.y from r join e on r.node = e.x),
c as (select doc_id, min(node) as component_id from r group by doc_id)
select c.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from c left join n using (doc_id)"""
