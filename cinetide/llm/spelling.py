"""Groups of spelling variants: words within one insertion, deletion or replacement.

Words come from maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, A-Z in lower
case.  Where 31 divides h, the crc32 of `<doc_id>:<run>`, the run loses its code
point h % length.  Words are what results, of at least `LEAST_LENGTH` code points
and `LEAST_COUNT` occurrences.  A word's form is its near word of largest count
(ties: the smallest in code-point order), if that has `RATIO` times its count or more.

Method.
1. Runs are cut from the Arrow buffers, their checksums are continued from the
   checksum of `<doc_id>:` for all runs of a chunk at once, and the words of a chunk
   are counted before Spark adds the counts.
2. Prefix and suffix polynomials over the field of 2**61 - 1 give the hash of a word
   without any one code point by two additions: one numpy pass makes one key per
   code point, (hash, place), and one for the word itself (place -1).  Words that
   differ by a replacement share hash and place; of words that differ by an
   insertion, one's whole hash is the other's key.
3. Keys carry no strings.  They are dealt by their top bits and sorted, and a scan
   of the sorted keys lets through only those that meet another word.
4. What meets is verified on strings: survivors bring their words and are grouped by
   the real remainder and place, so a collision of hashes joins nothing.
5. Roots follow forms by doubling: each step multiplies the count by `RATIO`, so the
   longest way has fewer than 19 steps, and five doublings reach its end.

No pairs are made within a group: a replaced group gives each member its size and
the better of its two best words.  Groups are bounded whatever the data: a
remainder of l code points with one more at some place has at most
(l + 1) * LETTERS words, a replaced group LETTERS.  Counting is the only step over
the corpus; a word on a third of all rows costs a row per task there.

Defined results: a null or empty text has no runs; a null id deletes nothing, as
there is no checksum; rows that stand there twice count twice; a very long run is
a word like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import LOWER, U64, chunks, halves, joined, mix, powers, times
from .common import discarded, made, saved, table

DELETES = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10
#: a-z and the 64 code points from U+00C0 on.
LETTERS = 90
#: Doublings that reach the end of any way of forms: counts are below 2**63 < RATIO**19.
DOUBLINGS = 5
#: Runs above so many bytes get their checksum one by one.
LONG = 64
#: Top bits of a key by which keys are dealt.
RADIX = 16
#: Keys, or code points, that are made at once.
HELD = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The lead byte of U+00C0 to U+00FF.
LEAD = 0xC3


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


# ---- words of texts ----


def runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte limits of the maximal runs, and the text of each."""
    inside = np.zeros(len(buf) + 2, bool)
    lead = buf == LEAD
    inside[1:-1] = LETTER[buf] | lead
    inside[2:-1] |= lead[:-1]
    mid = inside[1:-1]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(mid & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(mid & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, continued from the checksums `begun`."""
    out = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    at, k = np.flatnonzero(size <= LONG), 0
    while len(at):
        out[at] = (out[at] >> np.uint32(8)) ^ _CRC[(out[at] ^ buf[starts[at] + k]) & np.uint32(255)]
        k += 1
        at = at[size[at] > k]
    out ^= np.uint32(0xFFFFFFFF)
    for r in np.flatnonzero(size > LONG).tolist():
        out[r] = zlib.crc32(buf[starts[r] : ends[r]].tobytes(), int(begun[r]))
    return out


def words_of(buf: np.ndarray, offs: np.ndarray, ids: list) -> pa.Array:
    """The words of some texts, one per occurrence, as strings."""
    buf = LOWER[buf]
    starts, ends, doc = runs(buf, offs)
    begins = np.r_[np.cumsum((buf & 0xC0) != 0x80) - 1, 0]  # number of the code point that a byte belongs to
    length = begins[ends - 1] - begins[starts] + 1
    long = length >= LEAST_LENGTH
    starts, ends, doc, length = starts[long], ends[long], doc[long], length[long]
    begun = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], np.uint32)
    known = np.array([i is not None for i in ids], bool)
    h = checksums(buf, starts, ends, begun[doc])
    cut = (h % DELETES == 0) & known[doc]
    places = np.flatnonzero((buf & 0xC0) != 0x80)
    kept = np.zeros(len(buf) + 1, np.int8)
    kept[starts] += 1
    kept[ends] -= 1
    kept = np.cumsum(kept[:-1], dtype=np.int8)
    gone = places[begins[starts[cut]] + (h[cut] % length[cut].astype(np.uint32))]
    kept[gone] = 0
    wide = gone[buf[gone] == LEAD]
    kept[wide + 1] = 0
    size = ends - starts
    size[cut] -= np.where(buf[gone] == LEAD, 2, 1)
    short = cut & (length == LEAST_LENGTH)
    limits = np.r_[0, np.cumsum(size)].astype(np.int32)
    out = pa.StringArray.from_buffers(len(size), pa.py_buffer(limits.tobytes()), pa.py_buffer(buf[kept.astype(bool)].tobytes()))
    return out.filter(pa.array(~short)) if short.any() else out


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each chunk of texts."""
    for batch in batches:
        for part, buf, offs in chunks(batch):
            if len(buf):
                counts = pc.value_counts(words_of(buf, offs, part.column("doc_id").to_pylist()))
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words."""
    parts = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- keys ----


def deletion_keys(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words as code points (word w is flat[first[w]:first[w + 1]]): hash, place and word of each key.

    With p(k) the sum of c_i b**i over the first k code points of a word and s(k)
    the sum over the rest, divided by b, the word without code point k is
    p(k) + s(k + 1): what follows the gap moves down by one power.
    """
    size = np.diff(first)
    n = len(flat)
    own = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - first[own]
    up = powers(int(size.max(initial=0)) + 1)
    value = flat.astype(np.uint64) + U64(1)
    terms = [times(value, (up[0][place], up[1][place]))]
    terms.append(times(value, (up[0][np.maximum(place - 1, 0)], up[1][np.maximum(place - 1, 0)])))
    sums = []
    for term in terms:  # sums of halves stay below 2**62 for any chunk of HELD code points
        high, low = (np.r_[np.zeros(1, np.uint64), np.cumsum(x)] for x in halves(term))
        sums.append((high, low))
    at = np.arange(n)
    (ph, pl), (sh, sl) = sums
    start, end = first[:-1][own], first[1:][own]
    without = joined((ph[at] - ph[start]) + (sh[end] - sh[at + 1]), (pl[at] - pl[start]) + (sl[end] - sl[at + 1]))
    whole = joined(ph[first[1:]] - ph[first[:-1]], pl[first[1:]] - pl[first[:-1]])
    return mix(np.r_[without, whole]), np.r_[place, np.full(len(size), -1)], np.r_[own, np.arange(len(size))]


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some words, and where each word's begin."""
    raw = "".join(words.to_pylist()).encode("utf-32-le")
    return np.frombuffer(raw, np.uint32), np.r_[0, np.cumsum(pc.utf8_length(words).to_numpy())]


KEYS = "key bigint, place int, node bigint"


def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS for each word (node, word)."""
    for batch in batches:
        words = batch.column("word")
        sizes = np.r_[0, np.cumsum(pc.utf8_length(words).to_numpy())]
        node = batch.column("node").to_numpy()
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + HELD, "right")) - 1)
            key, place, own = deletion_keys(*code_points(words.slice(at, to - at)))
            for k in range(0, len(key), HELD):
                part = slice(k, k + HELD)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(place[part].astype(np.int32)), pa.array(node[at:to][own[part]])], ["key", "place", "node"])
            at = to


def meeting(key: np.ndarray, place: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of keys sorted by hash and place: those that are of use.

    A place with two words or more is a replaced group.  Of a hash that is some
    word's own, the first place of each other word tells of an insertion.
    """
    n = len(key)
    if not n:
        return np.zeros(0, bool)
    fresh = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(fresh) - 1
    spot = np.cumsum(fresh | np.r_[True, place[1:] != place[:-1]]) - 1
    out = (np.bincount(spot)[spot] > 1) & (place >= 0)
    several = np.flatnonzero((np.bincount(group, place < 0)[group] > 0) & (np.bincount(group)[group] > 1))
    own, of = node[several], group[several]
    order = np.lexsort((place[several], own, of))
    first = np.r_[True, (own[order][1:] != own[order][:-1]) | (of[order][1:] != of[order][:-1])] if len(order) else np.zeros(0, bool)
    out[several[order[first]]] = True
    return out


def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS, sorted by key and place, that meet others; what a batch ends with waits for the next."""
    rest = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
    for batch in batches:
        cols = [np.r_[r, batch.column(c).to_numpy()] for r, c in zip(rest, ("key", "place", "node"), strict=True)]
        done = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        rest = [c[done:] for c in cols]
        yield _chosen([c[:done] for c in cols])
    yield _chosen(rest)


def _chosen(cols: list[np.ndarray]) -> pa.RecordBatch:
    chosen = meeting(*cols)
    return pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in cols], ["key", "place", "node"])


# ---- near words ----


def meetings(words: DataFrame) -> DataFrame:
    """(word, n, rest, place) of keys that meet others: the real remainder, and -1 as the place of a whole word."""
    dealt = words.select("node", "word").mapInArrow(keys, KEYS)
    dealt = dealt.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "place").mapInArrow(met, KEYS)
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    return dealt.select("place", "node").join(words, "node").select("word", "n", "place", rest.alias("rest"))


def _order(n: str, word: str) -> Column:
    """Smallest for the largest count, then for the smallest word."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of words with near ones; best is (minus its count, word)."""
    keys_met = saved(meetings(words), "meetings")
    grouped = keys_met.where("place >= 0").groupBy("rest", "place").agg(F.sort_array(F.collect_list(_order("n", "word"))).alias("members"))  # LETTERS members at most
    members = grouped.where(F.size("members") > 1).select("members", F.explode("members").alias("own"))
    first, second = F.col("members")[0], F.col("members")[1]
    replaced = members.select(F.col("own.word").alias("word"), (F.size("members") - 1).alias("near"), F.when(F.col("own.word") == first["word"], second).otherwise(first).alias("best"))
    whole = keys_met.where("place < 0").select("rest", F.col("n").alias("whole_n"))
    shorter = keys_met.where("place >= 0").select("rest", "word", "n").distinct().join(whole, "rest")  # each row is a pair of near words
    to_shorter = shorter.select("word", F.lit(1).alias("near"), _order("whole_n", "rest").alias("best"))
    to_longer = shorter.select(F.col("rest").alias("word"), F.lit(1).alias("near"), _order("n", "word").alias("best"))
    return replaced.union(to_shorter).union(to_longer).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling."""
    ways = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = saved(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return ways


RESULT = "word string, form string, root string, n bigint, n_near bigint, form_n bigint"


def variants(docs: DataFrame) -> DataFrame:
    """Rows of RESULT: each word with its form and root."""
    mark = made()
    words = saved(vocabulary(docs).select("word", "n", F.monotonically_increasing_id().alias("node")), "words")
    near = saved(near_words(words), "near")
    form_n = -F.col("best.minus")
    has_form = form_n >= F.lit(RATIO) * F.col("n")
    rows = words.drop("node").join(near, "word", "left").select(
        "word", F.when(has_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, form_n).alias("form_n"),
    )
    rows = saved(rows, "forms")
    ends = roots(rows.where("form is not null"))
    discarded(docs.sparkSession, mark, rows, ends)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same result by SQL, with the checksum as a fold over bytes.
ORACLE_SQL = r"""
with recursive poly as (select list(c order by i) as t from (select i, list_reduce(list_prepend(cast(i as ubigint), list_transform(range(8), lambda k: cast(k as ubigint))),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
runs as (select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[a-z\x{00C0}-\x{00FF}]+')) as run from docs) where length(run) >= 7 group by all),
sums as (select doc_id, run, k, xor(list_reduce(list_prepend(cast(4294967295 as ubigint), flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: case when ord(c) < 128 then [cast(ord(c) as ubigint)] else [cast(192 + (ord(c) >> 6) as ubigint), cast(128 + (ord(c) & 63) as ubigint)] end))),
    lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 as int) + 1])), cast(4294967295 as ubigint)) as h from runs, poly),
found as (select case when h % 31 = 0 then run[: cast(h % length(run) as int)] || run[cast(h % length(run) as int) + 2 :] else run end as word, k from sums),
words as (select word, cast(sum(k) as bigint) as n from found where length(word) >= 7 group by word having sum(k) >= 2),
places as (select word, n, unnest(range(length(word))) as place from words),
gaps as (select word, n, place, word[: place] || word[place + 2 :] as rest from places),
near as (select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.place = b.place and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select w.word, g.word, g.n from gaps g join words w on g.rest = w.word),
best as (select word, count(*) as n_near, max(other_n) as top_n from near group by word),
named as (select word, n_near, top_n, min(other) as top from best join near using (word) where other_n = top_n group by all),
forms as (select w.word, case when top_n >= 10 * n then top end as form, n, coalesce(n_near, 0) as n_near, case when top_n >= 10 * n then top_n end as form_n from words w left join named using (word)),
ways as (select word, word as tip from words union all select ways.word, form from ways join forms on ways.tip = forms.word where form is not null),
ends as (select ways.word, tip as root from ways join forms on ways.tip = forms.word where form is null)
select word, form, root, n, n_near, form_n from forms join ends using (word)"""
