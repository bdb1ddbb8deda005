"""From buckets of candidates to confirmed links and components, whatever the size of a bucket.

Members are classes of equal sets.  A `Check` says which pairs of sketches may be
links, and when two sets are.  In each bucket the smallest member is the hub.

1. Buckets of the same members are one (128 bits of a hash of their members), and so
   are a hub's buckets if together they have at most `MERGE` times the members of its
   largest: what groups of near copies share gives them many buckets of much the same members.
2. Pairs of hub and member are compared by their sketches.  Only the likely ones
   bring texts: a hub's text once for `BLOCK` members, each member's once a hub.
3. Buckets that their hubs' links do not hold together are compared in cells of
   two blocks of members, by sketches, and what is likely in smaller cells by
   sets.  A cell returns links only as far as they join components.

Hot groups: hubs are found by a partial aggregate and brought to members by a join
of tables, whose skewed partitions Spark splits; stars and cells bound what one
task holds.  The driver receives two numbers per iteration of components().  A
bucket of n members that no hub holds together costs n**2 / SKETCHES sketches:
that much any exact comparison within a bucket needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import buffers
from .common import discarded, made, saved

#: Members of a block whose sketches are compared; members, and shingles, of one whose sets are.
SKETCHES = 512
BLOCK, BLOCK_SHINGLES = 256, 300_000
#: How much larger than its largest bucket the union of a hub's buckets may be.
MERGE = 2
#: Places where members of a mixed bucket meet its statistics.
SALTS = 16
#: Columns of the matrix of shingles that are held at once.
SLICE = 4096
ROUNDS = 60


class Check:
    """A threshold numerator / denominator on Jaccard similarity, sets of texts, and what sketches tell of pairs.

    `sets` gives the sorted hashes of each text and where each text's begin.
    `pairs` and `grid` say of rows, or of all pairs of a block, which may be links:
    they get sketches as bytes (rows x width) and set sizes.
    """

    def __init__(self, numerator: int, denominator: int, sets: Callable, pairs: Callable, grid: Callable):
        self.numerator, self.denominator, self.sets, self.pairs, self.grid = numerator, denominator, sets, pairs, grid

    def linked(self, both, one, other):
        return self.denominator * both >= self.numerator * (one + other - both)

    def sized(self, one, other):
        """Whether sizes allow a link."""
        return self.denominator * np.minimum(one, other) >= self.numerator * np.maximum(one, other)


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1) if blobs else np.empty((0, 1), np.uint8)


# ---- buckets and hubs ----


def buckets(keyed: DataFrame) -> DataFrame:
    """Members of buckets of two or more, from (key, node, n_shingles): (key, node, n_shingles, hub, n)."""
    mark = lambda salt: F.expr(f"bit_xor(xxhash64(node, {salt}L))")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    hubs = hubs.groupBy("hub", "n", "x", "y").agg(F.min("key").alias("key")).select("key", "hub", "n")
    own = saved(keyed.join(saved(hubs, "hubs"), "key"), "own-buckets")  # read from tables, both sides of the join are shuffled and can be split
    both = saved(own.select("hub", "node", "n_shingles").distinct(), "unions")
    largest = own.groupBy("hub").agg(F.max("n").alias("largest"))
    unions = both.groupBy("hub").agg(F.count("*").alias("n")).join(largest, "hub")
    merged = saved(unions.where(F.col("n") <= MERGE * F.col("largest")).select("hub", "n"), "merged")
    apart = own.join(merged.select("hub"), "hub", "left_anti").select("key", "node", "n_shingles", "hub", "n")
    union = both.join(merged, "hub").select(F.col("hub").alias("key"), "node", "n_shingles", "hub", "n")
    return saved(apart.union(union), "buckets")


def likely(check: Check) -> Callable:
    """The pairs (a, b, a_sig, b_sig, a_n, b_n) that may be links, as (a, b, b_n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("a_n", "b_n")]
            found = check.pairs(_sketches(batch.column("a_sig")), _sketches(batch.column("b_sig")), *sizes) & check.sized(*sizes)
            yield batch.select(["a", "b", "b_n"]).filter(pa.array(found))

    return run


def star(check: Check) -> Callable:
    """Links of a hub with its members (a, node, text), as (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["a", "node", "text"])
        a, node = table.column("a").to_numpy(), table.column("node").to_numpy()
        flat, first = check.sets(*buffers(table.column("text")))
        hub = int(np.flatnonzero(node == a)[0])
        own = flat[first[hub] : first[hub + 1]]
        size = np.diff(first)
        place = np.searchsorted(own, flat)
        hits = np.r_[0, np.cumsum(own[np.minimum(place, len(own) - 1)] == flat)]
        both = hits[first[1:]] - hits[first[:-1]]
        found = check.linked(both, size, len(own)) & (node != a)
        return pa.table({"a": pa.array(a[found]), "b": pa.array(node[found])})

    return run


def hub_links(members: DataFrame, sketches: DataFrame, texts: DataFrame, check: Check) -> DataFrame:
    """Confirmed links (a, b) between hubs and members; sketches are (node, sig, n_shingles), texts (node, text)."""
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    for side in ("b", "a"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sig").alias(f"{side}_sig"), F.col("n_shingles").alias(f"{side}_n")), side)
    pairs = saved(pairs.select("a", "b", "a_sig", "b_sig", "a_n", "b_n").mapInArrow(likely(check), "a bigint, b bigint, b_n bigint"), "likely-pairs")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("b_n") / BLOCK_SHINGLES)).cast("int")
    blocks = saved(pairs.groupBy("a").agg(blocks.alias("blocks")), "stars")
    spot = F.pmod(F.xxhash64("b", F.lit(5)), F.col("blocks")).cast("int")
    rays = pairs.join(blocks, "a").select("a", spot.alias("block"), F.col("b").alias("node"))
    centres = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"))
    stars = rays.union(centres).join(texts.select("node", "text"), "node")
    return stars.groupBy("a", "block").applyInArrow(star(check), "a bigint, b bigint")


# ---- cells ----


def cell_likely(check: Check) -> Callable:
    """(key, node) of a cell's classes (key, node, component, sig, n_shingles) that have a likely partner in another component."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("n_shingles").to_numpy()
        comp = table.column("component").to_numpy()
        found = check.grid(_sketches(table.column("sig")), size) & check.sized(size[:, None], size[None, :]) & (comp[:, None] != comp[None, :])
        return table.select(["key", "node"]).filter(pa.array(found.any(axis=1)))

    return run


def cell_links(check: Check) -> Callable:
    """Links of a cell's classes (node, component, text) that join different components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["node", "component", "text"])
        flat, first = check.sets(*buffers(table.column("text")))
        size = np.diff(first)
        both = overlaps(flat, first)
        comp = table.column("component").to_numpy()
        ids = table.column("node").to_numpy()
        found = check.linked(both, size[:, None], size[None, :]) & (comp[:, None] < comp[None, :]) & (size > 0)[:, None]
        a, b = spanning(np.nonzero(found), comp, ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def overlaps(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many elements each two sets have in common."""
    size = np.diff(first)
    own = np.repeat(np.arange(len(size)), size)
    values, index, seen = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    column[seen > 1] = np.arange(int((seen > 1).sum()))
    at = column[index]
    own, at = own[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    both = np.zeros((len(size), len(size)), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, SLICE):
        a, b = np.searchsorted(at, (lo, lo + SLICE))
        grid = np.zeros((len(size), SLICE), np.float32)
        grid[own[a:b], at[a:b] - lo] = 1
        both += (grid @ grid.T).astype(np.int64)  # a slice counts exactly in single precision
    return both


def spanning(found: tuple, comp: np.ndarray, ids: np.ndarray) -> tuple[list, list]:
    """Of links between rows, those that join components."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    a, b = [], []
    for i, j in zip(*(x.tolist() for x in found), strict=True):
        x, y = root(int(comp[i])), root(int(comp[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            a.append(int(ids[i]))
            b.append(int(ids[j]))
    return a, b


def cells(rows: DataFrame, block: int, block_shingles: int, name: str) -> DataFrame:
    """(key, i, j, node, component): every two members (key, node, component, n_shingles, hub) of a bucket's different components meet in a cell.

    Of a bucket, `j` numbers blocks of all members and `i` blocks of those outside of its largest part, the hub's component.
    """
    own = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.bool_or(F.col("node") == F.col("hub")).alias("with_hub"))
    outside = lambda c: F.sum(F.when(~F.col("with_hub"), F.col(c)))
    keys = own.groupBy("key").agg(
        F.max(F.when(F.col("with_hub"), F.col("component"))).alias("main"), F.sum("size").alias("n"), F.sum("weight").alias("shingles"),
        outside("size").alias("left"), outside("weight").alias("left_shingles"), F.count("*").alias("parts"),
    )
    # Members of one bucket meet its statistics in SALTS places, so that a hot bucket has no task of its own.
    salted = saved(keys.where("left > 0 and parts > 1"), name).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.select("key", "node", "component", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.join(salted.hint("merge"), ["key", "salt"]).drop("salt")  # the copies must not be broadcast
    blocks = lambda n, s: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(s) / block_shingles), F.lit(1)).cast("int")
    rows = rows.withColumns({"across": blocks("n", "shingles"), "down": blocks("left", "left_shingles")})

    def spot(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    as_member = rows.select("*", spot(1, "across").alias("j"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"))
    as_left = rows.where("coalesce(component <> main, true) and (across > 1 or down > 1)").select("*", spot(2, "down").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    return as_member.select("key", "i", "j", "node", "component").union(as_left.select("key", "i", "j", "node", "component")).distinct()


def rest_links(members: DataFrame, parts: DataFrame, sketches: DataFrame, texts: DataFrame, check: Check) -> DataFrame:
    """Links that hubs do not have, from buckets of three or more in several components."""
    rows = members.where("n > 2").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = saved(rows.select("key", "node", "component", "n_shingles", "hub"), "bucket-parts")
    by_sketch = cells(rows, SKETCHES, 1 << 62, "mixed").join(sketches.select("node", "sig", "n_shingles"), "node").select("key", "i", "j", "node", "component", "sig", "n_shingles")
    likely = by_sketch.groupBy("key", "i", "j").applyInArrow(cell_likely(check), "key bigint, node bigint").distinct()
    rows = saved(rows.join(saved(likely, "likely"), ["key", "node"]), "likely-parts")
    by_text = cells(rows, BLOCK, BLOCK_SHINGLES, "mixed-likely").join(texts.select("node", "text"), "node")
    return by_text.groupBy("key", "i", "j").applyInArrow(cell_links(check), "a bigint, b bigint")


# ---- components ----


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of links (a, b), by alternating large-star and small-star."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.sum((F.xxhash64("v", "u") % 998_244_353).cast("long"))).first()
        if now == state:
            break
        state, mark = now, made()
        both = edges.union(edges.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # a table, so that a hot node's side can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large-star")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discarded(links.sparkSession, mark, edges)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
