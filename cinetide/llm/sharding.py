"""Sharding through fixed virtual slots.

A record's id, text checksum and size are hashed into one of `SLOTS` virtual slots.
Bytes and rows are aggregated per slot, never per record, and a slot-to-shard map,
one row per slot and version, says where a slot lives.  The map is a table in the
shared folder, a folder per version: `rebalanced` reads the last version, edits it
for the bytes that the slots have now or for more shards, moving few slots, and
commits the next one; only a data set without a map gets one made from nothing.

The law is `bytes`: shards get nearly equal sizes.  The first map deals slots,
largest first, to the lightest shard, so two shards differ by at most the largest
slot's bytes; later ones keep that as long as a slot can be moved.  Since ids and
texts are hashed, copies of one text and rows of one source spread over all slots.

Equal records.  A record's slot is a function of its content and, for records that
are equal in id and text, of their ordinal: the first is hashed by content alone, the k-th
by content and k.  So a record that stands there millions of times spreads over all
slots, and which slots it takes depends on nothing but how often it stands there.
Ordinals are counted in parts: a row's place in its input partition, plus the rows of
earlier partitions, so no group is ever ordered in one task.

Defined results: a null text has no bytes (size 1, crc32 0); a null id is content
like any other; repeated rows are separate records; records of one id may be in
several shards if their texts differ; ties in a shard's order are between equal
records only; a very long text counts its bytes and stays one record; with fewer
shards than before, the slots of those that go are dealt to the lightest that stay;
an empty table gives an empty result; other columns are ignored by the query and
kept by assigned(), where columns named shard and virtual_slot are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch_root, table

#: Virtual slots; fixed for the life of a data set, and a proven bound of the map's rows.
SLOTS = 4096
SHARDS = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes bigint, slot_rows bigint"
CONTENT = ["doc_id", "text_crc32", "size"]


# ---- the map ----


def hashed_slot(*content: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*content), F.lit(slots)).cast("int")


def slot_stats(records: DataFrame) -> DataFrame:
    """Bytes and rows per slot of records that have virtual_slot and size: at most SLOTS rows."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(stats: list[tuple[int, int, int]], shards: int = SHARDS, slots: int = SLOTS) -> list[tuple]:
    """Version 1: slots by falling bytes (ties by number), each to the lightest shard."""
    loads = [(0, s) for s in range(shards)]
    known = {slot: (size, rows) for slot, size, rows in stats}
    out = []
    for slot in sorted(range(slots), key=lambda k: (-known.get(k, (0, 0))[0], k)):
        size, rows = known.get(slot, (0, 0))
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, shard))
        out.append((1, slot, shard, size, rows))
    return out


def edited_map(old: list[tuple], stats: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """The next version for new statistics or another number of shards, moving few slots.

    Slots of shards that are no more go to the lightest ones, largest first.  Then, again
    and again, the slot nearest to half the gap goes from the heaviest shard to the
    lightest, as long as that narrows the gap; all others stay.
    """
    known = {slot: (size, rows) for slot, size, rows in stats}
    where = {slot: shard for _, slot, shard, _, _ in old}
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in where.items():
        if (size := known.get(slot, (0, 0))[0]) and shard < shards:
            bisect.insort(held[shard], (size, slot))
    loads = [sum(size for size, _ in own) for own in held]
    for slot in sorted((k for k, shard in where.items() if shard >= shards), key=lambda k: (-known.get(k, (0, 0))[0], k)):
        where[slot] = light = loads.index(min(loads))
        if size := known.get(slot, (0, 0))[0]:
            bisect.insort(held[light], (size, slot))
            loads[light] += size
    while True:
        heavy, light = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[heavy] - loads[light]
        at = bisect.bisect_left(held[heavy], (gap / 2, -1))
        near = [held[heavy][k] for k in (at - 1, at) if 0 <= k < len(held[heavy]) and held[heavy][k][0] < gap]
        if not near:
            break
        size, slot = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
        held[heavy].remove((size, slot))
        bisect.insort(held[light], (size, slot))
        loads[heavy] -= size
        loads[light] += size
        where[slot] = light
    version = max(v for v, *_ in old) + 1
    return [(version, slot, shard, *known.get(slot, (0, 0))) for slot, shard in sorted(where.items())]


def last_map(spark: SparkSession, path: str) -> list[tuple]:
    """The rows of the last committed version of the map at the path, or none."""
    try:
        maps = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = maps.agg(F.max("version")).first()[0]
    return [tuple(r) for r in maps.where(F.col("version") == last).orderBy("virtual_slot").collect()] if last else []  # SLOTS rows


def commit(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Writes a version of the map whole and then gives it its name, which fails if another run has taken it: of two runs one commits."""
    folder, written = f"{path}/v{rows[0][0]:06d}", f"{path}/_{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(written)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (written, folder))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).makeQualified(source).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(files.makeQualified(source), files.makeQualified(target), none)
    except Py4JJavaError as e:
        files.delete(files.makeQualified(source), True)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        raise FileExistsError(f"another run has committed {folder}") from e
    return spark.read.schema(MAP_SCHEMA).parquet(folder)


def rebalanced(spark: SparkSession, stats: list[tuple[int, int, int]], path: str, shards: int = SHARDS) -> DataFrame:
    """The map at the path for slots with these bytes and rows: the committed one if it still fits, else the next version."""
    old = last_map(spark, path)
    new = edited_map(old, stats, shards) if old else first_map(stats, shards)
    if old and [r[1:] for r in old] == [r[1:] for r in new]:
        return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{old[0][0]:06d}")
    return commit(spark, new, path)


# ---- records ----


def with_slots(records: DataFrame) -> DataFrame:
    """Rows that have the columns CONTENT with their virtual_slot, a function of content and of the ordinal among equal rows."""
    repeats = saved(records.groupBy(*CONTENT).count().where("count > 1").select(*(F.col(c).alias(f"_{c}") for c in CONTENT)), "repeats")
    if repeats.isEmpty():
        return records.withColumn("virtual_slot", hashed_slot(*CONTENT))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size"))
    once = records.join(repeats, same, "left_anti").withColumn("virtual_slot", hashed_slot(*CONTENT))
    tagged = records.withColumns({"_part": F.spark_partition_id(), "_number": F.monotonically_increasing_id()})
    again = saved(tagged.join(repeats, same, "left_semi"), "repeated")  # parts and numbers must be the same whenever they are read
    before = Window.partitionBy(*CONTENT).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = again.groupBy(*CONTENT, "_part").count().select(*(F.col(c).alias(f"_{c}") for c in CONTENT), F.col("_part").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*CONTENT, "_part").orderBy("_number")
    rows = again.withColumn("_nth", F.row_number().over(own) - 1).join(starts, same & (F.col("_part") == F.col("_of")))
    ordinal = F.col("_start") + F.col("_nth")
    slot = F.when(ordinal == 0, hashed_slot(*CONTENT)).otherwise(hashed_slot(*CONTENT, ordinal))
    return once.unionByName(rows.withColumn("virtual_slot", slot).select(once.columns))


def measured(docs: DataFrame) -> DataFrame:
    """Id, size and checksum of each document."""
    return docs.select(*content())


def content() -> list[Column]:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return [F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")]


def placed(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot); slot is the record's place in its shard, counted from 0 without gaps.

    A place is the rows of the shard's earlier virtual slots plus the place in the
    own one, so that only rows of one virtual slot are ever ordered together.
    """
    records = with_slots(saved(measured(docs), "records"))
    stats = [tuple(r) for r in slot_stats(records).collect()]  # SLOTS rows
    slots = rebalanced(docs.sparkSession, stats, path, shards)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    rows = records.withColumn("nth", F.row_number().over(own)).join(F.broadcast(starts), "virtual_slot")
    return rows.withColumn("slot", F.col("start") + F.col("nth") - 1).drop("start", "nth")


def assigned(docs: DataFrame, path: str) -> DataFrame:
    """The documents with the virtual_slot and shard that the committed map gives them; all columns.

    The slots are those of placed(); only rows that stand there more than once are shuffled.
    """
    rows = last_map(docs.sparkSession, path)
    if not rows:
        raise ValueError(f"no map at {path}")
    kept = [c for c in docs.columns if c not in ("virtual_slot", "shard")]
    slots = docs.sparkSession.createDataFrame([(r[1], r[2]) for r in rows], "virtual_slot int, shard int")
    return with_slots(docs.select(F.struct(*kept).alias("_row"), *content())).join(F.broadcast(slots), "virtual_slot").select("_row.*", "virtual_slot", "shard")


def map_path(spark: SparkSession, dataset: str) -> str:
    """Where the shared folder keeps a data set's maps: its name for readers, and a checksum that tells names apart."""
    dataset = dataset.rstrip("/")
    name = "".join(c if c.isalnum() else "-" for c in dataset.strip("/"))[-80:]
    return f"{scratch_root(spark)}/cinetide/shard-maps/{name}-{hashlib.sha256(dataset.encode()).hexdigest()[:16]}"


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents"), map_path(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
