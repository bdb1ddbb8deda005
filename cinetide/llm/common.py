"""What the operators share: the input table, the shared scratch folder, label folds."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups whose training samples are fetched by one scan.
GROUPS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class _Made(threading.local):
    """The scratch paths that this thread made and has not removed."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="cinetide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is removed."""
    path = f"{scratch_root(spark)}/cinetide/{name}-{uuid.uuid4().hex}"
    if not _made.paths:
        atexit.register(removed, spark, _made.paths)
    _made.paths.append(path)
    return path


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes scratch folders, as far as the session still lives."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for path in list(paths):
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made.paths:
            _made.paths.remove(path)


def made() -> int:
    """A mark for discarded()."""
    return len(_made.paths)


def discarded(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Removes the tables that this thread saved since the mark, but for those that are still read."""
    stay = {getattr(df, "_scratch", None) for df in kept}
    removed(spark, [p for p in _made.paths[since:] if p not in stay])


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3: rows that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_ids(rows: DataFrame, by: str, most: int | dict) -> list[tuple]:
    """(value, doc_id) of at most `most` ids of each value of a column: those with the smallest hash.

    Ids are counted, about twice as many as wanted are fetched by a bound on the
    hash, by one scan for each `GROUPS` values, and the driver takes the smallest;
    so what it receives is bounded by `most` and the number of values, however
    often an id is repeated.
    """
    limit = most if isinstance(most, dict) else None
    span = 1 << 40
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    found, wanted = [], {}
    groups = rows.groupBy(by).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), by).collect()
    for at in range(0, len(groups), GROUPS):
        chosen = F.lit(False)
        for value, n in groups[at : at + GROUPS]:
            wanted[value] = limit.get(value, 0) if limit is not None else most
            share = min(1.0, (2 * wanted[value] + 50) / n)
            chosen = chosen | ((F.col(by) == value) & (hashed < int(share * span)))
        found += rows.where(chosen).select(by, "doc_id", hashed.alias("_hash")).distinct().collect()
    out, taken = [], dict.fromkeys(wanted, 0)
    for value, doc_id, _ in sorted(found, key=lambda r: (r[2], r[1], str(r[0]))):
        if taken[value] < wanted[value]:
            taken[value] += 1
            out.append((value, doc_id))
    return out


def texts_of(docs: DataFrame, ids: list, most_bytes: int) -> list[tuple]:
    """(doc_id, text) of the ids, in order, as long as the texts have `most_bytes` together.

    Of an id's texts the one with the smallest hash is taken.  Their sizes are
    fetched first, so the driver never receives more than it asked for.
    """
    if not ids:
        return []
    own = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    sizes = own.groupBy("doc_id").agg(F.min(F.struct("_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("least")).collect()
    least = {doc_id: (key, size) for doc_id, (key, size) in sizes}
    keys, total = [], 0
    for doc_id in ids:
        if doc_id in least and total + least[doc_id][1] <= most_bytes:
            total += least[doc_id][1]
            keys.append(least[doc_id][0])
    rows = own.where(F.col("_hash").isin(keys)).groupBy("doc_id").agg(F.min_by("text", "_hash").alias("text")).collect() if keys else []
    texts = {doc_id: text or "" for doc_id, text in rows}
    return [(doc_id, texts[doc_id]) for doc_id in ids if doc_id in texts]
