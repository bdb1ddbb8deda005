"""The session's settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def session(name: str = "cinetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC times and small Arrow batches, as frames are large."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cinetide-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/') if '://' in root else 'file://' + root.rstrip('/')}/cinetide/{name}-{uuid.uuid4().hex}"


def removed(folder: str) -> None:
    """Removes a shared folder, if it is there, with all that it holds."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries within it have shuffled is removed as each ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
