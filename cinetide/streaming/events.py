"""Server-sent events as a stream (A11) and as a sink.

format("sse") follows a folder of growing logs.  An offset is the size of each log; a block
belongs to the range of bytes that holds its closing blank line, and a task looks back for its beginning, so a
block that was cut by a batch is given once, whole, by the next one.  The driver reads sizes only.
A folder with commits, as the sink writes it, is followed by the number of its last batch instead.

The sink writes a file per task under a name of its own; a batch counts once its manifest
has its name, which is given last and once, so a repeated batch adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from cinetide.sources.video import EVENT, STAGES

BLOCKS = "source string, position bigint, event string, id string, data string"
SHARE_BYTES = 16 << 20
LOOK_BACK = 64 << 10
COMMITS = "_commits"


class Share(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Events(DataSource):
    """Options: path; bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return BLOCKS

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return EventReader(self.options)

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802
        return EventWriter(self.options)


def listed(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    return sorted((f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File), key=lambda f: f.path)


def block(raw: bytes) -> tuple[str | None, str | None, str] | None:
    """event, id and data of a block of lines; lines of data are joined, comments and unknown fields left out; None without data."""
    fields: dict[str, list[str]] = {}
    for line in raw.decode("utf-8", "replace").split("\n"):
        name, _, value = line.partition(":")
        if name:
            fields.setdefault(name, []).append(value.removeprefix(" "))
    if "data" not in fields:
        return None
    last = lambda name: fields[name][-1] if name in fields else None
    return last("event"), last("id"), "\n".join(fields["data"])


def blocks_of(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place behind the closing blank line, text) of the blocks that close within (start, end]."""
    back = start
    head = b""
    while back > 0:  # the blank line before the first block
        back = max(0, back - LOOK_BACK)
        head = source.read_at(start - back, back)
        if b"\n\n" in head:
            break
    at = back + head.rfind(b"\n\n") + 2 if b"\n\n" in head else 0
    rest = head[at - back :]
    at_byte = start
    while at_byte < end:
        more = source.read_at(min(SHARE_BYTES, end - at_byte), at_byte)
        at_byte += len(more)
        rest += more
        if not more:
            break
        *whole, rest = rest.split(b"\n\n")
        for raw in whole:
            at += len(raw) + 2
            if at > start:
                yield at, raw.strip(b"\n")


class EventReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.share = options["path"], int(options.get("bytesPerPartition", SHARE_BYTES))

    def _root(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": -1, "logs": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = self._root()
        commits = listed(fs, f"{root}/{COMMITS}")
        if commits:
            return {"batch": max(int(f.path.rsplit("/", 1)[-1]) for f in commits if f.path.rsplit("/", 1)[-1].isdigit()), "logs": "{}"}
        return {"batch": -1, "logs": json.dumps({f.path.rsplit("/", 1)[-1]: f.size for f in listed(fs, root) if not f.path.rsplit("/", 1)[-1].startswith(("_", "."))})}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        fs, root = self._root()
        ranges: list[tuple[str, int, int]] = []
        for number in range(int(start["batch"]) + 1, int(end["batch"]) + 1):
            name = f"{root}/{COMMITS}/{number:010d}"
            if fs.get_file_info(name).type == pafs.FileType.File:
                with fs.open_input_stream(name) as manifest:
                    ranges += [(f"{root}/{n}", 0, size) for n, size in json.loads(manifest.read())]
        before = json.loads(start["logs"])
        ranges += [(f"{root}/{n}", before.get(n, 0), size) for n, size in json.loads(end["logs"]).items() if size > before.get(n, 0)]
        return [Share(path, a, min(a + self.share, b)) for path, low, b in ranges for a in range(low, b, self.share)]

    def read(self, partition: Share) -> Iterator[tuple]:
        fs, _ = self._root()
        with fs.open_input_file(partition.path) as source:
            for position, raw in blocks_of(source, partition.start, partition.end):
                found = block(raw)
                if found:
                    yield (partition.path.rsplit("/", 1)[-1], position, *found)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    size: int


class EventWriter(DataSourceStreamWriter):
    """Rows with a column data, and event and id if they are there."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> Part:
        fs, root = pafs.FileSystem.from_uri(self.path)
        name, size, sink = f"part-{uuid.uuid4().hex}.sse", 0, None
        for row in iterator:
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}")
            fields = row.asDict()
            lines = [f"{k}: {fields[k]}" for k in ("event", "id") if fields.get(k) is not None] + [f"data: {line}" for line in (fields["data"] or "").split("\n")]
            raw = ("\n".join(lines) + "\n\n").encode()
            sink.write(raw)
            size += len(raw)
        if sink is not None:
            sink.close()
        return Part(name if sink is not None else None, size)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        fs, root = pafs.FileSystem.from_uri(self.path)
        parts = [(m.name, m.size) for m in messages if m and m.name]
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        final = f"{root}/{COMMITS}/{batchId:010d}"
        if fs.get_file_info(final).type != pafs.FileType.NotFound:  # the batch was committed before a restart
            self._removed(fs, root, parts)
            return
        with fs.open_output_stream(f"{root}/_{batchId}.part") as manifest:
            manifest.write(json.dumps(parts).encode())
        fs.move(f"{root}/_{batchId}.part", final)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        fs, root = pafs.FileSystem.from_uri(self.path)
        self._removed(fs, root, [(m.name, m.size) for m in messages if m and m.name])

    @staticmethod
    def _removed(fs: pafs.FileSystem, root: str, parts: list[tuple[str, int]]) -> None:
        for name, _ in parts:
            fs.delete_file(f"{root}/{name}")


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """The blocks of a folder's logs as they grow."""
    spark.dataSource.register(Events)
    return spark.readStream.format("sse").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def progress(blocks: DataFrame, data: Column | str = "data") -> DataFrame:
    """Blocks as progress events; unknown stages and bad JSON fall out."""
    rows = blocks.withColumn("_event", F.from_json(data, EVENT)).where(F.col("_event.stage").isin(*STAGES))
    return rows.select(*(c for c in ("source", "position", "id") if c in blocks.columns), "_event.*")


def publish(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Rows (data, and event and id if they are there) as blocks of a folder, each batch once; the running query."""
    stream.sparkSession.dataSource.register(Events)
    return stream.writeStream.format("sse").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
