"""Raw video as a Spark data source, and readers of the small text formats.

format("y4m") reads and writes YUV4MPEG2 files (4:2:0).  The driver plans shares of
files from their sizes alone and opens none; a share's task reads the header and, since
frames have one size, finds its range of frames.  A range of time is an option that
becomes a range of frames, so frames outside of it are never read (with pushed filters
on pts_us and frame_idx as well).  The writer puts each task's frames into a file of
its own and renames all of them on commit, or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cinetide.functions import pixels
from cinetide.schemas import FRAMES

FRAMES_AT_ONCE = 32
SHARE_BYTES = 64 << 20


@dataclass
class Header:
    width: int
    height: int
    rate: tuple[int, int]
    size: int  # bytes of the header

    @property
    def frame_bytes(self) -> int:
        return len(b"FRAME\n") + self.width * self.height + 2 * ((self.width + 1) // 2) * ((self.height + 1) // 2)

    def pts(self, index: int) -> int:
        return index * 1_000_000 * self.rate[1] // self.rate[0]


def header(raw: bytes) -> Header:
    line = raw.split(b"\n", 1)[0]
    fields = {f[:1]: f[1:].decode() for f in line.split(b" ")[1:] if f}
    if not line.startswith(b"YUV4MPEG2") or not fields.get(b"C", "420").startswith("420"):
        raise ValueError("not a 4:2:0 YUV4MPEG2 file")
    top, _, bottom = fields.get(b"F", "30:1").partition(":")
    rate = (int(top) or 30, int(bottom or 1) or 1)
    return Header(int(fields[b"W"]), int(fields[b"H"]), rate, len(line) + 1)


class FileShare(InputPartition):
    """Part number `share` of `of` parts of a file's frames."""

    def __init__(self, path: str, size: int, share: int, of: int):
        self.path, self.size, self.share, self.of = path, size, share, of


class Y4M(DataSource):
    """Options: path (a file or directory), startUs, endUs, bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return Y4MReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return Y4MWriter(self.options)


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    fs, root = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
    return fs, sorted((f for f in found if f.path.endswith(".y4m")), key=lambda f: f.path)


class Y4MReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start = int(options.get("startUs", 0))
        self.end = int(options["endUs"]) if options.get("endUs") else None
        self.bytes = int(options.get("bytesPerPartition", SHARE_BYTES))
        self.bounds = {"frame_idx": [0, None], "pts_us": [0, None]}

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                low, high = self.bounds[column]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    high = top if high is None else min(high, top)
                self.bounds[column] = [low, high]
            yield f  # Spark still applies it to what is read

    def partitions(self) -> list[FileShare]:
        _, files = _files(self.path)
        parts = [(info, max(1, -(-info.size // self.bytes))) for info in files]
        return [FileShare(info.path, info.size, k, of) for info, of in parts for k in range(of)] or [FileShare("", 0, 0, 1)]

    def bounded(self, head: Header, total: int) -> tuple[int, int, int]:
        """The first frame of the range of time, and which frames are asked for."""
        per_second = head.rate[0] / head.rate[1]
        first = next(i for i in range(max(0, int(self.start * per_second / 1e6) - 1), total + 2) if head.pts(i) >= self.start or i > total)
        last = total if self.end is None else min(total, int(self.end * per_second / 1e6) + 1)
        while last > first and self.end is not None and head.pts(last - 1) > self.end:
            last -= 1
        idx, pts = self.bounds["frame_idx"], self.bounds["pts_us"]
        low = max(first, first + idx[0], first + int(pts[0] * per_second / 1e6) - 1)
        high = last if idx[1] is None else min(last, first + idx[1] + 1)
        high = high if pts[1] is None else min(high, first + int(pts[1] * per_second / 1e6) + 2)
        return first, low, max(low, high)

    def read(self, partition: FileShare) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        video = partition.path.rsplit("/", 1)[-1].removesuffix(".y4m")
        with fs.open_input_file(partition.path) as source:
            head = header(source.read_at(min(256, partition.size), 0))
            skipped, low, high = self.bounded(head, (partition.size - head.size) // head.frame_bytes)  # frames before the range of time
            begin, end = (low + (high - low) * k // partition.of for k in (partition.share, partition.share + 1))
            for a in range(begin, end, FRAMES_AT_ONCE):
                b = min(a + FRAMES_AT_ONCE, end)
                raw = source.read_at((b - a) * head.frame_bytes, head.size + a * head.frame_bytes)
                parts = [raw[k * head.frame_bytes + 6 : (k + 1) * head.frame_bytes] for k in range(b - a)]
                px = [pixels.i420_to_rgb(p, head.width, head.height).tobytes() for p in parts]
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([video] * n), pa.array(range(a - skipped, b - skipped), pa.int64()),
                        pa.array([head.pts(i) - head.pts(skipped) for i in range(a, b)], pa.int64()), pa.array([head.width] * n, pa.int32()),
                        pa.array([head.height] * n, pa.int32()), pa.array(px, pa.binary()),
                    ],
                    ["video_id", "frame_idx", "pts_us", "width", "height", "px"],
                )


@dataclass
class Written(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class Y4MWriter(DataSourceWriter):
    """Frames sorted by video and index, one file per video; a video's rows must be in one partition."""

    def __init__(self, options):
        self.path, self.fps = options["path"], options.get("fps", "30:1")

    def write(self, iterator) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        pairs, sink, video = [], None, None
        for row in iterator:
            if row.video_id != video:
                if sink is not None:
                    sink.close()
                video, temporary = row.video_id, f"{root}/_{uuid.uuid4().hex}.part"
                pairs.append((temporary, f"{root}/{video}.y4m"))
                sink = fs.open_output_stream(temporary)
                sink.write(f"YUV4MPEG2 W{row.width} H{row.height} F{self.fps} Ip A1:1 C420\n".encode())
            sink.write(b"FRAME\n" + pixels.rgb_to_i420(pixels.frame(bytes(row.px), row.width, row.height)))
        if sink is not None:
            sink.close()
        return Written(pairs)

    def commit(self, messages) -> None:
        moved_or_none(self.path, messages)

    def abort(self, messages) -> None:
        parts_removed(self.path, messages)


def moved_or_none(path: str, messages) -> None:
    """All files of a job get their names, or none; what is there already is not replaced."""
    fs, _ = pafs.FileSystem.from_uri(path)
    pairs = [pair for message in messages if message for pair in message.pairs]
    taken = [f.path for f in fs.get_file_info([final for _, final in pairs]) if f.type != pafs.FileType.NotFound] if pairs else []
    if taken or len({final for _, final in pairs}) < len(pairs):
        parts_removed(path, messages)
        raise FileExistsError(f"{len(taken)} of the videos are there already, or one comes twice")
    moved: list[tuple[str, str]] = []
    try:
        for temporary, final in pairs:
            fs.move(temporary, final)
            moved.append((temporary, final))
    except OSError:
        for temporary, final in moved:
            fs.move(final, temporary)
        raise


def parts_removed(path: str, messages) -> None:
    fs, _ = pafs.FileSystem.from_uri(path)
    for message in messages:
        for temporary, _ in message.pairs if message else ():
            fs.delete_file(temporary)


def read_video(spark: SparkSession, path: str, **options) -> DataFrame:
    """A1, A2: frames of raw video; startUs and endUs bound the time, which then counts from the start."""
    spark.dataSource.register(Y4M)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("y4m").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def write_video(frames: DataFrame, path: str, fps: str = "30:1") -> None:
    frames.sparkSession.dataSource.register(Y4M)
    dealt = frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    dealt.write.format("y4m").mode("append").options(path=path, fps=fps).save()


def rgb_of(data: bytes, channels: int) -> np.ndarray:
    """Samples of 1 (grey), 3 (BGR) or 4 (BGRA) channels as RGB."""
    x = np.frombuffer(data, np.uint8).reshape(-1, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=1)
    if channels not in (3, 4):
        raise ValueError(f"images of {channels} channels can't be read")
    return x[:, 2::-1]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A2: a directory of images as frames, in order of their names.

    The built-in source gives rows of 8-bit samples as BGR, BGRA or grey: grey is repeated, alpha is left
    out, and what has another number of channels fails.  A file that is no image has no row, as in the
    source itself.  Only names go through the window; pixels meet their numbers by a join.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    parts = F.split("origin", "/")
    names = images.select("origin", F.element_at(parts, -2).alias("video_id"), F.element_at(parts, -1).alias("name"))
    numbers = names.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("video_id").orderBy("name")) - 1).cast("long")).drop("name")

    def swapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = [rgb_of(d, n).tobytes() for d, n in zip(batch.column("data").to_pylist(), batch.column("nChannels").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("origin", "width", "height")] + [pa.array(px, pa.binary())], ["origin", "width", "height", "px"])

    rows = images.select("origin", "width", "height", "nChannels", "data").mapInArrow(swapped, "origin string, width int, height int, px binary")
    return rows.join(numbers, "origin").select("video_id", "frame_idx", F.lit(0).cast("long").alias("pts_us"), "width", "height", "px")


def probed(raw: DataFrame) -> DataFrame:
    """A3: fallbacks for rate and number of frames over columns track_fps, capture_fps, frames, duration_ms."""
    by_count = F.try_divide(F.col("frames") * F.lit(1000.0), F.col("duration_ms"))
    fps = F.coalesce(F.when(F.col("track_fps") > 1, F.col("track_fps")), F.when(F.col("capture_fps") > 1, F.col("capture_fps")), F.when(by_count > 1, by_count), F.lit(30.0))
    fps = F.when(fps > 120, 30.0).otherwise(fps).cast("double")
    count = F.when(F.col("frames") > 0, F.col("frames")).otherwise(F.floor(F.col("duration_ms") / 1000.0 * fps))
    return raw.withColumns({"fps": fps, "frame_count": count.cast("long")})


def display_name(name: Column, uri: Column) -> Column:
    """The provider's name, else the last part of the address, else "video"."""
    last = F.nullif(F.element_at(F.split(uri, "/"), -1), F.lit(""))
    return F.coalesce(F.nullif(name, F.lit("")), last, F.lit("video"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files as request bodies."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("content").alias("body"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of server-sent events, split on blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "line")


EVENT = "stage string, progress double, log string, rank int, eta double, url string, error string"
STAGES = ("queued", "processing", "retrying", "done", "error")


def parsed_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """The data line of each block as an event; unknown stages and bad JSON fall out."""
    data = F.regexp_extract(F.col(line), r"(?m)^data: (.*)$", 1)
    rows = lines.where(F.col(line).rlike(r"(?m)^data: ")).withColumn("event", F.from_json(data, EVENT))
    return rows.where(F.col("event.stage").isin(*STAGES)).select(*(c for c in lines.columns if c != line), "event.*")


def parsed_health(probes: DataFrame, body: str = "body") -> DataFrame:
    """Ok, gpu and primary of a health answer; without one ok is false."""
    value = F.from_json(F.col(body), "ok boolean, gpu string, primary string")
    rest = [c for c in probes.columns if c != body]
    return probes.select(*rest, F.coalesce(value["ok"], F.lit(False)).alias("ok"), value["gpu"].alias("gpu"), value["primary"].alias("primary"))
