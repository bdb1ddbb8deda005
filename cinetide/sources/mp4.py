"""Packets and tracks of MP4 files (ISO base media, ISO/IEC 14496-12) as Spark data sources.

format("mp4") gives a row per sample: its times, whether it is a key frame, its
place in the file and its bytes.  The driver plans shares of files from their sizes
and opens none; a share's task reads the sample tables, keeps the samples that pushed
filters on pts_us, track and is_key leave, and reads their bytes only, neighbours at
once.  Fragmented files (moof) are read as well.  format("mp4tracks") gives a row
per track from the tables alone.

The writer takes packets and tracks in one shuffle by video (track rows sort before
their packets, so payloads meet no join), writes payloads as they come in boxes of
`MDAT_BYTES`, holds sample tables only, and renames all files on commit, or none.
Times are kept in microseconds, so what is written is read again exactly.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cinetide.sources.video import Written, moved_or_none, parts_removed, probed

SHARE_BYTES = 64 << 20
#: Bytes that are read at once, and bytes between two samples that are read along with them.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
ROWS_AT_ONCE = 1024
#: Payload that a writer holds before it goes to the file, in one box.
MDAT_BYTES = 8 << 20
MICRO = 1_000_000
KINDS = {b"vide": "video", b"soun": "audio"}
PACKETS = "video_id string, track string, pts_us bigint, dts_us bigint, is_key boolean, position bigint, size bigint, data binary"
TRACKS = (
    "video_id string, track string, number int, width int, height int, rotation int, channels int, sample_rate int, "
    "samples bigint, duration_us bigint, start_us bigint, format binary"
)


# ---- boxes ----


def boxes(raw: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of the body, end) of the boxes in a range of bytes."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", raw, body)[0], start + 16
        stop = end if size == 0 else start + size
        if size and stop < body or stop > end:
            raise ValueError(f"a box {kind!r} of {size} bytes at {start} does not fit")
        yield kind, body, stop
        start = stop


def child(raw: bytes, within: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    """Body of the first box on a path of types."""
    for kind in path:
        within = next(((b, e) for k, b, e in boxes(raw, *within) if k == kind), None)
        if within is None:
            return None
    return within


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def entries(raw: bytes, at: tuple[int, int] | None, kind: str = ">u4", width: int = 1) -> np.ndarray:
    """The entries of a counted table: count, then rows of `width` numbers."""
    if at is None:
        return np.empty((0, width), np.int64)
    count = struct.unpack_from(">I", raw, at[0] + 4)[0]
    return np.frombuffer(raw, kind, count * width, at[0] + 8).reshape(count, width).astype(np.int64)


# ---- tables of a file ----


@dataclass
class Track:
    """A track's description and samples; times are in microseconds."""

    number: int
    name: str
    width: int = 0
    height: int = 0
    rotation: int = 0
    channels: int = 0
    rate: int = 0
    format: bytes = b""
    scale: int = MICRO
    shift: int = 0  # of times, in units of 1 / scale seconds
    ticks: int = 0  # duration of the media
    parts: list[tuple[np.ndarray, ...]] = field(default_factory=list)  # dts, cts offset, size, place, key, duration

    def samples(self) -> tuple[np.ndarray, ...]:
        """pts_us, dts_us, size, place and key of all samples."""
        if not self.parts:
            return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool))
        dts, offset, size, place, key, _ = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        micro = lambda t: (t + self.shift) * MICRO // self.scale
        return micro(dts + offset), micro(dts), size, place, key

    def duration_us(self) -> int:
        spans = [int(p[0][-1] + p[5][-1]) for p in self.parts if len(p[0])]
        return max([self.ticks, *spans]) * MICRO // self.scale


def _rotation(raw: bytes, at: int) -> int:
    a, b = struct.unpack_from(">ii", raw, at)
    return {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get(((a > 0) - (a < 0), (b > 0) - (b < 0)), 0)


def _track(raw: bytes, trak: tuple[int, int], movie_scale: int) -> Track | None:
    """A trak box as a track, if it is video or audio and complete."""
    tkhd, mdhd = child(raw, trak, b"tkhd"), child(raw, trak, b"mdia", b"mdhd")
    hdlr, stbl = child(raw, trak, b"mdia", b"hdlr"), child(raw, trak, b"mdia", b"minf", b"stbl")
    if None in (tkhd, mdhd, hdlr, stbl):
        return None
    kind = KINDS.get(raw[hdlr[0] + 8 : hdlr[0] + 12])
    stsd = child(raw, stbl, b"stsd")
    entry = next(boxes(raw, stsd[0] + 8, stsd[1]), None) if stsd else None
    if kind is None or entry is None:
        return None
    wide = raw[tkhd[0]] == 1
    number = struct.unpack_from(">I", raw, tkhd[0] + (20 if wide else 12))[0]
    out = Track(number, f"{kind}/{entry[0].decode('latin-1').strip()}")
    out.rotation = _rotation(raw, tkhd[0] + (52 if wide else 40))
    out.scale = struct.unpack_from(">I", raw, mdhd[0] + (20 if raw[mdhd[0]] == 1 else 12))[0] or MICRO
    out.ticks = struct.unpack_from(">Q", raw, mdhd[0] + 24)[0] if raw[mdhd[0]] == 1 else struct.unpack_from(">I", raw, mdhd[0] + 16)[0]
    out.format = raw[entry[1] - 8 : entry[2]]
    if kind == "video":
        out.width, out.height = struct.unpack_from(">HH", raw, entry[1] + 24)
    else:
        out.channels, out.rate = struct.unpack_from(">H", raw, entry[1] + 16)[0], struct.unpack_from(">I", raw, entry[1] + 24)[0] >> 16
    out.shift = _shift(raw, child(raw, trak, b"edts", b"elst"), out.scale, movie_scale)
    out.parts.append(_samples(raw, stbl))
    return out


def _shift(raw: bytes, elst: tuple[int, int] | None, scale: int, movie_scale: int) -> int:
    """What an edit list adds to times: leading gaps, less the media time of the first edit."""
    if elst is None:
        return 0
    wide = raw[elst[0]] == 1
    gap = 0
    for k in range(struct.unpack_from(">I", raw, elst[0] + 4)[0]):
        length, media = struct.unpack_from(">Qq" if wide else ">Ii", raw, elst[0] + 8 + k * (20 if wide else 12))
        if media >= 0:
            return gap * scale // movie_scale - media
        gap += length
    return 0


def _samples(raw: bytes, stbl: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Samples of the tables of a trak box."""
    at = {k: (b, e) for k, b, e in boxes(raw, *stbl)}
    if b"stsz" in at:
        fixed, count = struct.unpack_from(">II", raw, at[b"stsz"][0] + 4)
        size = np.full(count, fixed, np.int64) if fixed else np.frombuffer(raw, ">u4", count, at[b"stsz"][0] + 12).astype(np.int64)
    else:
        size = np.empty(0, np.int64)
    n = len(size)
    stts, ctts = entries(raw, at.get(b"stts"), width=2), at.get(b"ctts")
    duration = np.repeat(stts[:, 1], stts[:, 0])[:n]
    duration = np.r_[duration, np.zeros(n - len(duration), np.int64)]
    dts = np.r_[0, np.cumsum(duration)[:-1]] if n else duration
    shifts = entries(raw, ctts, ">i4" if ctts and raw[ctts[0]] == 1 else ">u4", 2)
    offset = np.repeat(shifts[:, 1], shifts[:, 0])[:n]
    offset = np.r_[offset, np.zeros(n - len(offset), np.int64)]
    key = np.ones(n, bool)
    if b"stss" in at:
        key[:] = False
        numbers = entries(raw, at[b"stss"])[:, 0] - 1
        key[numbers[numbers < n]] = True
    chunks = entries(raw, at[b"co64"], ">u8")[:, 0] if b"co64" in at else entries(raw, at.get(b"stco"))[:, 0]
    return dts, offset, size, _places(size, chunks, entries(raw, at.get(b"stsc"), width=3)), key, duration


def _places(size: np.ndarray, chunks: np.ndarray, stsc: np.ndarray) -> np.ndarray:
    """Place of each sample: its chunk's, and the sizes of those before it in the chunk."""
    if not len(size) or not len(chunks):
        return np.zeros(len(size), np.int64)
    runs = np.diff(np.r_[stsc[:, 0] - 1, len(chunks)])
    chunk = np.repeat(np.arange(len(chunks)), np.repeat(stsc[:, 1], runs))[: len(size)]
    if len(chunk) < len(size):
        raise ValueError("the chunks hold fewer samples than there are sizes")
    before = np.r_[0, np.cumsum(size)[:-1]]
    head = np.r_[True, chunk[1:] != chunk[:-1]]
    return chunks[chunk] + before - before[head][np.cumsum(head) - 1]


def _fragment(raw: bytes, moof: tuple[int, int], begin: int, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Adds the samples of a moof box, which begins at `begin` in the file."""
    for kind, body, end in boxes(raw, *moof):
        if kind != b"traf":
            continue
        tfhd = child(raw, (body, end), b"tfhd")[0]
        flags, number = struct.unpack_from(">II", raw, tfhd)
        if number not in tracks:
            continue
        at, base = tfhd + 8, begin
        values = list(defaults.get(number, (0, 0, 0)))  # duration, size, flags
        if flags & 1:
            base, at = struct.unpack_from(">Q", raw, at)[0], at + 8
        at += 4 * bool(flags & 2)
        for k in range(3):
            if flags & (8 << k):
                values[k], at = struct.unpack_from(">I", raw, at)[0], at + 4
        track = tracks[number]
        tfdt = child(raw, (body, end), b"tfdt")
        if tfdt:
            time = struct.unpack_from(">Q" if raw[tfdt[0]] == 1 else ">I", raw, tfdt[0] + 4)[0]
        else:
            time = max((int(p[0][-1] + p[5][-1]) for p in track.parts if len(p[0])), default=0)
        place = base
        for run, at, _ in boxes(raw, body, end):
            if run != b"trun":
                continue
            version, flags, count = raw[at], struct.unpack_from(">I", raw, at)[0] & 0xFFFFFF, struct.unpack_from(">I", raw, at + 4)[0]
            at += 8
            if flags & 1:
                place, at = base + struct.unpack_from(">i", raw, at)[0], at + 4
            first = None
            if flags & 4:
                first, at = struct.unpack_from(">I", raw, at)[0], at + 4
            present = [k for k in range(4) if flags & (0x100 << k)]
            rows = np.frombuffer(raw, ">u4", count * len(present), at).reshape(count, len(present)).astype(np.int64)
            column = {k: rows[:, c] for c, k in enumerate(present)}
            duration, size, marks = (column.get(k, np.full(count, values[k], np.int64)) for k in range(3))
            if first is not None and count:
                marks = np.r_[first, marks[1:]]
            offset = column.get(3, np.zeros(count, np.int64))
            offset = offset.astype(np.uint32).astype(np.int32).astype(np.int64) if version else offset
            steps, sizes = np.r_[0, np.cumsum(duration)], np.r_[0, np.cumsum(size)]
            track.parts.append((time + steps[:-1], offset, size, place + sizes[:-1], (marks & 0x10000) == 0, duration))
            time, place = time + int(steps[-1]), place + int(sizes[-1])


def tables(source, size: int) -> list[Track]:
    """The tracks of an open file; only its tables are read, payload is skipped."""
    tracks: dict[int, Track] = {}
    defaults: dict[int, tuple] = {}
    at = 0
    while at + 8 <= size:
        head = source.read_at(min(16, size - at), at)
        length, kind = struct.unpack_from(">I4s", head)
        begin = at + (16 if length == 1 else 8)
        length = struct.unpack_from(">Q", head, 8)[0] if length == 1 else length or size - at
        if length < begin - at or at + length > size:
            raise ValueError(f"a box {kind!r} of {length} bytes at {at} does not fit")
        if kind in (b"moov", b"moof"):
            raw = source.read_at(at + length - begin, begin)
            if kind == b"moof":
                _fragment(raw, (0, len(raw)), at, tracks, defaults)
            else:
                mvhd = child(raw, (0, len(raw)), b"mvhd")
                scale = struct.unpack_from(">I", raw, mvhd[0] + (20 if raw[mvhd[0]] == 1 else 12))[0] if mvhd else MICRO
                found = [_track(raw, (b, e), scale or MICRO) for k, b, e in boxes(raw) if k == b"trak"]
                tracks = {t.number: t for t in found if t}
                mvex = child(raw, (0, len(raw)), b"mvex")
                for k, b, _ in boxes(raw, *mvex) if mvex else ():
                    if k == b"trex":
                        number, _, *values = struct.unpack_from(">IIIII", raw, b + 4)
                        defaults[number] = tuple(values)
        at += length
    seen: dict[str, int] = {}
    for track in tracks.values():  # a second track of the same name gets a number
        seen[track.name] = seen.get(track.name, 0) + 1
        track.name += f":{seen[track.name]}" if seen[track.name] > 1 else ""
    return list(tracks.values())


# ---- reading ----


class Shares(InputPartition):
    """Parts (path, size, share, of) of files."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


def planned(files: list[pafs.FileInfo], most: int) -> list[Shares]:
    """Large files in several shares, small ones together, by their sizes alone."""
    out, small, held = [], [], 0
    for info in files:
        of = -(-info.size // most)
        if of > 1:
            out += [Shares([(info.path, info.size, k, of)]) for k in range(of)]
            continue
        if small and held + info.size > most:
            out.append(Shares(small))
            small, held = [], 0
        small.append((info.path, info.size, 0, 1))
        held += info.size
    return out + ([Shares(small)] if small or not out else [])


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    fs, root = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith((".mp4", ".m4a", ".mov"))), key=lambda f: f.path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class Mp4(DataSource):
    """Options: path (a file or directory), bytesPerPartition, payload (false: places only)."""

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return Mp4Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return Mp4Writer(self.options)


class Mp4Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("bytesPerPartition", SHARE_BYTES))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.low, self.high, self.track, self.key = None, None, None, None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column == "pts_us" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            elif column == "track" and isinstance(f, EqualTo):
                self.track = f.value
            elif column == "is_key" and isinstance(f, EqualTo):
                self.key = f.value
            yield f  # Spark still applies it to what is read

    def partitions(self) -> list[Shares]:
        return planned(_files(self.path)[1], self.bytes)

    def chosen(self, tracks: list[Track], share: int, of: int) -> tuple[np.ndarray, ...]:
        """Of the share's samples that filters leave, in order of place: track, pts_us, dts_us, size, place, key."""
        cols = [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)]
        for k, track in enumerate(tracks):
            pts, dts, size, place, key = track.samples()
            on = np.ones(len(pts), bool) if self.track in (None, track.name) else np.zeros(len(pts), bool)
            on &= (pts >= (self.low if self.low is not None else -(1 << 62))) & (pts <= (self.high if self.high is not None else 1 << 62))
            on &= key == self.key if self.key is not None else True
            own = (np.full(int(on.sum()), k), pts[on], dts[on], size[on], place[on], key[on])
            cols = [np.r_[a, b] for a, b in zip(cols, own, strict=True)]
        order = np.lexsort((cols[0], cols[4]))
        a, b = len(order) * share // of, len(order) * (share + 1) // of
        return tuple(c[order[a:b]] for c in cols)

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path, size, share, of in partition.parts:
            with fs.open_input_file(path) as source:
                tracks = tables(source, size)
                yield from self.rows(source, path, tracks, self.chosen(tracks, share, of))

    def rows(self, source, path: str, tracks: list[Track], chosen: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        number, pts, dts, size, place, key = chosen
        at, n = 0, len(pts)
        names, ends = pa.array([t.name for t in tracks], pa.string()), place + size
        reach = np.maximum.accumulate(ends)
        gaps = np.r_[np.flatnonzero(place[1:] > ends[:-1] + GAP_BYTES) + 1, n]
        while at < n:
            to = min(at + ROWS_AT_ONCE, n)
            if self.payload:
                to = min(to, int(gaps[np.searchsorted(gaps, at, "right")]), max(at + 1, int(np.searchsorted(reach, place[at] + READ_BYTES, "right"))))
                begin, end = int(place[at]), int(ends[at:to].max())
                raw = source.read_at(end - begin, begin)
                if len(raw) < end - begin:
                    raise ValueError(f"{path} ends before its samples do")
                data = _cut(raw, place[at:to] - begin, size[at:to])
            else:
                data = pa.nulls(to - at, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_name(path)] * (to - at)), names.take(pa.array(number[at:to])), pa.array(pts[at:to]), pa.array(dts[at:to]),
                    pa.array(key[at:to]), pa.array(place[at:to]), pa.array(size[at:to]), data,
                ],
                [c.split()[0] for c in PACKETS.split(", ")],
            )
            at = to


def _cut(raw: bytes, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parts of what was read; parts without gaps between them are views of it."""
    if len(raw) < 1 << 31 and (start[1:] == start[:-1] + size[:-1]).all():
        limits = np.r_[start, start[-1:] + size[-1:]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(limits), pa.py_buffer(raw)])
    return pa.array([raw[p : p + s] for p, s in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())


class Mp4Tracks(DataSource):
    """Options: path, bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "mp4tracks"

    def schema(self) -> str:
        return TRACKS

    def reader(self, schema) -> DataSourceReader:
        return TrackReader(self.options)


class TrackReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("bytesPerPartition", SHARE_BYTES))

    def partitions(self) -> list[Shares]:
        whole = [Shares([part for part in p.parts if part[2] == 0]) for p in planned(_files(self.path)[1], self.bytes)]
        return [p for p in whole if p.parts] or [Shares([])]

    def read(self, partition: Shares) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path, size, _, _ in partition.parts:
            with fs.open_input_file(path) as source:
                for t in tables(source, size):
                    pts = t.samples()[0]
                    yield _name(path), t.name, t.number, t.width, t.height, t.rotation, t.channels, t.rate, len(pts), t.duration_us(), int(pts.min()) if len(pts) else 0, t.format


def read_packets(spark: SparkSession, path: str, **options) -> DataFrame:
    """The samples of MP4 files; filters on pts_us, track and is_key are pushed down."""
    spark.dataSource.register(Mp4)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("mp4").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Mp4Tracks)
    return spark.read.format("mp4tracks").options(path=path).load()


def probed_files(tracks: DataFrame) -> DataFrame:
    """A3: a row of VIDEOS for each file that has a video track, from its tracks."""
    is_video = F.col("track").startswith("video/")
    first = F.min_by(F.struct("width", "height", "rotation", "samples", "duration_us", "track"), F.when(is_video, F.col("number")))
    rows = tracks.groupBy("video_id").agg(first.alias("v"), F.max("duration_us").alias("us"), F.bool_or(~is_video).alias("has_audio"), F.bool_or(is_video).alias("has_video"))
    rate = F.try_divide(F.col("v.samples") * F.lit(1e6), F.col("v.duration_us"))
    rows = rows.where("has_video").select(
        "video_id", "v.width", "v.height", "v.rotation", F.floor(F.col("us") / 1000).alias("duration_ms"), rate.alias("track_fps"), F.lit(None).cast("double").alias("capture_fps"),
        F.col("v.samples").alias("frames"), F.col("v.track").alias("mime"), "has_audio",
    )
    return probed(rows).drop("track_fps", "capture_fps", "frames")


def key_samples(packets: DataFrame, tracks: DataFrame, shares: Iterable[float] = (0.15, 0.5, 0.85)) -> DataFrame:
    """A4: of each video, the key frame closest to these shares of its duration; ties go to the earlier one.

    Places only (payload false) are enough for the choice; a file has few key frames, and only sums of a group travel.
    """
    ends = tracks.where(F.col("track").startswith("video/")).groupBy("video_id").agg(F.max("duration_us").alias("us"))
    points = ends.select("video_id", F.posexplode(F.array(*[(F.col("us") * F.lit(float(s))).cast("long") for s in shares])).alias("point", "at_us"))
    keys = packets.where("is_key").where(F.col("track").startswith("video/")).select("video_id", "pts_us", "position", "size")
    near = F.struct(F.abs(F.col("pts_us") - F.col("at_us")).alias("away"), "pts_us", "position", "size")
    best = keys.join(points, "video_id").groupBy("video_id", "point", "at_us").agg(F.min(near).alias("near"))
    return best.select("video_id", "point", "at_us", "near.pts_us", "near.position", "near.size")


# ---- writing ----


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(count, value) of runs of equal values."""
    if not len(values):
        return []
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(np.diff(np.r_[head, len(values)]).tolist(), values[head].tolist(), strict=True))


def _table(kind: bytes, rows: list[tuple], form: str, version: int = 0) -> bytes:
    return full_box(kind, version, 0, struct.pack(">I", len(rows)), struct.pack(">" + form[1:] * len(rows), *chain.from_iterable(rows)))


_MATRIX = {0: (1, 0, 0, 1), 90: (0, 1, -1, 0), 180: (-1, 0, 0, -1), 270: (0, -1, 1, 0)}


def _matrix(rotation: int) -> bytes:
    a, b, c, d = (v << 16 for v in _MATRIX.get(rotation, _MATRIX[0]))
    return struct.pack(">9i", a, b, 0, c, d, 0, 0, 0, 1 << 30)


def sample_entry(track: str, width: int, height: int, channels: int, rate: int) -> bytes:
    """A plain sample description for a track without one of its own."""
    kind, _, codec = track.split(":")[0].partition("/")
    code = codec.encode("latin-1", "replace")[:4].ljust(4)
    if kind == "video":
        return box(code, bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, width, height, 72 << 16, 72 << 16, 0, 1, 24, -1))
    return box(code, bytes(6), struct.pack(">H8xHH4xI", 1, channels or 2, 16, (rate or 0) << 16))


class TrackFile:
    """One track of a file that is written: description and sample tables."""

    def __init__(self, row: dict):
        self.row, self.kind = row, row["track"].split("/")[0]
        self.pts: list[int] = []
        self.dts: list[int] = []
        self.sizes: list[int] = []
        self.keys: list[bool] = []
        self.chunks: list[tuple[int, int]] = []  # place, samples

    def trak(self, number: int) -> bytes:
        dts, pts = np.array(self.dts, np.int64), np.array(self.pts, np.int64)
        n = len(dts)
        steps = np.diff(dts)
        if n:
            known = self.row["duration_us"]
            steps = np.r_[steps, max(0, int(dts[0]) + known - int(dts[-1])) if known is not None else steps[-1] if n > 1 else 1]
        if n and (steps.min() < 0 or steps.max() >= 1 << 32):
            raise ValueError(f"track {self.row['track']} of {self.row['video_id']} is not in order of dts_us")
        base, length = int(dts[0]) if n else 0, int(steps.sum())
        edits = [(base, -1, 1, 0), (length, 0, 1, 0)] if base > 0 else [(length, -base, 1, 0)]
        video, r = self.kind == "video", self.row
        width, height = (r["width"] or 0, r["height"] or 0) if video else (0, 0)
        tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQI4xQ8xhhhH", 0, 0, number, length, 0, 0, 0 if video else 0x100, 0), _matrix(r["rotation"] or 0), struct.pack(">II", width << 16, height << 16))
        mdhd = full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, MICRO, length, 0x55C4, 0))
        hdlr = full_box(b"hdlr", 0, 0, struct.pack(">4x4s12x", b"vide" if video else b"soun"), self.kind.encode() + b"\0")
        head = full_box(b"vmhd", 0, 1, bytes(8)) if video else full_box(b"smhd", 0, 0, bytes(4))
        dinf = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
        entry = r["format"] or sample_entry(r["track"], width, height, r["channels"] or 0, r["sample_rate"] or 0)
        parts = [full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry), _table(b"stts", _runs(steps), ">II")]
        if n and (pts != dts).any():
            parts.append(_table(b"ctts", _runs(pts - dts), ">Ii", 1))
        if not all(self.keys):
            parts.append(_table(b"stss", [(i + 1,) for i, k in enumerate(self.keys) if k], ">I"))
        counts = np.array([c for _, c in self.chunks], np.int64)
        first = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]]) if len(counts) else np.empty(0, np.int64)
        parts += [
            _table(b"stsc", [(int(k) + 1, int(counts[k]), 1) for k in first], ">III"),
            full_box(b"stsz", 0, 0, struct.pack(">II", 0, n), np.array(self.sizes, ">u4").tobytes()),
            _table(b"co64", [(p,) for p, _ in self.chunks], ">Q"),
        ]
        stbl = box(b"stbl", *parts)
        return box(b"trak", tkhd, box(b"edts", _table(b"elst", edits, ">Qqhh", 1)), box(b"mdia", mdhd, hdlr, box(b"minf", head, dinf, stbl)))


class VideoFile:
    """A file that is written: payload as it comes, in boxes of MDAT_BYTES, then the tables."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.sink, self.tracks = fs.open_output_stream(path), {}
        self.at, self.held, self.held_bytes = 0, [], 0
        self._put(box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6mp41"))

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def track(self, row: dict) -> None:
        self.tracks.setdefault(row["track"], TrackFile(row))

    def packet(self, video: str, track: str, pts: int, dts: int | None, key: bool | None, data: bytes | None) -> None:
        if track not in self.tracks:
            raise ValueError(f"{video} has packets of {track}, but no such track")
        data = data or b""
        self.held.append((track, pts, pts if dts is None else dts, bool(key), data))
        self.held_bytes += len(data)
        if self.held_bytes >= MDAT_BYTES:
            self.flush()

    def flush(self) -> None:
        """What is held goes out as one box; neighbours of one track are a chunk."""
        if not self.held:
            return
        place = self.at + 16
        self._put(struct.pack(">I4sQ", 1, b"mdat", 16 + self.held_bytes))
        for name, chunk in groupby(self.held, itemgetter(0)):
            own = self.tracks[name]
            _, pts, dts, keys, data = zip(*chunk, strict=True)
            sizes = [len(d) for d in data]
            own.chunks.append((place, len(sizes)))
            own.pts += pts
            own.dts += dts
            own.sizes += sizes
            own.keys += keys
            place += sum(sizes)
        self._put(b"".join(d for *_, d in self.held))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        ordered = sorted(self.tracks.values(), key=lambda t: (t.row["number"] is None, t.row["number"], t.row["track"]))
        traks = [t.trak(k + 1) for k, t in enumerate(ordered)]
        length = max((t.dts[-1] for t in ordered if t.dts), default=0)
        mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, MICRO, max(length, 0), 1 << 16, 0x100), _matrix(0), bytes(24), struct.pack(">I", len(traks) + 1))
        self._put(box(b"moov", mvhd, *traks))
        self.sink.close()


class Mp4Writer(DataSourceArrowWriter):
    """Rows of ROWS by video, tracks first; a video's rows must be in one partition, in this order."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        pairs, file, video = [], None, None
        for batch in iterator:
            columns = (batch.column(c).to_pylist() for c in ("video_id", "is_track", "track", "pts_us", "dts_us", "is_key", "data"))
            for k, (own, is_track, *packet) in enumerate(zip(*columns, strict=True)):
                if file is None or own != video:
                    if file is not None:
                        file.close()
                    video, temporary = own, f"{root}/_{uuid.uuid4().hex}.part"
                    pairs.append((temporary, f"{root}/{video}.mp4"))
                    file = VideoFile(fs, temporary)
                file.track(batch.slice(k, 1).to_pylist()[0]) if is_track else file.packet(video, *packet)
        if file is not None:
            file.close()
        return Written(pairs)

    def commit(self, messages) -> None:
        moved_or_none(self.path, messages)

    def abort(self, messages) -> None:
        parts_removed(self.path, messages)


def write_packets(packets: DataFrame, tracks: DataFrame, path: str, chunk_us: int = MICRO // 2) -> None:
    """One file a video, its tracks' packets in turns of `chunk_us`; all files or none.

    packets: video_id, track, pts_us, is_key, data, and dts_us if it is not pts_us; tracks: rows of
    TRACKS, of which all but video_id and track may be null or absent.  duration_us, if given, is that
    of the packets and tells how long the last one lasts; else it lasts as long as the one before.
    """
    dts = F.coalesce(F.col("dts_us"), F.col("pts_us")) if "dts_us" in packets.columns else F.col("pts_us")
    own = {"number": "int", "width": "int", "height": "int", "rotation": "int", "channels": "int", "sample_rate": "int", "duration_us": "bigint", "start_us": "bigint", "format": "binary"}
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    given = lambda df, name, kind: F.col(name).cast(kind).alias(name) if name in df.columns else none(kind, name)
    heads = tracks.select(
        F.col("video_id").cast("string").alias("video_id"), "track", F.lit(True).alias("is_track"), *(given(tracks, c, k) for c, k in own.items()),
        none("bigint", "pts_us"), none("bigint", "dts_us"), none("boolean", "is_key"), none("binary", "data"), none("bigint", "turn"),
    )
    rows = packets.select(
        F.col("video_id").cast("string").alias("video_id"), "track", F.lit(False).alias("is_track"), *(none(k, c) for c, k in own.items()),
        F.col("pts_us").cast("bigint").alias("pts_us"), dts.cast("bigint").alias("dts_us"), "is_key", F.col("data").cast("binary").alias("data"), F.floor(dts / chunk_us).alias("turn"),
    )
    packets.sparkSession.dataSource.register(Mp4)
    dealt = heads.unionByName(rows).repartition("video_id").sortWithinPartitions("video_id", F.desc("is_track"), "turn", "track", "dts_us")
    dealt.write.format("mp4").mode("append").options(path=path).save()


def remuxed(packets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """A range without decoding: from the last key frame of the video at or before `start_us`, up to `end_us`, times from that key frame on.

    Without such a key frame, from the beginning; what precedes it falls out, so no time is below 0.
    """
    key = F.col("track").startswith("video/") & F.col("is_key") & (F.col("pts_us") <= start_us) & F.lit(start_us > 0)
    bases = packets.groupBy("video_id").agg(F.coalesce(F.max(F.when(key, F.col("pts_us"))), F.lit(0)).alias("_at"))
    rows = packets.where(F.col("pts_us") <= end_us).join(bases, "video_id").where("pts_us >= _at")
    return rows.withColumns({c: F.col(c) - F.col("_at") for c in ("pts_us", "dts_us") if c in packets.columns}).select(packets.columns)
