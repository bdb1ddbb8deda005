"""Media columns over archive directories, through a Spark data source of its own.

`store()` writes payloads as members of archives (stored ZIP files of about
`ARCHIVE_BYTES`) in a directory; each task writes files under new names, and
only those that finished tasks report enter the directory's manifest, a table that
Spark commits, so a lost or repeated task leaves nothing that is read.

`MediaArchives` (format "media_archives") plans byte ranges over the archives of
the manifest.  The driver only lists the manifest's parts and reads one total: a
partition is a share of the ranges of some parts, of `RANGE_BYTES` or, so that there
are `PARTITIONS` partitions at most, more.  Its reader gets the archives' names and
sizes from the parts, takes the members whose header starts in a range from the
archive's own directory, reads the range in blocks, and streams batches of at most
`BATCH_BYTES` through Arrow.
A member that comes out short or with a wrong checksum is read again on its own
at its offset, up to `ATTEMPTS` times, without touching its neighbours; then the
task fails, or with the option onError=row the member's row carries the error.

The stored form is a greyscale PNG, 64 samples of 8 bits a row, so a payload is
the text's UTF-8 bytes and zeros up to a positive multiple of 64.

Defined results: a null text is empty (64 zero bytes); a null id stays null;
equal texts give equal values; repeated rows are members of their own; a very long
text is one member, held whole; an empty table gives an empty result; other columns,
also those named like the operator's own, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, table

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
WIDTH = 64
MANIFEST, TOTAL = "_manifest", "_total"
#: A bound of what the driver plans.
PARTITIONS = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- the stored form ----


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, WIDTH a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row after its filter type, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def decoded(media: bytes) -> bytes:
    """The samples of a PNG that encoded() made; checks every checksum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], (0, 0)
    while at < len(media):
        (length,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + length]
        if struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
            size = (height, width)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation, entropy and mean step between samples of a row."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1)).mean()
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};sd={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


# ---- archives ----


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(batches: Iterable[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    """Writes (doc_id, text) as members of archives; yields (archive, bytes, members)."""
    fs, root = filesystem(directory)
    out, zipped, done = None, None, []

    def close() -> None:
        nonlocal out, zipped
        if zipped is not None:
            members = len(zipped.infolist())
            zipped.close()
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(out.getbuffer())
            done.append((name, out.getbuffer().nbytes, members))
        out = zipped = None

    name = ""
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            if zipped is None:
                name, out = f"{uuid.uuid4().hex}.zip", io.BytesIO()
                zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
            raw = (text.as_py() or "").encode()
            zipped.writestr(zipfile.ZipInfo(f"{doc_id.as_py()}/{len(raw)}.png"), encoded(padded(raw)))
            if out.tell() >= ARCHIVE_BYTES:  # held in memory until it is full
                close()
    close()
    names, sizes, members = zip(*done, strict=True) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["archive", "bytes", "members"])


def store(docs: DataFrame, directory: str) -> None:
    """Writes the payloads of all documents, the manifest (a row for each archive, not for each member), and its total."""
    fs, root = filesystem(directory)
    fs.create_dir(root, recursive=True)
    done = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: write_archives(it, directory), "archive string, bytes bigint, members bigint")
    done.write.parquet(f"{directory}/{MANIFEST}")
    total = docs.sparkSession.read.parquet(f"{directory}/{MANIFEST}").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    with fs.open_output_stream(f"{root}/{TOTAL}") as sink:
        sink.write(str(total).encode())


class ByteRanges(InputPartition):
    """Every `of`th byte range, from number `share` on, of the archives in some parts of the manifest."""

    def __init__(self, parts: list[str], share: int, of: int, size: int):
        self.parts, self.share, self.of, self.size = parts, share, of, size


class MediaArchives(DataSource):
    """format("media_archives").option("path", directory) -> member, archive, offset, media, error."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, archive string, offset bigint, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.on_error = options.get("onError", "fail")

    def partitions(self) -> list[ByteRanges]:
        fs, root = filesystem(self.directory)
        with fs.open_input_stream(f"{root}/{TOTAL}") as source:
            total = int(source.read())
        parts = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFEST}")) if f.path.endswith(".parquet"))
        size = max(self.range_bytes, -(-total // PARTITIONS))
        of = max(1, -(-total // (size * max(1, len(parts)))))  # shares of each group of parts
        together = max(1, -(-len(parts) * of // PARTITIONS))
        groups = [parts[k : k + together] for k in range(0, len(parts), together)]
        return [ByteRanges(group, share, of, size) for group in groups for share in range(of)] or [ByteRanges([], 0, 1, size)]

    def ranges(self, partition: ByteRanges) -> Iterator[tuple[str, int, int]]:
        """Archive, and where its range begins and ends."""
        fs, _ = filesystem(self.directory)
        number = 0
        for part in partition.parts:
            with fs.open_input_file(part) as source:
                rows = pq.read_table(source, columns=["archive", "bytes"]).to_pylist()
            for row in rows:
                n = max(1, -(-row["bytes"] // partition.size))
                step = -(-row["bytes"] // n)
                for k in range(n):
                    if number % partition.of == partition.share:
                        yield row["archive"], k * step, (k + 1) * step
                    number += 1

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for archive, lo, hi in self.ranges(partition):
            yield from self.members(archive, lo, hi)

    def members(self, archive: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Batches of the members whose headers start in [lo, hi)."""
        fs, root = filesystem(self.directory)
        path = f"{root}/{archive}"
        with fs.open_input_file(path) as source, zipfile.ZipFile(source) as zipped:
            entries = sorted((e for e in zipped.infolist() if lo <= e.header_offset < hi), key=lambda e: e.header_offset)
        rows: list[tuple] = []
        size = 0
        for entry, block in blocks(fs, path, entries):
            media, error = member(fs, path, entry, block)
            if error and self.on_error != "row":
                raise OSError(f"{path}, member {entry.filename} at {entry.header_offset}: {error}")
            rows.append((entry.filename, archive, entry.header_offset, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "archive", "offset", "media", "error"])


def blocks(fs: pafs.FileSystem, path: str, entries: list[zipfile.ZipInfo]) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
    """Each entry with its bytes out of blocks of neighbours, read at once; empty if a block can't be read."""
    at = 0
    while at < len(entries):
        to, start = at, entries[at].header_offset
        while to < len(entries) and (to == at or end_of(entries[to]) - start <= BATCH_BYTES):
            to += 1
        try:
            with fs.open_input_file(path) as source:
                block = source.read_at(end_of(entries[to - 1]) - start, start)
        except OSError:
            block = b""
        for entry in entries[at:to]:
            yield entry, block[entry.header_offset - start : end_of(entry) - start]
        at = to


def end_of(entry: zipfile.ZipInfo) -> int:
    """A bound of where a member ends: header, name, extra fields and data."""
    return entry.header_offset + 30 + len(entry.filename.encode()) + len(entry.extra) + entry.compress_size


def body_of(raw: bytes, entry: zipfile.ZipInfo) -> bytes:
    """Data of the member from its bytes; checks header, length and checksum."""
    if raw[:4] != b"PK\x03\x04":
        raise OSError("no member header")
    name, extra = struct.unpack("<HH", raw[26:30])
    data = raw[30 + name + extra : 30 + name + extra + entry.compress_size]
    if len(data) != entry.compress_size or zlib.crc32(data) != entry.CRC:
        raise OSError("short or damaged member")
    return data


def member(fs: pafs.FileSystem, path: str, entry: zipfile.ZipInfo, block: bytes) -> tuple[bytes | None, str | None]:
    """(data, None) from the block or, again and on its own, from the member's offset; else (None, error)."""
    for attempt in range(ATTEMPTS + 1):
        try:
            if attempt:
                with fs.open_input_file(path) as source:
                    block = source.read_at(end_of(entry) - entry.header_offset, entry.header_offset)
            return body_of(block, entry), None
        except (OSError, struct.error) as e:
            error = str(e)
    return None, error


def opened(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=directory, **options).load()


# ---- features ----

SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for members as they were read back."""
    for batch in batches:
        rows = []
        for name, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
            doc_id, n_bytes = name.removesuffix(".png").split("/")
            payload = decoded(media)
            digests = [hashlib.sha256(x).hexdigest() for x in (payload, media)]
            rows.append((None if doc_id == "None" else int(doc_id), int(n_bytes), len(payload), digests[0], zlib.crc32(payload[-WIDTH:]), len(media), digests[1], feature(payload)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch(spark, "media")
    store(table(spark, sf_dir, "documents"), directory)
    return opened(spark, directory).select("member", "media").mapInArrow(described, SCHEMA)
