"""MP4 files: hand-made ones against a plain reader, round trips, ranges that read their bytes only, and commits."""

import struct

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from cinetide.sources import mp4


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, version, *parts, flags=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def by_hand(samples, scale=600, chunk=(3, 2, 2), key=(1, 4), shift=(2, 0, 1), edits=((300, -1), (999, 10)), wide=False):
    """A file of one video track with old tables, and its packets as a plain loop gives them."""
    payload = b"".join(samples)
    ftyp = box(b"ftyp", b"isom", bytes(4))
    begin = len(ftyp) + 8
    steps = [20, 20, 30, 30, 30, 10, 10][: len(samples)]
    counts, k = [], 0
    while k < len(samples):
        counts.append(min(chunk[min(len(counts), len(chunk) - 1)], len(samples) - k))
        k += counts[-1]
    places, at, k = [], begin, 0
    for c in counts:
        places.append(at)
        at += sum(map(len, samples[k : k + c]))
        k += c
    stsc = b"".join(struct.pack(">III", i + 1, c, 1) for i, c in enumerate(counts))
    entry = box(b"avc1", bytes(6), struct.pack(">H16xHH", 1, 64, 48), bytes(50))
    stbl = box(
        b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stts", 0, struct.pack(">I", len(steps)), b"".join(struct.pack(">II", 1, s) for s in steps)),
        full(b"ctts", 0, struct.pack(">I", len(samples)), b"".join(struct.pack(">II", 1, shift[i % len(shift)] * 20) for i in range(len(samples)))),
        full(b"stss", 0, struct.pack(">I", len(key)), b"".join(struct.pack(">I", k) for k in key)), full(b"stsc", 0, struct.pack(">I", len(counts)), stsc),
        full(b"stsz", 0, struct.pack(">II", 0, len(samples)), b"".join(struct.pack(">I", len(s)) for s in samples)),
        full(b"co64", 0, struct.pack(">I", len(places)), b"".join(struct.pack(">Q", p) for p in places)) if wide else full(b"stco", 0, struct.pack(">I", len(places)), b"".join(struct.pack(">I", p) for p in places)),
    )
    elst = full(b"elst", 0, struct.pack(">I", len(edits)), b"".join(struct.pack(">Iihh", n, m, 1, 0) for n, m in edits))
    matrix = struct.pack(">9i", 0, 1 << 16, 0, -(1 << 16), 0, 0, 0, 0, 1 << 30)
    tkhd = full(b"tkhd", 0, struct.pack(">III4xI8x", 0, 0, 7, 0), bytes(8), matrix, struct.pack(">II", 64 << 16, 48 << 16))
    mdhd = full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, scale, sum(steps), 0, 0))
    hdlr = full(b"hdlr", 0, struct.pack(">4x4s12x", b"vide"), b"\0")
    trak = box(b"trak", tkhd, box(b"edts", elst), box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))
    text = box(b"trak", full(b"tkhd", 0, struct.pack(">III", 0, 0, 9), bytes(68)), box(b"mdia", mdhd, full(b"hdlr", 0, struct.pack(">4x4s12x", b"text")), box(b"minf", stbl)))
    moov = box(b"moov", full(b"mvhd", 0, struct.pack(">IIII", 0, 0, 100, 0), bytes(80)), text, trak)
    raw = ftyp + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload + box(b"free", bytes(5)) + moov
    move = edits[0][0] * scale // 100 - edits[1][1] if edits[0][1] < 0 else -edits[0][1]
    rows, dts, at = [], 0, begin
    for i, s in enumerate(samples):
        rows.append(("video/avc1", (dts + shift[i % len(shift)] * 20 + move) * 10**6 // scale, (dts + move) * 10**6 // scale, i + 1 in key, at, len(s), s))
        dts, at = dts + steps[i], at + len(s)
    return raw, rows


def fragmented(samples):
    """A file with an empty moov and two fragments; sizes and durations partly by default."""
    entry = box(b"mp4a", bytes(6), struct.pack(">H8xHH4xI", 1, 2, 16, 48_000 << 16))
    empty = [full(k, 0, bytes(4)) for k in (b"stts", b"stsc", b"stco")] + [full(b"stsz", 0, bytes(8))]
    stbl = box(b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), *empty)
    tkhd = full(b"tkhd", 1, struct.pack(">QQI", 0, 0, 2), bytes(72))
    mdhd = full(b"mdhd", 1, struct.pack(">QQIQHH", 0, 0, 1000, 0, 0, 0))
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, full(b"hdlr", 0, struct.pack(">4x4s12x", b"soun")), box(b"minf", stbl)))
    raw = box(b"ftyp", b"iso6") + box(b"moov", full(b"mvhd", 0, struct.pack(">IIII", 0, 0, 1000, 0)), trak, box(b"mvex", full(b"trex", 0, struct.pack(">IIIII", 2, 1, 40, 5, 0x10000))))
    rows = []
    first, second = samples[:3], samples[3:]
    at = len(raw)
    run = lambda place: full(b"trun", 0, struct.pack(">Ii", 3, place), struct.pack(">I", 0), b"".join(struct.pack(">II", d, len(s)) for d, s in zip((10, 20, 30), first, strict=True)), flags=0x305)
    moof = lambda place: box(b"moof", full(b"mfhd", 0, bytes(4)), box(b"traf", full(b"tfhd", 0, struct.pack(">I", 2), flags=0x20000), full(b"tfdt", 1, struct.pack(">Q", 500)), run(place)))
    size = len(moof(0))
    raw += moof(size + 8) + box(b"mdat", *first)
    place = at + size + 8
    for k, (d, s) in enumerate(zip((500, 510, 530), first, strict=True)):
        rows.append(("audio/mp4a", d * 1000, d * 1000, k == 0, place, len(s), s))
        place += len(s)
    at = len(raw)
    run = lambda base: full(b"trun", 1, struct.pack(">I", len(second)), b"".join(struct.pack(">Ii", 0x2000000, -5 * k) for k in range(len(second))), flags=0xC00)
    moof = lambda base: box(b"moof", box(b"traf", full(b"tfhd", 0, struct.pack(">IQ", 2, base), flags=1), run(base)))
    size = len(moof(0))
    raw += moof(at + size + 8) + box(b"mdat", *second)
    place = at + size + 8
    for k, s in enumerate(second):
        rows.append(("audio/mp4a", (560 + 40 * k - 5 * k) * 1000, (560 + 40 * k) * 1000, True, place, len(s), s))
        place += len(s)
    return raw, rows


SAMPLES = [bytes([65 + k]) * (5 + 11 * k) for k in range(7)]


def listed(df):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.drop("video_id").collect())


@pytest.fixture
def folder(tmp_path):
    made = {"hand": by_hand(SAMPLES), "wide": by_hand(SAMPLES, wide=True, edits=((50, 40),)), "fragments": fragmented([b"a" * 7, b"b" * 9, b"c" * 11, b"d" * 5, b"e" * 5])}
    for name, (raw, _) in made.items():
        (tmp_path / f"{name}.mp4").write_bytes(raw)
    (tmp_path / "notes.txt").write_bytes(b"no video")
    return f"file://{tmp_path}", {name: sorted(rows) for name, (_, rows) in made.items()}


def test_packets_equal_a_plain_reader(spark, folder):
    path, expected = folder
    for per in (10, 1 << 20):
        packets = mp4.read_packets(spark, path, bytesPerPartition=per)
        for name, rows in expected.items():
            assert listed(packets.where(F.col("video_id") == name)) == rows
    places = mp4.read_packets(spark, path, payload="false")
    assert places.where("data is not null").count() == 0 and listed(places.drop("data")) == sorted(r[:-1] for rows in expected.values() for r in rows)


def test_tracks(spark, folder):
    rows = {r["video_id"]: r.asDict() for r in mp4.read_tracks(spark, folder[0]).collect()}
    assert rows["hand"]["width"] == 64 and rows["hand"]["height"] == 48 and rows["hand"]["rotation"] == 90 and rows["hand"]["samples"] == 7 and rows["hand"]["number"] == 7
    assert rows["hand"]["duration_us"] == 250_000 and rows["fragments"]["duration_us"] == 640_000
    assert rows["fragments"]["channels"] == 2 and rows["fragments"]["sample_rate"] == 48_000 and rows["fragments"]["track"] == "audio/mp4a"
    probed = {r["video_id"]: r.asDict() for r in mp4.probed_files(mp4.read_tracks(spark, folder[0])).collect()}
    assert set(probed) == {"hand", "wide"} and probed["hand"]["frame_count"] == 7 and probed["hand"]["fps"] == pytest.approx(28) and not probed["hand"]["has_audio"]


class Counting:
    """A source that counts what is read of it."""

    def __init__(self, raw):
        self.raw, self.ranges = raw, []

    def read_at(self, n, at):
        self.ranges.append((at, at + n))
        return self.raw[at : at + n]


def test_a_range_reads_its_bytes_only(monkeypatch):
    monkeypatch.setattr(mp4, "GAP_BYTES", 0)
    raw, rows = by_hand([bytes([k]) * 1000 for k in range(7)])
    source = Counting(raw)
    reader = mp4.Mp4Reader({"path": ""})
    times = sorted(r[1] for r in rows)
    list(reader.pushFilters([mp4.GreaterThanOrEqual(("pts_us",), times[2]), mp4.LessThan(("pts_us",), times[5]), mp4.EqualTo(("track",), "video/avc1")]))
    tracks = mp4.tables(source, len(raw))
    table_bytes = sum(b - a for a, b in source.ranges)
    assert table_bytes < 1500 and not any(a < 2000 < b for a, b in source.ranges)
    source.ranges.clear()
    got = [r for batch in reader.rows(source, "x.mp4", tracks, reader.chosen(tracks, 0, 1)) for r in batch.to_pylist()]
    expected = [r for r in rows if times[2] <= r[1] < times[5]]
    assert [(r["pts_us"], r["data"]) for r in got] == [(r[1], r[-1]) for r in expected]
    assert sum(b - a for a, b in source.ranges) == sum(r[5] for r in expected)


def clips(spark, n=40):
    rows = []
    for v in range(3):
        for i in range(n):
            rows.append((f"v{v}", "video/avc1", i * 33_367 + 66_734 * (i % 3), i * 33_367, i % 8 == 0, f"v{v}f{i}".encode() * (1 + i % 5)))
        for i in range(n * (v > 0)):
            rows.append((f"v{v}", "audio/mp4a", 5_000 + i * 23_219, 5_000 + i * 23_219, True, b"" if i == 3 else f"a{i}".encode()))
    packets = spark.createDataFrame(rows, "video_id string, track string, pts_us bigint, dts_us bigint, is_key boolean, data binary").repartition(4)
    tracks = packets.select("video_id", "track").distinct().withColumns({"width": F.lit(1920), "height": F.lit(1080), "rotation": F.lit(270), "channels": F.lit(2), "sample_rate": F.lit(44_100)})
    return packets, tracks


COLUMNS = ["video_id", "track", "pts_us", "dts_us", "is_key", "data"]


def same(a, b):
    rows = lambda df: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(COLUMNS).collect())
    assert rows(a) == rows(b)


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_what_is_written_is_read_again(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(mp4, "MDAT_BYTES", held)
    packets, tracks = clips(spark)
    one, two = (f"file://{tmp_path}/{x}" for x in "ab")
    mp4.write_packets(packets, tracks, one)
    same(mp4.read_packets(spark, one), packets)
    heads = mp4.read_tracks(spark, one)
    assert {(r["width"], r["height"], r["rotation"]) for r in heads.where("track like 'video%'").collect()} == {(1920, 1080, 270)}
    mp4.write_packets(mp4.read_packets(spark, one), heads, two)  # what is read is written again
    same(mp4.read_packets(spark, two), packets)
    assert sorted(map(tuple, mp4.read_tracks(spark, two).collect())) == sorted(map(tuple, heads.collect()))


def test_tracks_take_turns(spark, tmp_path):
    packets, tracks = clips(spark)
    mp4.write_packets(packets, tracks, f"file://{tmp_path}/x", chunk_us=200_000)
    rows = mp4.read_packets(spark, f"file://{tmp_path}/x", payload="false").where("video_id = 'v1'").orderBy("position", "dts_us").collect()
    turns = [r["dts_us"] // 200_000 for r in rows]
    assert turns == sorted(turns) and len({r["track"] for r in rows[:12]}) == 2


def test_range_remux(spark, tmp_path):
    packets, tracks = clips(spark)
    mp4.write_packets(packets, tracks, f"file://{tmp_path}/x")
    cut = mp4.remuxed(mp4.read_packets(spark, f"file://{tmp_path}/x"), 400_000, 900_000)
    mp4.write_packets(cut, tracks, f"file://{tmp_path}/y")
    same(mp4.read_packets(spark, f"file://{tmp_path}/y"), cut)
    rows = packets.collect()
    for v in ("v0", "v1"):
        base = max(r["pts_us"] for r in rows if r["video_id"] == v and r["track"] == "video/avc1" and r["is_key"] and r["pts_us"] <= 400_000)
        expected = sorted((r["track"], r["pts_us"] - base) for r in rows if r["video_id"] == v and base <= r["pts_us"] <= 900_000)
        assert sorted((r["track"], r["pts_us"]) for r in cut.where(F.col("video_id") == v).collect()) == expected
    same(mp4.remuxed(packets, 0, 1 << 40), packets)


def test_key_samples(spark, tmp_path):
    packets, tracks = clips(spark)
    mp4.write_packets(packets, tracks, f"file://{tmp_path}/x")
    got = mp4.key_samples(mp4.read_packets(spark, f"file://{tmp_path}/x", payload="false"), mp4.read_tracks(spark, f"file://{tmp_path}/x")).collect()
    keys = sorted(r["pts_us"] for r in packets.where("video_id = 'v0' and is_key").collect())
    for r in got:
        if r["video_id"] == "v0":
            assert r["pts_us"] == min(keys, key=lambda k: (abs(k - r["at_us"]), k))
    assert len(got) == 9


def test_all_files_or_none(spark, tmp_path):
    packets, tracks = clips(spark)
    path = f"file://{tmp_path}/x"
    with pytest.raises(Exception, match="no such track"):
        mp4.write_packets(packets, tracks.where("video_id <> 'v2'"), path)
    left = pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/x", allow_not_found=True))
    assert not [f for f in left if f.path.endswith(".mp4")]
    mp4.write_packets(packets.where("video_id = 'v1'"), tracks.where("video_id = 'v1'"), path)
    with pytest.raises(Exception, match="there already"):
        mp4.write_packets(packets, tracks, path)
    assert [f.path[-6:] for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/x")) if f.path.endswith(".mp4")] == ["v1.mp4"]


def test_odd_files(spark, tmp_path):
    (tmp_path / "none.mp4").write_bytes(b"")
    (tmp_path / "only.mp4").write_bytes(box(b"ftyp", b"isom"))
    assert mp4.read_packets(spark, f"file://{tmp_path}").count() == mp4.read_tracks(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "cut.mp4").write_bytes(by_hand(SAMPLES)[0][:-9])
    with pytest.raises(Exception, match="does not fit"):
        mp4.read_packets(spark, f"file://{tmp_path}").count()
    packets, tracks = clips(spark)
    mp4.write_packets(packets.limit(0), tracks.limit(0), f"file://{tmp_path}/e")
    mp4.write_packets(packets.limit(0), tracks.where("video_id = 'v0'"), f"file://{tmp_path}/f")
    assert mp4.read_tracks(spark, f"file://{tmp_path}/f").select("samples").collect() == [(0,)]


def test_shares_are_planned_by_size():
    files = [pafs.FileInfo(f"f{k}.mp4", size=s, type=pafs.FileType.File) for k, s in enumerate((10, 20, 250, 30, 90))]
    parts = [p.parts for p in mp4.planned(files, 100)]
    assert parts == [[("f2.mp4", 250, k, 3)] for k in range(3)] + [] or len(parts) == 5
    covered = sorted((n, k, of) for p in parts for n, _, k, of in p)
    assert covered == [("f0.mp4", 0, 1), ("f1.mp4", 0, 1), ("f2.mp4", 0, 3), ("f2.mp4", 1, 3), ("f2.mp4", 2, 3), ("f3.mp4", 0, 1), ("f4.mp4", 0, 1)]
    assert mp4.planned([], 100)[0].parts == []


def test_a_share_takes_its_samples_once():
    raw, rows = by_hand(SAMPLES)
    tracks = mp4.tables(Counting(raw), len(raw))
    reader = mp4.Mp4Reader({"path": ""})
    for of in (1, 2, 5):
        pts = np.concatenate([reader.chosen(tracks, k, of)[1] for k in range(of)])
        assert sorted(pts.tolist()) == sorted(r[1] for r in rows)
