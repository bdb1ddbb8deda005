"""What must not grow with the tables: tasks that take all rows, sides of joins that are sent to all, pixels held at once."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinetide import queries as Q
from cinetide.functions import pixels
from cinetide.operators import control, frames, tiles
from cinetide.session import shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("clips", [Q.part_clips, Q.moved_clips])
def test_rows_are_spread_before_they_become_pixels(spark, small, clips):
    sizes = [r["count"] for r in clips(spark, small).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 200 and max(sizes) < 100


def test_pixels_are_made_a_few_frames_at_a_time(spark, small):
    batch = pa.RecordBatch.from_pydict({"n": list(range(150))})
    parts = list(frames.slices([batch, batch.slice(0, 0), batch]))
    assert [p.num_rows for p in parts] == [64, 64, 22] * 2 and [v for p in parts for v in p.column("n").to_pylist()] == list(range(150)) * 2
    assert tiles.OUT_BYTES <= 8 << 20


def test_frames_are_never_sent_to_all(spark, small):
    clips = Q.part_clips(spark, small)
    flags = frames.analysed(clips)
    for df in (frames.motion(clips), tiles.processed(clips, flags), tiles.stabilised(clips.withColumn("source", F.col("px")), flags), Q.upscale_blocks(spark, small)):
        assert "Broadcast" not in plan(df)


def test_blocks_of_a_batch_are_removed_before_the_next(spark, small, monkeypatch):
    """upscale_blocks holds the blocks of one batch of clips at a time, and none when it is done."""
    from pathlib import Path

    want = sorted(map(tuple, Q.upscale_blocks(spark, small).collect()))
    names = sorted({r[0] for r in want})
    a_clip = max(r[1] for r in want) * Q.WIDE * Q.HIGH * 3 * tiles.SCALE**2
    root = Path(shared_folder(spark, "blocks").removeprefix("file://")).parent
    there = lambda: {f.parent for f in root.glob("blocks-*/**/*.arrow")}
    before, seen, processed = there(), [], tiles.processed
    monkeypatch.setattr(tiles, "processed", lambda *a, **b: (seen.append(len(there() - before)), processed(*a, **b))[1])
    monkeypatch.setattr(Q, "BLOCK_BYTES", 5 * a_clip)
    batches = list(Q.clip_batches(spark, small, Q.BLOCK_BYTES))
    assert len(batches) > 2 and sorted(n for b in batches for n in b) == names
    assert sorted(map(tuple, Q.upscale_blocks(spark, small).collect())) == want
    assert len(seen) == 2 * len(batches) and not any(seen) and there() == before


def test_motion_across_blocks_gaps_and_clips(spark):
    from cinetide.schemas import FRAMES

    size = frames.FRAMES_AT_ONCE
    px = bytes(range(256)) * 3  # 16 x 16
    rows = [("a", i, i, 16, 16, px) for i in (*range(2 * size + 2), 2 * size + 5)] + [("b", i, i, 16, 16, px) for i in (size - 1, size)] + [("c", 0, 0, 16, 16, px), ("c", 1, 1, 8, 16, px[:384])]
    got = {(r["video_id"], r["frame_idx"]): r["dx"] for r in frames.motion(spark.createDataFrame(rows, FRAMES)).collect()}
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v is None} == {("a", 0), ("a", 2 * size + 5), ("b", size - 1), ("c", 0), ("c", 1)}


def test_a_video_is_not_one_task_where_its_end_is_found(spark):
    rows = spark.range(200).select(F.lit(0).alias("video_id"), F.lit("v").alias("track"), (F.col("id") * 10).alias("pts_us"))
    out = control.interleaved(rows, rows.where("pts_us <= 1000").withColumn("track", F.lit("a")), shortest=True)
    assert out.columns == ["video_id", "track", "pts_us"]
    assert [tuple(r) for r in out.collect()] == [(0, t, p) for p in range(0, 1010, 10) for t in "av"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(control.interleaved(rows, rows.withColumn("track", F.lit("a")), shortest=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", text)
    assert joins and all("_part" in keys for keys in joins)


def test_a_model_takes_one_thread_a_task(spark, small):
    name = tiles.add_model(Q._net_weights(spark, small), "threads", shared_folder(spark, "models"))
    tiles.onnx_kernel(name)(np.zeros((1, 3, 6, 8), np.float32))
    assert tiles._sessions.pop(name).get_session_options().intra_op_num_threads == 1


def test_kernels_in_whole_numbers(spark):
    rng = np.random.default_rng(7)
    plane = rng.integers(-400, 1021, (9, 13))
    padded = np.pad(plane, 8, mode="edge")
    cut = lambda v: int(v / 17)
    rows = [[cut(padded[y, x : x + 17].sum()) for x in range(13)] for y in range(25)]
    want = [[cut(sum(rows[y + k][x] for k in range(17))) for x in range(13)] for y in range(9)]
    assert pixels.box_blur(plane, 4).tolist() == want
    out, last = (rng.integers(0, 256, (12, 12, 3)).astype(np.uint8) for _ in range(2))
    still, far = np.zeros((3, 3, 3), np.uint8), np.full((3, 3, 3), 99, np.uint8)
    assert pixels.stabilised(out, last, far, still, 0.5) is out  # nothing is blended
    assert (pixels.stabilised(out, last, still, still, 1.0) == last).all()
    assert (pixels.stabilised(out, last, still, still, 0.5) == (out.astype(int) + last) * 128 // 256).all()


def test_neighbouring_samples_are_views_of_what_was_read():
    from cinetide.sources import mp4

    raw = pa.py_buffer(b"aabbbcd")
    whole = mp4._cut(raw.to_pybytes(), np.array([0, 2, 5, 6]), np.array([2, 3, 1, 0]))
    assert whole.to_pylist() == [b"aa", b"bbb", b"c", b""] and whole.buffers()[2].size == 7
    assert mp4._cut(raw.to_pybytes(), np.array([0, 3, 3]), np.array([2, 2, 4])).to_pylist() == [b"aa", b"bb", b"bbcd"]
