"""Ordered-frame operators: differences, duplicates, runs, scenes, reuse of results.

Pixels never travel through a window's shuffle: features are projected first,
windows run over ids and small values, and pixels are joined last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinetide.functions import flow, pixels
from cinetide.functions import scalars as S

DUPLICATE, CUT, FIRST = 0.05, 40.0, 255.0
#: Frames whose pixels a kernel makes or holds at once.
FRAMES_AT_ONCE = 64
#: Pixels of the planes that motion() compares at once; a pair of larger ones goes by itself.
PIXELS_AT_ONCE = 3 << 12


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows spread evenly over all tasks before they grow into pixels: small rows would be coalesced into one task, as their bytes tell nothing of their work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def slices(batches: Iterable[pa.RecordBatch], most: int = FRAMES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows; a slice is a view of its batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def mean_abs_diff(a: Column | str, b: Column | str) -> Column:
    """mean absolute difference of two arrays; null if either is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def with_diff(df: DataFrame, keys: Sequence[str], order: str, thumb: str) -> DataFrame:
    """Difference to the frame before, which always advances; FIRST for a key's first frame."""
    before = F.lag(thumb).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("diff", F.coalesce(mean_abs_diff(F.col(thumb), before), F.lit(FIRST)))


def with_flags(df: DataFrame, diff: str = "diff", duplicate: float = DUPLICATE, cut: float = CUT, first: Column | None = None) -> DataFrame:
    """Strict comparisons; a first frame is a cut and never a duplicate."""
    first = F.col(diff) == FIRST if first is None else first
    return df.withColumns({"is_dup": ~first & (F.col(diff) < duplicate), "is_cut": first | (F.col(diff) > cut)})


def with_runs(df: DataFrame, keys: Sequence[str], order: str, dup: str = "is_dup") -> DataFrame:
    """Each frame's root, the last frame before or at it that is no duplicate, and the number of its run."""
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {"root": F.last(F.when(~F.col(dup), F.col(order)), ignorenulls=True).over(sofar), "run": F.sum(F.when(~F.col(dup), 1).otherwise(0)).over(sofar)}
    )


def with_segments(df: DataFrame, keys: Sequence[str], order: str, cut: str = "is_cut") -> DataFrame:
    """The number of cuts so far; temporal state is kept within a segment only."""
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("segment", F.sum(F.col(cut).cast("int")).over(sofar))


def thumbnails(frames: DataFrame) -> DataFrame:
    """adds thumb, 32 x 32 means of the luma, to frames; pixels are dropped."""
    rest = [f for f in frames.schema.fields if f.name != "px"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", thumb array<float>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(batch.column("px"), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)
            thumbs = [pixels.thumbnail(pixels.frame(px.as_py(), w, h)) for px, w, h in rows]
            flat = pa.array(np.concatenate(thumbs) if thumbs else np.empty(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(thumbs) + 1, dtype=np.int32) * pixels.THUMB**2), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), lists], [*(f.name for f in rest), "thumb"])

    return frames.mapInArrow(run, schema)


def analysed(frames: DataFrame) -> DataFrame:
    """Flags, roots and segments of all frames, without pixels."""
    out = with_flags(with_diff(thumbnails(frames), ["video_id"], "frame_idx", "thumb")).drop("thumb")
    return with_segments(with_runs(out, ["video_id"], "frame_idx"), ["video_id"], "frame_idx")


def shared_back(results: DataFrame, analysis: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "frame_idx") -> DataFrame:
    """Gives every row of the analysis its root's result; results are keyed by the roots and have other columns than the analysis."""
    roots = results.withColumnRenamed(order, "root")
    return analysis.join(roots, [*keys, "root"])


def digests(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = lambda rgb: rgb) -> DataFrame:
    """(video_id, frame_idx, digest): a sum of what the kernel makes of each frame, weighted by row, column and channel."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.empty((0, 0, 0), np.int64)
        for batch in slices(batches):
            sums = []
            for px, w, h in zip(*(batch.column(c).to_pylist() for c in ("px", "width", "height")), strict=True):
                out = np.atleast_3d(kernel(pixels.frame(px, w, h)))
                if out.shape != weights.shape:
                    y, x, c = np.ogrid[: out.shape[0], : out.shape[1], : out.shape[2]]
                    weights = 1 + (x * 7 + y * 13 + c * 29) % 101
                sums.append(int(np.multiply(out, weights, dtype=np.int64, casting="unsafe").sum()))
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), pa.array(sums, pa.int64())], ["video_id", "frame_idx", "digest"])

    return frames.mapInArrow(run, "video_id string, frame_idx bigint, digest bigint")


CONTENT = "anime double, blockiness double, darkness double, saturation double"


def content_scores(frames: DataFrame) -> DataFrame:
    """F3-F9 of each frame; null for frames of under 3 pixels a side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = [batch.column(c).to_pylist() for c in ("px", "width", "height")]
            rows = [pixels.content(pixels.frame(px, w, h)) or (None,) * 4 for px, w, h in zip(*cols, strict=True)]
            scores = [pa.array([r[k] for r in rows], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), *scores], ["video_id", "frame_idx", "anime", "blockiness", "darkness", "saturation"])

    return frames.mapInArrow(run, f"video_id string, frame_idx bigint, {CONTENT}")


def classified(scores: DataFrame, videos: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """mean scores of the sampled frames to a recommended model; videos without frames get the default row."""
    means = scores.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("anime", "blockiness", "darkness", "saturation")))
    out = videos.select(*keys).distinct().join(means, list(keys), "left")
    model = F.when(F.col("anime") > 0.6, "ANIME").when(F.col("blockiness") > 0.55, "GENERAL_DENOISE").otherwise("NATURAL")
    return out.withColumns(
        {"recommended": model, "color_fix": F.coalesce((F.col("darkness") > 0.55) | (F.col("saturation") < 0.18), F.lit(False))}
    )


def closest(frames: DataFrame, points: DataFrame, keyed: bool = True) -> DataFrame:
    """A4, A5: for each point (video_id, name, t) the frame closest to its time; ties go to the earlier one.

    keyed: key frames only, if the frames say which these are; raw video has none that are not.
    Aggregated map-side: a video's frames never meet in one place.
    """
    rows = frames.where("is_key") if keyed and "is_key" in frames.columns else frames
    rows = rows.select("video_id", "frame_idx", "pts_us").join(points.select("video_id", "name", "t"), "video_id")
    best = F.min(F.struct(F.abs(F.col("pts_us") - F.col("t")).alias("gap"), "pts_us", "frame_idx")).alias("best")
    return rows.groupBy("video_id", "name").agg(best).select("video_id", "name", "best.frame_idx", "best.pts_us")


def sample_points(frames: DataFrame, videos: DataFrame, shares: Sequence[float] = (0.15, 0.5, 0.85)) -> DataFrame:
    """A4: the key frame closest to each share of the duration."""
    points = videos.select("video_id", F.explode(F.array(*(F.lit(s) for s in shares))).alias("name"), "duration_ms")
    points = points.withColumn("t", F.floor(F.col("duration_ms") * 1000 * F.col("name")).cast("long"))
    return closest(frames, points).withColumnRenamed("name", "share")


def still_points(videos: DataFrame) -> DataFrame:
    """A5: points of each video (video_id, duration_ms, start_ms): its thumbnail, to be taken from key frames, and its preview, from any."""
    names = F.array(F.struct(F.lit("thumbnail").alias("name"), S.thumbnail_us("duration_ms").alias("t")), F.struct(F.lit("preview").alias("name"), S.preview_us("start_ms", "duration_ms").alias("t")))
    return videos.select("video_id", F.explode(names).alias("p")).select("video_id", "p.name", F.col("p.t").cast("long").alias("t"))


def with_skips(df: DataFrame, keys: Sequence[str], order: str, preset: Column | str = "preset") -> DataFrame:
    """A duplicate is skipped in the balanced preset only, and only if an earlier frame has a result to repeat."""
    earlier = F.lag(order).over(Window.partitionBy(*keys).orderBy(order)).isNotNull()
    return df.withColumn("skipped", ((F.col(preset) if isinstance(preset, str) else preset) == "BALANCED") & F.col("is_dup") & earlier)


def counters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frames, and how many of them were skipped and inferred."""
    return df.groupBy(*keys).agg(F.count("*").alias("processed"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped")).alias("inferred"))


def reordered_prefix(df: DataFrame, keys: Sequence[str], order: str, start: int = 0) -> DataFrame:
    """The rows that can be emitted: those without a gap in the order before them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1 + start
    return df.withColumn("_place", place).where(F.col(order) == F.col("_place")).drop("_place")


def motion(frames: DataFrame) -> DataFrame:
    """How each frame moved against the one before it: medians of its dense motion, in pixels; a clip's first frame, and one of another size, has none.

    Frames are dealt by blocks of a clip, so those of one clip spread over all tasks; the last frame of a block goes to the next one as well.
    A task streams its blocks in order and compares some frames at a time, each with the one before it; no side of pixels can be taken for a small one and sent to all.
    """
    block = F.floor(F.col("frame_idx") / FRAMES_AT_ONCE)
    is_last = F.pmod(F.col("frame_idx"), F.lit(FRAMES_AT_ONCE)) == FRAMES_AT_ONCE - 1
    rows = frames.select("video_id", "frame_idx", "width", "height", "px", F.explode(F.when(is_last, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    schema = "video_id string, frame_idx bigint, dx double, dy double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # the frame before; planes of one size, to be compared at once
        for batch in slices(batches):
            ids, found, pairs = [], [], []

            def compared() -> None:
                """Settles the pairs of planes that are held, of which the last one stays."""
                if pairs:
                    moved = flow.flows(np.stack(held), [k - 1 for k, _ in pairs], [k for k, _ in pairs])
                    for (_, at), m in zip(pairs, np.median(moved.reshape(*moved.shape[:2], -1), axis=-1).tolist(), strict=True):  # noqa: B023
                        found[at] = tuple(m)  # noqa: B023
                pairs.clear()  # noqa: B023
                del held[:-1]

            names = ("video_id", "block", "frame_idx", "width", "height", "px")
            for video, block, index, w, h, px in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                before, last = last, (video, index, w, h)
                if before is None or before[2:] != (w, h):
                    compared()
                    held.clear()
                elif len(held) * w * h >= PIXELS_AT_ONCE:
                    compared()
                held.append(pixels.grey(pixels.frame(px, w, h)))
                if index // FRAMES_AT_ONCE != block:
                    continue
                if before == (video, index - 1, w, h):
                    pairs.append((len(held) - 1, len(ids)))
                ids.append((video, index))
                found.append((None, None))
            compared()
            (videos, indices), (dx, dy) = zip(*ids, strict=True) if ids else ((), ()), zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(videos, pa.string()), pa.array(indices, pa.int64()), pa.array(dx, pa.float64()), pa.array(dy, pa.float64())], ["video_id", "frame_idx", "dx", "dy"])

    pairs = dealt(rows, "video_id", "block").sortWithinPartitions("video_id", "block", "frame_idx")
    return pairs.mapInArrow(run, schema)
