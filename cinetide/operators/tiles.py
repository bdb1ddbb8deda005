"""Tiles, inference and the frame pipeline.

The upscaling kernel is a parameter: any function of (n, 3, T, T) float arrays to
(n, 3, 4T, 4T).  The built-in one is bilinear; `net_kernel` runs a network whose
weights are rows of a table (J9, J10, J13), built once per worker; `onnx_kernel` runs a
model file that is sent with SparkContext.addFile, loaded once per worker.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetide.functions import nets, pixels
from cinetide.functions.scalars import OVERLAP
from cinetide.schemas import FRAMES

SCALE = 4
TILES_AT_ONCE = 16
#: Bytes of results that a task holds before it hands them on; frames of a block of a long scene.
OUT_BYTES, BLOCK_FRAMES = 8 << 20, 64
PRE2_NATURAL, PRE2_HEIGHT = 0.5, 240
Kernel = Callable[[np.ndarray], np.ndarray]


def tile_grid(df: DataFrame, width: str = "width", height: str = "height", tile: int | Column = 128) -> DataFrame:
    """A row per tile: (tile_x, tile_y), the valid rectangle [x0, x1) x [y0, y1) and the input's origin."""
    tile = F.lit(tile) if isinstance(tile, int) else tile
    step = tile - 2 * OVERLAP
    at = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1, step))
    rows = df.where((F.col(width) > 0) & (F.col(height) > 0)).select("*", at(width).alias("x0")).select("*", at(height).alias("y0"))
    origin = lambda start, size: F.least(F.greatest(F.col(start) - OVERLAP, F.lit(0)), F.greatest(F.col(size) - tile, F.lit(0)))
    return rows.withColumns(
        {
            "x1": F.least(F.col("x0") + step, F.col(width)), "y1": F.least(F.col("y0") + step, F.col(height)),
            "origin_x": origin("x0", width), "origin_y": origin("y0", height),
        }
    )


def extracted(rgb: np.ndarray, x: int, y: int, tile: int) -> np.ndarray:
    """A tile's samples; coordinates outside of the frame repeat its edge."""
    rows = np.clip(np.arange(y, y + tile), 0, rgb.shape[0] - 1)
    cols = np.clip(np.arange(x, x + tile), 0, rgb.shape[1] - 1)
    return rgb[rows][:, cols]


def bilinear_kernel(planes: np.ndarray) -> np.ndarray:
    """J3's default: four times the size, sample centres aligned."""
    n, c, h, w = planes.shape

    def axis(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size * SCALE) + 0.5) / SCALE - 0.5, 0, size - 1)
        lo = at.astype(np.int64)
        return lo, np.minimum(lo + 1, size - 1), (at - lo).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = axis(h), axis(w)
    rows = planes.take(y0, axis=2) * (1 - fy)[:, None]
    rows += planes.take(y1, axis=2) * fy[:, None]
    rows = np.ascontiguousarray(rows.swapaxes(2, 3))  # whole lines are taken faster than single samples
    out = rows.take(x0, axis=2)
    out *= (1 - fx)[:, None]
    more = rows.take(x1, axis=2)
    more *= fx[:, None]
    out += more
    return out.swapaxes(2, 3)


def checked(kernel: Kernel, tile: int) -> Kernel:
    """A warm-up run whose shape must be four times the tile."""
    shape = kernel(np.zeros((1, 3, tile, tile), np.float32)).shape
    if shape != (1, 3, SCALE * tile, SCALE * tile):
        raise ValueError(f"the kernel gives {shape} for tiles of {tile}")
    return kernel


#: Bytes of weights that the driver takes and sends to the workers.
WEIGHT_BYTES = 256 << 20
_sessions: dict[str, object] = {}
_networks: dict[str, Kernel] = {}


def tensors_of(weights: DataFrame, most_bytes: int = WEIGHT_BYTES) -> nets.Tensors:
    """The tensors of a table (name, shape, values), fetched once their size is known to fit.

    A name that comes twice, or a shape that its values don't fill, is an error.
    """
    size = 4 * (weights.agg(F.sum(F.size("values"))).first()[0] or 0)
    if size > most_bytes:
        raise ValueError(f"the weights have {size} bytes, {most_bytes} are allowed")
    rows = weights.select("name", "shape", "values").collect()
    out = {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in rows}
    if len(out) < len(rows):
        raise ValueError("a tensor comes twice")
    return out


def weight_rows(spark: SparkSession, tensors: nets.Tensors) -> DataFrame:
    """Tensors as a table (name, shape, values)."""
    rows = [(name, list(t.shape), t.ravel().tolist()) for name, t in tensors.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<float>")


def net_kernel(weights: DataFrame) -> Kernel:
    """The network that a table of weights holds; they are broadcast, and the network is built once per worker."""
    tensors = tensors_of(weights)
    nets.kind(tensors)
    sent, key = weights.sparkSession.sparkContext.broadcast(tensors), uuid.uuid4().hex

    def run(planes: np.ndarray) -> np.ndarray:
        if key not in _networks:
            _networks[key] = nets.network(sent.value)
        return _networks[key](planes)

    return run


def add_model(weights: DataFrame, name: str, folder: str) -> str:
    """The network as an ONNX file `<folder>/<name>.onnx`, sent to the workers; its name for onnx_kernel."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}.onnx") as sink:
        sink.write(nets.graph(tensors_of(weights), name))
    weights.sparkSession.sparkContext.addFile(f"{folder}/{name}.onnx")
    return f"{name}.onnx"


def onnx_kernel(name: str) -> Kernel:
    """A model file added to the session under `name`; CPU provider."""

    def run(planes: np.ndarray) -> np.ndarray:
        import onnxruntime
        from pyspark import SparkFiles

        if name not in _sessions:
            options = onnxruntime.SessionOptions()  # a thread a worker: tasks are what fills the cores
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            _sessions[name] = onnxruntime.InferenceSession(SparkFiles.get(name), options, providers=["CPUExecutionProvider"])
        session = _sessions[name]
        return session.run(None, {session.get_inputs()[0].name: planes})[0]

    return run


def upscaled(rgb: np.ndarray, kernel: Kernel, tile: int = 128) -> np.ndarray:
    """All tiles of a frame through the kernel at once, their valid parts put together."""
    h, w, _ = rgb.shape
    step = tile - 2 * OVERLAP
    out = np.empty((h * SCALE, w * SCALE, 3), np.uint8)
    corners = [(x, y) for y in range(0, h, step) for x in range(0, w, step)]
    origins = [tuple(min(max(v - OVERLAP, 0), max(size - tile, 0)) for v, size in ((x, w), (y, h))) for x, y in corners]
    for at in range(0, len(corners), TILES_AT_ONCE):
        own = origins[at : at + TILES_AT_ONCE]
        big = kernel(np.stack([pixels.rgb_to_planes(extracted(rgb, ox, oy, tile)) for ox, oy in own]))
        for (x, y), (ox, oy), planes in zip(corners[at : at + TILES_AT_ONCE], own, big, strict=True):
            x1, y1 = min(x + step, w), min(y + step, h)
            part = planes[:, (y - oy) * SCALE : (y1 - oy) * SCALE, (x - ox) * SCALE : (x1 - ox) * SCALE]
            out[y * SCALE : y1 * SCALE, x * SCALE : x1 * SCALE] = pixels.planes_to_rgb(part)
    return out


def result_of(source: np.ndarray, kernel: Kernel, tile: int, passes: int = 1, natural: float = 0.0, pre2: bool | None = None, blend: str = "device") -> np.ndarray:
    """One frame through one or two passes and, if natural > 0, the faithful blend: "device" for K3, "backend" for K4.

    pre2 (J8) doubles the frame with cubic weights first and halves the result by area; if not given,
    it is done for natural values of 0.5 or more and frames of at most 240 rows.
    """
    h, w, _ = source.shape
    double = natural >= PRE2_NATURAL and h <= PRE2_HEIGHT if pre2 is None else pre2
    out = pixels.cubic(source, 2 * w, 2 * h) if double else source
    for _ in range(passes):
        out = upscaled(out, kernel, tile)
    if double:
        out = pixels.area_halved(out)
    if blend == "backend":
        return np.clip(np.rint(pixels.faithful_float(out, source, natural)), 0, 255).astype(np.uint8)
    return pixels.faithful(out, source, natural)


def inferred(
    frames: DataFrame, kernel: Kernel = bilinear_kernel, tile: int = 128, passes: int = 1, natural: float = 0.0, pre2: bool | None = False, blend: str = "device"
) -> DataFrame:
    """Frames through result_of(); adds the source as `source`.

    Frames are independent, so this needs no shuffle; a batch's tiles never leave its task.
    """
    schema = FRAMES + ", source binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = checked(kernel, tile)
        for batch in batches:
            sizes = zip(batch.column("px"), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)
            yield from _sliced(batch, (result_of(pixels.frame(px.as_py(), w, h), own, tile, passes, natural, pre2, blend) for px, w, h in sizes), "px")

    return frames.mapInArrow(run, schema)


def enhanced(images: DataFrame, kernels: dict[str, Kernel], scale: int = SCALE, tile: int = 128, fallback: str = "general") -> DataFrame:
    """Single images through the kernel that their column `model` names; a name that is not known, or none, takes the fallback.

    Other scales than four are resampled from the result.
    """
    schema = FRAMES + ", model string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: checked(kernel, tile) for name, kernel in kernels.items()}
        for batch in batches:
            outs, names = [], []
            for px, w, h, model in zip(*(batch.column(c).to_pylist() for c in ("px", "width", "height", "model")), strict=True):
                names.append(model if model in kernels else fallback)
                big = upscaled(pixels.frame(px, w, h), own[names[-1]], tile)
                outs.append(big if scale == SCALE else np.clip(np.rint(pixels.lanczos(big, w * scale, h * scale)), 0, 255).astype(np.uint8))
            part = _frames(batch, outs)
            yield part.append_column("model", pa.array(names, pa.string()))

    return images.select(*(c.split()[0] for c in schema.split(", "))).mapInArrow(run, schema)


def _frames(batch: pa.RecordBatch, outs: list[np.ndarray], source: pa.Array | None = None) -> pa.RecordBatch:
    """A batch with new pixels, and with the source, if any, as a further column."""
    names = ["video_id", "frame_idx", "pts_us", "width", "height", "px"]
    arrays = [*(batch.column(c) for c in names[:3]), pa.array([x.shape[1] for x in outs], pa.int32()), pa.array([x.shape[0] for x in outs], pa.int32())]
    arrays.append(_binary(outs))
    return pa.RecordBatch.from_arrays(arrays if source is None else [*arrays, source], names if source is None else [*names, "source"])


def _binary(outs: list[np.ndarray]) -> pa.Array:
    """Pixels of frames as a column; a single frame is not copied."""
    limits = np.r_[0, np.cumsum([x.nbytes for x in outs])].astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(outs[0]) if len(outs) == 1 else np.concatenate([x.ravel() for x in outs] or [np.empty(0, np.uint8)]))
    return pa.Array.from_buffers(pa.binary(), len(outs), [None, pa.py_buffer(limits.tobytes()), data])


def _sliced(batch: pa.RecordBatch, outs: Iterable[np.ndarray], source: str | None = None) -> Iterator[pa.RecordBatch]:
    """A batch with new pixels, in slices of OUT_BYTES of them or one frame."""
    held, size, start = [], 0, 0

    def part() -> pa.RecordBatch:
        own = batch.slice(start, len(held))
        return _frames(own, held, own.column(source) if source else None)

    for out in outs:
        held.append(out)
        size += out.nbytes
        if size >= OUT_BYTES:
            yield part()
            held, size, start = [], 0, start + len(held)
    if held:
        yield part()


class Filter:
    """The recursive filter; state is the previous output and source, and a new scene begins anew."""

    def __init__(self, strength: float, method: str):
        self.strength, self.method = strength, method
        self.scene = self.last = self.last_source = None

    def shown(self, scene: tuple, now: np.ndarray, source: np.ndarray) -> np.ndarray:
        if scene != self.scene:
            self.scene, self.last, self.last_source = scene, None, None
        if self.method == "motion":
            self.last = pixels.compensated(now, self.last, source, self.last_source)
            out = np.clip(np.rint(self.last), 0, 255).astype(np.uint8)
        else:
            self.last = out = pixels.stabilised(now, self.last, source, self.last_source, self.strength)
        self.last_source = source
        return out


def stabilised(frames: DataFrame, segments: DataFrame, strength: float = 0.5, method: str = "device") -> DataFrame:
    """The recursive filter along each scene; state is the previous output, and a cut begins anew.

    frames: inferred() frames; segments: (video_id, frame_idx, segment, width, height of the source).
    Sorted partitions are streamed, so a task holds one frame of state.
    method: "device" for G4, "motion" for G5.
    """
    sizes = segments.select("video_id", "frame_idx", "segment", F.col("width").alias("sw"), F.col("height").alias("sh"))
    rows = frames.join(sizes.hint("merge"), ["video_id", "frame_idx"])  # a row a frame: never to be sent to all

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(strength, method)
        for batch in batches:
            names = ("video_id", "segment", "width", "height", "sw", "sh", "px", "source")
            rows = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            yield from _sliced(batch, (own.shown((video, segment), pixels.frame(px, w, h), pixels.frame(raw, sw, sh)) for video, segment, w, h, sw, sh, px, raw in rows))

    return rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_idx").mapInArrow(run, FRAMES)


def rendered(frames: DataFrame, colour: str = "OFF", sharpen: float = 0.0, size: tuple[int, int] | None = None) -> DataFrame:
    """K6, K7: graded, sharpened and brought to an exact size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = []
            for px, w, h in zip(batch.column("px").to_pylist(), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True):
                x = pixels.rendered(pixels.frame(px, w, h), colour, sharpen)
                outs.append(x if size is None else pixels.bilinear(x, *size))
            yield _frames(batch, outs)

    return frames.select("video_id", "frame_idx", "pts_us", "width", "height", "px").mapInArrow(run, FRAMES)


def cropped(frames: DataFrame, size: int = 96) -> DataFrame:
    """A5: the centred square of at most `size` pixels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = []
            for px, w, h in zip(batch.column("px").to_pylist(), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True):
                cw, ch = min(size, w), min(size, h)
                x, y = (w - cw) // 2, (h - ch) // 2
                outs.append(pixels.frame(px, w, h)[y : y + ch, x : x + cw])
            yield _frames(batch, outs)

    return frames.select("video_id", "frame_idx", "pts_us", "width", "height", "px").mapInArrow(run, FRAMES)


def blended_weights(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    """Tensors (name, values) interpolated element by element."""
    other = b.select("name", F.col("values").alias("other"))
    mixed = F.zip_with("values", "other", lambda x, y: (x * F.lit(share) + y * F.lit(1 - share)).cast("float"))
    return a.join(other, "name").select(*(c for c in a.columns if c != "values"), mixed.alias("values"))


def architecture(names: DataFrame, name: str = "name") -> DataFrame:
    """The number of convolutions, from the last layer's number in tensor names like body.<n>.weight."""
    last = F.max(F.split_part(F.col(name), F.lit("."), F.lit(2)).try_cast("int"))
    return names.agg(F.floor((last - 2) / 2).cast("int").alias("num_conv"))


def processed(
    frames: DataFrame, analysis: DataFrame, kernel: Kernel = bilinear_kernel, tile: int = 128, strength: float = 0.5, natural: float = 1.0, skip: bool = True, method: str = "device",
    folder: str | None = None,
) -> DataFrame:
    """The whole of it: inference on roots, their results for the duplicates that follow, temporal filter.

    Source frames meet their flags by a join and are then dealt by scene and sorted; only source pixels
    travel, once for each of the two, and results, sixteen times their size, never do.  A duplicate
    follows its root within its scene, so the last root's result is all that sharing needs.

    Without a folder all is one stream, and a scene, however long, is one task.  With a folder that all tasks
    share, inference comes first, in blocks of BLOCK_FRAMES frames that are dealt one by one, so a clip without
    cuts keeps all cores busy; a block's results are a file there, whatever scenes it holds.  The second pass, a task
    a scene, is the recursion alone: it opens the blocks of its scene in order.  Both ways give the same bits.
    """
    flags = analysis.select("video_id", "frame_idx", "is_dup", "segment")
    rows = frames.join(flags.hint("merge"), ["video_id", "frame_idx"])
    by_scene = rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_idx")
    if folder is not None:
        _inferred_blocks(rows.where(~F.col("is_dup") | F.lit(not skip)), folder, kernel, tile, natural)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filter_ = checked(kernel, tile) if folder is None else None, Filter(strength, method)
        blocks = Blocks(folder) if folder is not None else None
        result = source = None

        def shown(part: pa.RecordBatch) -> Iterator[np.ndarray]:
            nonlocal result, source
            names = ("video_id", "segment", "frame_idx", "is_dup", "width", "height", "px")
            for video, segment, index, dup, w, h, px in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                if not (dup and skip) or result is None:
                    source = pixels.frame(px, w, h)
                    result = result_of(source, own, tile, natural=natural, pre2=False) if blocks is None else blocks.result(video, index)
                yield filter_.shown((video, segment), result, source)

        for batch in batches:
            yield from _sliced(batch, shown(batch))

    return by_scene.mapInArrow(run, FRAMES)


def _block_path(folder: str, video: str, block: int) -> str:
    return f"{folder}/{hashlib.sha256(video.encode()).hexdigest()[:32]}-{block}.arrow"


def _inferred_blocks(roots: DataFrame, folder: str, kernel: Kernel, tile: int, natural: float) -> None:
    """Writes the results of each block of each video as a file: a batch a frame, then one that lists the frames.

    Short scenes share a file.  A file gets its name when it is whole, and a repeated task writes the same.
    """
    block = F.floor(F.col("frame_idx") / BLOCK_FRAMES).alias("block")
    rows = roots.select("video_id", "frame_idx", "width", "height", "px", block)
    keys = ("video_id", "block")
    schema = pa.schema([("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("px", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own, open_key, sink, file, done, indices = checked(kernel, tile), None, None, None, [], []

        def close() -> None:
            if file is not None:
                n = len(indices)
                file.write(pa.record_batch([pa.array(indices, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([b""] * n, pa.binary())], schema=schema))
                indices.clear()
                file.close()
                sink.close()
                if fs.get_file_info(_block_path(root, *open_key)).type == pafs.FileType.NotFound:
                    fs.move(f"{root}/_{token}", _block_path(root, *open_key))
                else:
                    fs.delete_file(f"{root}/_{token}")
                done.append(open_key)

        for batch in batches:
            names = (*keys, "frame_idx", "width", "height", "px")
            for video, number, index, w, h, px in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (video, number) != open_key:
                    close()
                    open_key, token = (video, number), uuid.uuid4().hex
                    sink = fs.open_output_stream(f"{root}/_{token}")
                    file = pa.ipc.new_file(sink, schema)
                out = result_of(pixels.frame(px, w, h), own, tile, natural=natural, pre2=False)
                indices.append(index)
                file.write(pa.record_batch([pa.array([index]), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[0]], pa.int32()), _binary([out])], schema=schema))
        close()
        columns = list(zip(*done, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], list(keys))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "frame_idx")
    dealt.mapInArrow(run, "video_id string, block bigint").write.format("noop").mode("overwrite").save()


class Blocks:
    """Results of blocks by their frames: one file is open, and one frame is held at a time."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.key = self.source = None

    def result(self, video: str, index: int) -> np.ndarray:
        key = (video, index // BLOCK_FRAMES)
        if key != self.key:
            if self.source is not None:
                self.source.close()
            self.source = self.fs.open_input_file(_block_path(self.root, *key))
            self.reader, self.key = pa.ipc.open_file(self.source), key
            listed = self.reader.get_batch(self.reader.num_record_batches - 1).column("frame_idx").to_pylist()
            self.places = {i: k for k, i in enumerate(listed)}
        if index not in self.places:
            raise KeyError(f"no result of frame {index} of {video}")
        batch = self.reader.get_batch(self.places[index])
        w, h = (batch.column(c)[0].as_py() for c in ("width", "height"))
        return np.frombuffer(batch.column("px").buffers()[2], np.uint8)[: w * h * 3].reshape(h, w, 3)
