"""Networks against plain loops and the ONNX runtime; dense motion against known shifts and rotations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinetide.functions import flow, nets
from cinetide.functions import pixels as P
from cinetide.operators import frames, tiles
from cinetide.schemas import FRAMES


def seeded(shapes, seed=0, share=0.2):
    rng = np.random.default_rng(seed)
    return {n: (rng.normal(size=s) * share).astype(np.float32) for n, s in shapes.items()}


# ---- plain loops ----


def conv(x, w, b):
    c, h, wd = x.shape
    out = np.zeros((len(w), h, wd))
    for o in range(len(w)):
        for y in range(h):
            for z in range(wd):
                total = float(b[o])
                for i in range(c):
                    for r in range(3):
                        for q in range(3):
                            if 0 <= y + r - 1 < h and 0 <= z + q - 1 < wd:
                                total += float(w[o, i, r, q]) * float(x[i, y + r - 1, z + q - 1])
                out[o, y, z] = total
    return out


def slope(x, s):
    return np.array([[[v if v > 0 else v * float(s[c] if np.ndim(s) else s) for v in row] for row in x[c]] for c in range(len(x))])


def bigger(x, k):
    return np.array([[[x[c, y // k, z // k] for z in range(x.shape[2] * k)] for y in range(x.shape[1] * k)] for c in range(len(x))])


def compact(t, x):
    out = x
    for k in range(1 + max(int(n.split(".")[1]) for n in t)):
        out = conv(out, t[f"body.{k}.weight"], t[f"body.{k}.bias"]) if f"body.{k}.bias" in t else slope(out, t[f"body.{k}.weight"])
    h, w = x.shape[1:]
    big = bigger(x, 4)
    for c in range(3):
        for y in range(4 * h):
            for z in range(4 * w):
                big[c, y, z] += out[c * 16 + y % 4 * 4 + z % 4, y // 4, z // 4]
    return big


def dense(t, x):
    own = lambda v, n: conv(v, t[f"{n}.weight"], t[f"{n}.bias"])
    first = out = own(x, "conv_first")
    for b in range(1 + max(int(n.split(".")[1]) for n in t if n.startswith("body."))):
        inner = out
        for r in (1, 2, 3):
            seen = [inner]
            for k in range(1, 5):
                seen.append(slope(own(np.concatenate(seen), f"body.{b}.rdb{r}.conv{k}"), 0.2))
            inner = own(np.concatenate(seen), f"body.{b}.rdb{r}.conv5") * 0.2 + inner
        out = inner * 0.2 + out
    out = first + own(out, "conv_body")
    for n in ("conv_up1", "conv_up2"):
        out = slope(own(bigger(out, 2), n), 0.2)
    return own(slope(own(out, "conv_hr"), 0.2), "conv_last")


CASES = [(nets.compact_shapes(4, 2), compact), (nets.compact_shapes(2, 0), compact), (nets.dense_shapes(3, 2, 2), dense)]


@pytest.mark.parametrize("shapes,plain", CASES)
def test_networks_equal_loops_and_the_runtime(shapes, plain):
    import onnxruntime

    t = seeded(shapes)
    x = np.random.default_rng(3).random((2, 3, 5, 6)).astype(np.float32)
    got = nets.network(t)(x)
    assert got.shape == (2, 3, 20, 24)
    for k in range(2):
        assert np.allclose(got[k], plain(t, x[k].astype(np.float64)), atol=1e-4)
    model = onnxruntime.InferenceSession(nets.graph(t), providers=["CPUExecutionProvider"])
    assert np.allclose(model.run(None, {"input": x})[0], got, atol=1e-4)
    other = np.random.default_rng(4).random((1, 3, 9, 4)).astype(np.float32)  # sizes are free
    assert np.allclose(model.run(None, {"input": other})[0], nets.network(t)(other), atol=1e-4)


def test_slices_do_not_matter(monkeypatch):
    t = seeded(nets.compact_shapes(4, 1))
    x = np.random.default_rng(3).random((1, 3, 11, 7)).astype(np.float32)
    whole = nets.network(t)(x)
    monkeypatch.setattr(nets, "UNFOLDED", 4 * 4 * 9 * 7 * 2)
    assert np.allclose(nets.network(t)(x), whole, atol=1e-6)


def test_kinds_and_sizes():
    assert nets.kind(nets.compact_shapes()) == "compact" and nets.kind(nets.dense_shapes(4, 2, 2)) == "dense"
    assert nets.blocks(nets.dense_shapes(4, 5, 2)) == 5 and sum(int(np.prod(s)) for s in nets.dense_shapes().values()) == 16_697_987
    with pytest.raises(ValueError):
        nets.kind({"a": 1})


@pytest.fixture(scope="module")
def clip(spark):
    rng = np.random.default_rng(7)
    rows = [("c", i, i * 33_333, 20, 14, rng.integers(0, 256, (14, 20, 3), dtype=np.uint8).tobytes()) for i in range(3)]
    return spark.createDataFrame(rows, FRAMES)


def test_weights_as_a_table_run_in_tasks(spark, clip, tmp_path):
    a, b = (seeded(nets.compact_shapes(4, 1), k, 0.05) for k in (1, 2))
    rows = tiles.blended_weights(tiles.weight_rows(spark, a), tiles.weight_rows(spark, b), 0.5)
    back = tiles.tensors_of(rows)
    assert set(back) == set(a) and all(np.allclose(back[n], (a[n] + b[n]) / 2, atol=1e-7) and back[n].shape == a[n].shape for n in a)
    assert tiles.architecture(rows).first()[0] == 1  # J12 counts the same layers
    local = nets.network(back)
    name = tiles.add_model(rows, "blend", f"file://{tmp_path}/models")
    for kernel in (tiles.net_kernel(rows), tiles.onnx_kernel(name)):
        got = tiles.inferred(clip, kernel, tile=48).orderBy("frame_idx").collect()
        for r, source in zip(got, clip.orderBy("frame_idx").collect(), strict=True):
            expected = tiles.upscaled(P.frame(bytes(source["px"]), 20, 14), local, 48)
            assert np.abs(P.frame(bytes(r["px"]), 80, 56).astype(int) - expected).max() <= 1
    with pytest.raises(ValueError, match="allowed"):
        tiles.tensors_of(rows, 100)
    with pytest.raises(ValueError, match="twice"):
        tiles.tensors_of(rows.union(rows))


def test_the_model_sees_whole_frames(spark):
    """net_as_onnx: digests of whole frames, by the numpy form of the network; a change outside of a corner counts."""
    from cinetide import queries as Q

    small = "/root/testdata/sf0.001"
    net = nets.network(tiles.tensors_of(Q._net_weights(spark, small)))
    whole = lambda rgb: np.rint(net(np.ascontiguousarray(rgb.transpose(2, 0, 1))[None])[0]).astype(np.int64).transpose(1, 2, 0)
    key = lambda df: {(r["video_id"], r["frame_idx"]): r["digest"] for r in df.collect()}
    got = key(Q.net_as_onnx(spark, small))
    assert got == key(frames.digests(Q.part_clips(spark, small), whole)) and len(got) == 200


def test_unknown_models_take_the_general_one(spark, clip):
    repeat = lambda p: p.repeat(4, axis=2).repeat(4, axis=3)
    dark = lambda p: 0 * p.repeat(4, axis=2).repeat(4, axis=3)
    images = clip.withColumn("model", F.element_at(F.array(F.lit("anime"), F.lit("other"), F.lit(None)), (F.col("frame_idx") + 1).cast("int")))
    got = tiles.enhanced(images, {"general": repeat, "anime": dark}, tile=48).orderBy("frame_idx").collect()
    assert [r["model"] for r in got] == ["anime", "general", "general"]
    for r, source in zip(got, clip.orderBy("frame_idx").collect(), strict=True):
        px, x = P.frame(bytes(r["px"]), 80, 56), P.frame(bytes(source["px"]), 20, 14)
        assert (px == (0 if r["model"] == "anime" else x.repeat(4, axis=0).repeat(4, axis=1))).all()
    small = tiles.enhanced(images, {"general": repeat}, scale=2, tile=48).first()
    assert (small["width"], small["height"]) == (40, 28)


# ---- motion ----


def texture(h, w, seed=1):
    return flow.resized(np.random.default_rng(seed).integers(0, 256, (h // 4, w // 4)).astype(float), h, w)


GRID_Y, GRID_X = np.mgrid[0:96, 0:128].astype(float)


@pytest.mark.parametrize("dx,dy", [(0, 0), (2, 0), (3.5, -1.25), (6, 4), (-9, 5), (0.3, 0.7)])
def test_shifts_are_found(dx, dy):
    big = texture(160, 200)
    a, b = flow.sampled(big, GRID_X + 30, GRID_Y + 30), flow.sampled(big, GRID_X + 30 - dx, GRID_Y + 30 - dy)
    error = np.abs(flow.dense_flow(a, b) - np.array([dx, dy]))[12:-12, 12:-12]
    assert error.mean() < 0.05 and np.percentile(error, 98) < 0.2


def test_rotations_are_found():
    big, angle, cx, cy = texture(160, 200), np.deg2rad(3), 64, 48
    turned = lambda s: (np.cos(angle) * (GRID_X - cx) - s * np.sin(angle) * (GRID_Y - cy) + cx, s * np.sin(angle) * (GRID_X - cx) + np.cos(angle) * (GRID_Y - cy) + cy)
    back = turned(-1)
    a, b = flow.sampled(big, GRID_X + 30, GRID_Y + 30), flow.sampled(big, back[0] + 30, back[1] + 30)
    forth = turned(1)
    error = np.abs(flow.dense_flow(a, b) - np.stack([forth[0] - GRID_X, forth[1] - GRID_Y], -1))[12:-12, 12:-12]
    assert np.percentile(error, 98) < 0.2


def test_expansion_is_exact_on_quadratics():
    plane = 2 * GRID_X**2 - 3 * GRID_X * GRID_Y + 0.5 * GRID_Y**2 + 7 * GRID_X - 4
    a, b = flow.expansion(plane)
    inner = (slice(8, -8), slice(8, -8))
    assert np.allclose(a[inner], [2, 0.5, -1.5]) and np.allclose(b[inner][..., 0], (4 * GRID_X - 3 * GRID_Y + 7)[inner]) and np.allclose(b[inner][..., 1], (-3 * GRID_X + GRID_Y)[inner])


def test_sampling_at_edges():
    v = np.arange(4.0)[None, :].repeat(2, axis=0)
    x = np.array([[-1.0, -0.5, 0.0, 1.25, 3.0, 3.5, 4.0, 5.0]])
    assert flow.sampled(v, x, 0 * x).tolist() == [[0, 0, 0, 1.25, 3, 3, 3, 3]]
    assert flow.sampled(v, x, 0 * x, reflect=True).tolist() == [[0, 0, 0, 1.25, 3, 3, 3, 2]]


def test_compensation_follows_motion_and_stops_at_cuts():
    big = np.repeat(texture(160, 200)[..., None], 3, axis=2)
    cut = lambda dx: np.clip(np.rint(big[30:94, 30 - dx : 126 - dx]), 0, 255).astype(np.uint8)
    a, b = cut(0), cut(3)
    followed = P.compensated(b, a.astype(float), b, a)
    assert np.abs(followed - b)[8:-8, 8:-8].mean() < 0.2 < np.abs(a.astype(float) - b)[8:-8, 8:-8].mean()
    noisy = np.clip(b + np.random.default_rng(2).normal(0, 6, b.shape), 0, 255).astype(np.uint8)
    smooth = P.compensated(noisy, a.astype(float), b, a)
    assert np.abs(smooth - b)[8:-8, 8:-8].mean() < 0.75 * np.abs(noisy.astype(float) - b)[8:-8, 8:-8].mean()
    assert (P.compensated(b, 255.0 - b, b, b) == b).all() and (P.compensated(b, None, b, None) == b).all()  # error above 25, and no last frame
    x4 = lambda p: p.repeat(4, axis=0).repeat(4, axis=1)
    assert np.abs(P.compensated(x4(b), x4(a).astype(float), b, a) - x4(b))[32:-32, 32:-32].mean() < 1


@pytest.mark.parametrize("size", [(24, 32), (70, 90), (1, 5)])
def test_many_pairs_at_once_are_as_one_by_one(size, monkeypatch):
    """Each plane is expanded once a level, in one call for all; sides on both sides of MATRIX_SIDE."""
    planes = np.random.default_rng(3).integers(0, 256, (5, *size)).astype(float)
    last, now = [0, 1, 3, 0], [1, 2, 4, 0]
    calls, plain = [], flow._expansions
    monkeypatch.setattr(flow, "_expansions", lambda p: (calls.append(len(p)), plain(p))[1])
    got = flow.flows(planes, last, now)
    assert got.shape == (4, 2, *size) and set(calls) == {5} and len(calls) == (2 if size[0] > 64 else 1) + (size[0] > 64)
    for k, (a, b) in enumerate(zip(last, now, strict=True)):
        assert np.allclose(np.moveaxis(got[k], 0, -1), flow.dense_flow(planes[a], planes[b]), atol=1e-8)
    monkeypatch.setattr(flow, "MATRIX_SIDE", 0)
    assert np.allclose(flow.flows(planes, last, now), got, atol=1e-8)


def test_motion_of_clips(spark):
    big = np.repeat(texture(160, 200)[..., None], 3, axis=2).astype(np.uint8)
    rows = [("c", i, i * 40_000, 96, 64, np.ascontiguousarray(big[30:94, 30 - 2 * i : 126 - 2 * i]).tobytes()) for i in range(4)] + [("d", 0, 0, 5, 4, bytes(60)), ("d", 1, 1, 4, 4, bytes(48))]
    got = {(r["video_id"], r["frame_idx"]): (r["dx"], r["dy"]) for r in frames.motion(spark.createDataFrame(rows, FRAMES)).collect()}
    assert got["c", 0] == got["d", 0] == got["d", 1] == (None, None)
    assert all(abs(got["c", i][0] - 2) < 0.2 and abs(got["c", i][1]) < 0.2 for i in (1, 2, 3))
