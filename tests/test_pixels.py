"""Kernels against small hand-made cases and plain loops over the stated formulas."""

import numpy as np
import pytest

from cinetide.functions import pixels as P
from cinetide.operators import tiles


def noise(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_yuv_by_hand():
    y, u, v = np.array([[16, 235]], np.uint8), np.array([[128]], np.uint8), np.array([[128]], np.uint8)
    assert P.yuv420_to_rgb(y, u, v).tolist() == [[[0, 0, 0], [254, 254, 254]]]  # 1192 * 219 >> 10
    assert P.yuv420_to_rgb(np.array([[100]], np.uint8), np.array([[0]], np.uint8), np.array([[255]], np.uint8)).tolist() == [[[255, 44, 0]]]


def test_lumas_by_hand():
    px = np.array([[[255, 255, 255], [10, 20, 30], [1, 1, 1]]], np.uint8)
    assert P.luma_fast(px).tolist() == [[255, 18, 1]]
    assert P.luma_256(px).tolist() == [[255, 18, 1]]


def test_bytes_round_half_up_and_cut():
    planes = np.array([0.0, 1.0, 0.5, -0.1, 1.2, 127.49 / 255]).reshape(1, 1, 6).repeat(3, axis=0)
    assert P.planes_to_rgb(planes)[0, :, 0].tolist() == [0, 255, 128, 0, 255, 127]
    x = noise(5, 7)
    assert (P.planes_to_rgb(P.rgb_to_planes(x)) == x).all()


@pytest.mark.parametrize("size", [(48, 64), (31, 31), (33, 17), (2, 2), (100, 5)])
def test_thumbnail_is_the_mean_of_cells(size):
    h, w = size
    x = noise(h, w)
    luma = P.luma_fast(x)
    want = []
    for ty in range(32):
        y0 = int(np.float32(ty) * np.float32(h / np.float32(32)))
        y1 = max(min(int(np.float32(ty + 1) * np.float32(h / np.float32(32))), h), y0 + 1)
        for tx in range(32):
            x0 = int(np.float32(tx) * np.float32(w / np.float32(32)))
            x1 = max(min(int(np.float32(tx + 1) * np.float32(w / np.float32(32))), w), x0 + 1)
            want.append(luma[y0:y1, x0:x1].mean())
    assert np.allclose(P.thumbnail(x), want, atol=1e-4)


def test_content():
    assert P.content(noise(2, 9)) is None and P.content(noise(9, 2)) is None
    flat = np.zeros((32, 32, 3), np.uint8)
    anime, blocky, dark, sat = P.content(flat)
    assert (anime, blocky, dark, sat) == (pytest.approx(0.4 * (1 - 4 / 512) + 0.3), 0.0, 1.0, 0.0)
    steps = np.kron(np.random.default_rng(0).integers(0, 2, (8, 8)), np.ones((8, 8))).astype(np.uint8)[..., None].repeat(3, axis=2) * 200
    assert P.content(steps)[1] > P.content(np.roll(steps, (4, 4), axis=(0, 1)))[1]
    assert P.content(noise(40, 40))[1] == pytest.approx(0.7)  # noise counts as blocky to 0.7


def test_edge_mask_by_loops():
    x = noise(7, 9)
    luma = P.luma_256(x)
    raw = np.zeros((7, 9), int)
    for y in range(1, 6):
        for i in range(1, 8):
            raw[y, i] = (abs(luma[y, i + 1] - luma[y, i - 1]) + abs(luma[y + 1, i] - luma[y - 1, i])) * 255 // 60
    want = np.zeros((7, 9), int)
    for y in range(1, 6):
        for i in range(1, 8):
            want[y, i] = min(raw[y - 1 : y + 2, i - 1 : i + 2].sum() // 9, 255)
    assert (P.edge_mask(x) == want).all() and P.edge_mask(noise(2, 2)).sum() == 0


@pytest.mark.parametrize("scale", [1, 2, 4, 9])
def test_box_blur_by_loops(scale):
    plane = np.random.default_rng(3).integers(-500, 1000, (11, 13))
    r = min(max(2 * scale, 2), 12)
    cut = lambda total: int(total / (2 * r + 1))
    rows = np.array([[cut(sum(plane[y, min(max(x + d, 0), 12)] for d in range(-r, r + 1))) for x in range(13)] for y in range(11)])
    want = np.array([[cut(sum(rows[min(max(y + d, 0), 10), x] for d in range(-r, r + 1))) for x in range(13)] for y in range(11)])
    assert (P.box_blur(plane, scale) == want).all()


def test_upsampling_keeps_flat_areas_and_range():
    flat = np.full((5, 6, 3), 77, np.uint8)
    assert (P.upsample_x4(flat, 4) == 308).all()
    big = P.upsample_x4(noise(5, 6), 4)
    assert big.shape == (20, 24, 3) and 0 <= big.min() and big.max() <= 1020
    assert P.upsample_x4(noise(1, 1), 4).shape == (4, 4, 3)


def test_faithful_identity_and_brightness():
    source = noise(12, 16)
    out = P.bilinear(source, 64, 48)
    assert (P.faithful(out, source, 0.01) == out).all()
    brighter = np.clip(out.astype(int) + 40, 0, 255).astype(np.uint8)
    same = P.faithful(brighter, source, 1.0)
    assert abs(float(P.luma_256(same).mean()) - float(P.luma_256(out).mean())) < 3  # the source's brightness returns
    assert np.abs(P.faithful_float(brighter, source, 1.0).mean() - out.mean()) < 3
    assert (P.faithful_float(out, source, 0) == out).all()


@pytest.mark.parametrize("strength", [0.3, 1.0])
def test_faithful_device_blend_by_loops(strength):
    """K3 and C11 sample by sample: fixed-point luma and chroma of four times the samples."""
    source, out = noise(6, 8, 1), noise(24, 32, 2)
    base, k, edges = P.upsample_x4(source, 4).astype(int), int(strength * 256), P.edge_mask(source)
    luma = lambda p: (77 * int(p[0]) + 150 * int(p[1]) + 29 * int(p[2])) >> 8
    y_base = np.array([[luma(base[y, x]) for x in range(32)] for y in range(24)])
    y_ai = np.array([[luma(out[y, x]) << 2 for x in range(32)] for y in range(24)])
    low_base, low_ai = P.box_blur(y_base, 4), P.box_blur(y_ai, 4)
    got = P.faithful(out, source, strength)
    for y in range(24):
        for x in range(32):
            weight = 179 + (77 * int(edges[y // 4, x // 4]) >> 8)
            fresh = low_base[y, x] + ((y_ai[y, x] - low_ai[y, x]) * weight >> 8)
            mixed = lambda mine, raw: int(mine * k + raw * (256 - k)) >> 8
            luma_out = mixed(fresh, y_ai[y, x])
            cb = mixed((base[y, x, 2] - y_base[y, x]) * 144 >> 8, ((int(out[y, x, 2]) << 2) - y_ai[y, x]) * 144 >> 8)
            cr = mixed((base[y, x, 0] - y_base[y, x]) * 183 >> 8, ((int(out[y, x, 0]) << 2) - y_ai[y, x]) * 183 >> 8)
            want = (luma_out + (cr * 359 >> 8), luma_out - (cb * 88 >> 8) - (cr * 183 >> 8), luma_out + (cb * 454 >> 8))
            assert got[y, x].tolist() == [min(max((v + 2) >> 2, 0), 255) for v in want]


def test_faithful_backend_blend_by_loops():
    """K4: low frequencies and chroma of the source's resampling, detail of the output, weighted by the source's edges."""
    source, out, natural = noise(8, 8, 1), noise(32, 32, 2), 0.8
    base, grey = np.clip(P.lanczos(source, 32, 32), 0, 255), source.astype(float) @ [0.299, 0.587, 0.114]
    at = lambda p, y, x: p[[y, -y, 2 * 7 - y][(y < 0) + 2 * (y > 7)], [x, -x, 2 * 7 - x][(x < 0) + 2 * (x > 7)]]
    slope = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            gx = sum(w * (at(grey, y + d, x + 1) - at(grey, y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(grey, y + 1, x + d) - at(grey, y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            slope[y, x] = np.hypot(gx, gy)
    edge = (np.clip(P.gaussian(slope, 1.0) / 30, 0, 1) * 255).astype(np.uint8)
    edge = P.bilinear(np.repeat(edge[..., None], 3, axis=2), 32, 32)[..., 0] / 255
    luma = lambda p: p.astype(float) @ [0.299, 0.587, 0.114]
    y_base, y_ai = luma(base), luma(out)
    low_base, low_ai = P.gaussian(y_base, 4.0), P.gaussian(y_ai, 4.0)
    got = P.faithful_float(out, source, natural)
    for y in range(32):
        for x in range(32):
            weight = (0.7 + 0.3 * edge[y, x]) * natural + 1 - natural
            fresh = (low_base[y, x] + (y_ai[y, x] - low_ai[y, x]) * weight) * natural + y_ai[y, x] * (1 - natural)
            for c in range(3):
                chroma = (base[y, x, c] - y_base[y, x]) * natural + (float(out[y, x, c]) - y_ai[y, x]) * (1 - natural)
                assert abs(got[y, x, c] - min(max(fresh + chroma, 0), 255)) < 1e-9


def test_sharpening_by_loops():
    """C14: against the mean of 3 x 3, stronger on middling detail than on noise or hard edges."""
    rgb, amount = noise(7, 9), 0.7
    got = P.rendered(rgb, "OFF", amount)
    for y in range(7):
        for x in range(9):
            near = [rgb[min(max(y + dy, 0), 6), min(max(x + dx, 0), 8)].astype(float) / 255 for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            own = rgb[y, x] / 255
            high = own - sum(near) / 9
            size = float(np.sqrt((high**2).sum()))
            step = lambda lo, hi: (lambda t: t * t * (3 - 2 * t))(min(max((size - lo) / (hi - lo), 0), 1))  # noqa: B023, E731
            want = np.clip(own + high * amount * (0.4 + 0.6 * step(0, 0.08) * (1 - step(0.25, 0.6))), 0, 1) * 255
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-9


def test_stabiliser_by_loops():
    a, b = noise(3, 4, 1), noise(3, 4, 2)
    b[0] = a[0]
    b[1] = np.clip(a[1].astype(int) + 3, 0, 255)
    now, last = noise(12, 16, 3), noise(12, 16, 4)
    want = now.copy()
    for y in range(12):
        for x in range(16):
            motion = int(np.abs(b[y // 4, x // 4].astype(int) - a[y // 4, x // 4].astype(int)).sum())
            alpha = 0 if motion >= 24 else 128 * (24 - motion) // 24
            for c in range(3):
                want[y, x, c] = (int(now[y, x, c]) * (256 - alpha) + int(last[y, x, c]) * alpha) >> 8
    assert (P.stabilised(now, last, b, a, 0.5) == want).all()
    assert (P.stabilised(now, last, b, a, 0.0) == now).all() and (P.stabilised(now, None, b, None, 0.5) == now).all()


def test_grade_and_render():
    x = noise(6, 6)
    assert (P.rendered(x, "OFF", 0.0) == x).all()
    grey = np.full((4, 4, 3), 128, np.uint8)
    assert np.abs(P.rendered(grey, "VIVID", 0.5).astype(int) - 128).max() <= 2
    edge = np.zeros((6, 6, 3), np.uint8)
    edge[:, 3:] = 200
    assert P.rendered(edge, "OFF", 1.0)[2, 3, 0] > 200


@pytest.mark.parametrize("w", [1, 111, 112, 113, 128, 129, 300])
def test_tiles_put_together_equal_the_whole(w):
    """With a kernel that looks at single pixels only, tiling must not show."""
    x = noise(113, w)
    repeat = lambda p: p.repeat(4, axis=2).repeat(4, axis=3)
    assert (tiles.upscaled(x, repeat) == x.repeat(4, axis=0).repeat(4, axis=1)).all()


def test_tiles_of_the_built_in_kernel_hardly_show():
    x = P.bilinear(noise(12, 20), 200, 120)
    whole = P.planes_to_rgb(tiles.bilinear_kernel(P.rgb_to_planes(x)[None])[0])
    assert np.abs(tiles.upscaled(x, tiles.bilinear_kernel, 64).astype(int) - whole).max() <= 1


def test_kernel_check():
    assert tiles.checked(tiles.bilinear_kernel, 8) is tiles.bilinear_kernel
    with pytest.raises(ValueError):
        tiles.checked(lambda p: p, 8)


def test_i420_round_trip_is_close():
    x = noise(6, 10).repeat(2, axis=0).repeat(2, axis=1)  # as coarse as the chroma planes
    assert np.abs(P.i420_to_rgb(P.rgb_to_i420(x), 20, 12).astype(int) - x).max() <= 4
    assert len(P.rgb_to_i420(noise(5, 7))) == 35 + 2 * 12


def test_resampling_keeps_flat_areas_and_means():
    flat = np.full((6, 9, 3), 140, np.uint8)
    assert (P.cubic(flat, 18, 12) == 140).all() and np.allclose(P.lanczos(flat, 36, 24), 140) and (P.area_halved(flat) == 140).all()
    x = P.bilinear(noise(6, 8), 40, 30)
    assert np.abs(P.area_halved(P.cubic(x, 80, 60)).astype(int) - x).mean() < 4 and abs(P.lanczos(x, 160, 120).mean() - x.mean()) < 1
    assert P.area_halved(noise(5, 7)).shape == (2, 3, 3)
    ramp = np.repeat(np.arange(0, 200, 20, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(8, axis=0)
    assert np.abs(np.diff(P.lanczos(ramp, 40, 32)[16, 10:30, 0]) - 5).max() < 0.6  # straight lines stay straight
