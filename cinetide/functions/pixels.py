"""Pixel kernels on numpy arrays: pure functions that UDFs call on whole frames.

Frames are (height, width, 3) uint8 RGB.  Integer kernels use the fixed-point
formulas of the inventory exactly, on whole planes at a time: conversions (C1-C3,
C11, C34), resampling (C12, K7), grading and sharpening (C13, C14), thumbnails
(F1), content statistics (F3-F9), blends (K1-K4), temporal filters (G4, G5).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from cinetide.functions import flow

THUMB = 32


def frame(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


# ---- conversions ----


def yuv420_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """BT.601 limited range in 10-bit fixed point; chroma planes have half the size."""
    h, w = y.shape
    spread = lambda p: p.astype(np.int32).repeat(2, axis=0).repeat(2, axis=1)[:h, :w] - 128
    base, cb, cr = 1192 * np.maximum(y.astype(np.int32) - 16, 0), spread(u), spread(v)
    rgb = np.stack([base + 1634 * cr, base - 833 * cr - 400 * cb, base + 2066 * cb], axis=-1) >> 10
    return np.clip(rgb, 0, 255).astype(np.uint8)


def rgb_to_planes(rgb: np.ndarray) -> np.ndarray:
    """Channel-first float32 in 0 to 1."""
    return np.ascontiguousarray(rgb.transpose(2, 0, 1), np.float32) * np.float32(1 / 255)


def planes_to_rgb(planes: np.ndarray) -> np.ndarray:
    """Half is added and the rest cut off towards zero."""
    x = planes * 255.0
    x += 0.5
    return np.clip(x, 0, 255, out=x).astype(np.uint8).transpose(1, 2, 0)


def rgb_to_i420(rgb: np.ndarray) -> bytes:
    """Limited-range planes with half-even rounding; chroma is the mean of 2 x 2 (edges repeat)."""
    x = rgb.astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y = 16 + (65.481 * r + 128.553 * g + 24.966 * b) / 255
    u = 128 + (-37.797 * r - 74.203 * g + 112.0 * b) / 255
    v = 128 + (112.0 * r - 93.786 * g - 18.214 * b) / 255
    h, w = y.shape
    halve = lambda p: np.pad(p, ((0, h % 2), (0, w % 2)), mode="edge").reshape((h + 1) // 2, 2, (w + 1) // 2, 2).mean(axis=(1, 3))
    return b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in (y, halve(u), halve(v)))


def i420_to_rgb(data: bytes, width: int, height: int) -> np.ndarray:
    cw, ch = (width + 1) // 2, (height + 1) // 2
    y = np.frombuffer(data, np.uint8, width * height).reshape(height, width)
    u = np.frombuffer(data, np.uint8, cw * ch, width * height).reshape(ch, cw)
    v = np.frombuffer(data, np.uint8, cw * ch, width * height + cw * ch).reshape(ch, cw)
    return yuv420_to_rgb(y, u, v)


def _weighed(rgb: np.ndarray, weights: tuple[int, int, int]) -> np.ndarray:
    """The weighed sum of the channels; whole numbers have no fast matrix product."""
    out = np.multiply(rgb[..., 0], weights[0], dtype=np.int32)
    for c in (1, 2):
        out += np.multiply(rgb[..., c], weights[c], dtype=np.int32)
    return out


def luma_fast(rgb: np.ndarray) -> np.ndarray:
    return _weighed(rgb, (2, 5, 1)) >> 3


def luma_256(rgb: np.ndarray) -> np.ndarray:
    return _weighed(rgb, (77, 150, 29)) >> 8


# ---- thumbnails and content ----


@lru_cache(64)
def _cells(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.float32(n / np.float32(THUMB))
    lo = (np.arange(THUMB, dtype=np.float32) * step).astype(np.int64)
    hi = np.minimum((np.arange(1, THUMB + 1, dtype=np.float32) * step).astype(np.int64), n)
    return lo, np.maximum(hi, lo + 1)


def thumbnail(rgb: np.ndarray) -> np.ndarray:
    """box means of the fast luma in 32 x 32 cells; every cell has a pixel at least."""
    luma = luma_fast(rgb)
    (y0, y1), (x0, x1) = _cells(luma.shape[0]), _cells(luma.shape[1])
    sums = np.zeros((luma.shape[0] + 1, luma.shape[1] + 1), np.int64)
    luma.cumsum(axis=0, dtype=np.int64).cumsum(axis=1, out=sums[1:, 1:])
    rows = sums[y1] - sums[y0]
    total = rows[:, x1] - rows[:, x0]
    return (total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.float32).ravel()


def content(rgb: np.ndarray) -> tuple[float, float, float, float] | None:
    """(anime, blockiness, darkness, saturation); None for frames without an interior."""
    h, w, _ = rgb.shape
    if w < 3 or h < 3:
        return None
    x = rgb.astype(np.int64)
    luma = (x @ np.array([299, 587, 114])) / 1000.0
    top, bottom = x.max(axis=2), x.min(axis=2)
    sat = np.where(top == 0, 0.0, (top - bottom) / np.maximum(top, 1)).mean()
    dark = 1 - min(max(luma.mean() / 255, 0.0), 1.0)
    bins = np.bincount((((x[..., 0] >> 5) << 6) | ((x[..., 1] >> 5) << 3) | (x[..., 2] >> 5)).ravel(), minlength=512)
    cover = np.cumsum(np.sort(bins)[::-1])
    diversity = (1 + int(np.argmax(cover >= 0.99 * luma.size))) / 512
    gx = np.abs(luma[1:-1, 2:] - luma[1:-1, :-2])
    gy = np.abs(luma[2:, 1:-1] - luma[:-2, 1:-1])
    grad = gx + gy
    some, strong = int((grad > 6).sum()), int((grad > 60).sum())
    on_x = np.broadcast_to(np.arange(1, w - 1) % 8 == 0, gx.shape)
    on_y = np.broadcast_to((np.arange(1, h - 1) % 8 == 0)[:, None], gy.shape)
    edge = np.concatenate([gx[on_x], gy[on_y]])
    inner = np.concatenate([gx[~on_x], gy[~on_y]])
    ratio = edge.mean() / (inner.mean() + 0.5) if len(edge) and len(inner) else 1.0
    unit = lambda v: min(max(float(v), 0.0), 1.0)
    anime = 0.4 * unit(1 - 4 * diversity) + 0.3 * unit(1 - 6 * some / grad.size) + 0.3 * unit(3 * strong / some if some else 0)
    blocky = max(unit((ratio - 1.05) * 2.5), 0.7 * unit((grad.mean() - 14) / 20))
    return anime, blocky, dark, float(sat)


# ---- resampling ----


def bilinear(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """K7: to an exact size, sample centres aligned, edges repeated, rounded half up."""
    h, w, _ = rgb.shape

    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        lo = at.astype(np.int64)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    p = rgb.astype(np.float64)
    rows = p[y0] * (1 - fy)[:, None, None] + p[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _weighted(rgb: np.ndarray, width: int, height: int, reach: int, weight) -> np.ndarray:
    """To an exact size by a kernel of `reach` samples to each side, normalised; edges repeat."""

    def along(p: np.ndarray, size: int) -> np.ndarray:
        at = (np.arange(size) + 0.5) * len(p) / size - 0.5
        lo = np.floor(at).astype(np.int64)
        taps = np.arange(1 - reach, reach + 1)
        w = weight(at[:, None] - (lo[:, None] + taps))
        w /= w.sum(axis=1, keepdims=True)
        places = np.clip(lo[:, None] + taps, 0, len(p) - 1)
        return sum(w[:, k].reshape(-1, *[1] * (p.ndim - 1)) * p[places[:, k]] for k in range(len(taps)))

    return along(along(rgb.astype(np.float64), height).swapaxes(0, 1), width).swapaxes(0, 1)


def cubic(rgb: np.ndarray, width: int, height: int, a: float = -0.75) -> np.ndarray:
    """Cubic convolution over 4 x 4 samples."""

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0.0))

    return np.clip(np.rint(_weighted(rgb, width, height, 2, weight)), 0, 255).astype(np.uint8)


def lanczos(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """K4's resampling: a sinc with a window of four samples to each side, unrounded."""
    return _weighted(rgb, width, height, 4, lambda t: np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0.0))


def area_halved(rgb: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 samples."""
    h, w = rgb.shape[0] // 2, rgb.shape[1] // 2
    return np.rint(rgb[: 2 * h, : 2 * w].reshape(h, 2, w, 2, 3).mean(axis=(1, 3))).astype(np.uint8)


def upsample_x4(rgb: np.ndarray, scale: int) -> np.ndarray:
    """Fixed-point bilinear upsampling by a factor; values are four times the samples (0 to 1020)."""
    h, w, _ = rgb.shape

    def axis(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.maximum(np.arange(n * scale) * 256 // scale - 128, 0)
        return np.minimum(at >> 8, max(n - 2, 0)), at & 255

    y, wy = axis(h)
    x, wx = axis(w)
    y1, x1 = np.minimum(y + 1, h - 1), np.minimum(x + 1, w - 1)
    p, wx, wy = np.ascontiguousarray(rgb.transpose(2, 0, 1), np.int32), wx.astype(np.int32), wy.astype(np.int32)[:, None]
    across = p.take(x, axis=2) * (256 - wx) + p.take(x1, axis=2) * wx  # whole numbers: columns first gives the same
    out = across.take(y, axis=1)
    out *= 256 - wy
    more = across.take(y1, axis=1)
    more *= wy
    out += more
    return np.right_shift(out, 14, out=out).transpose(1, 2, 0)  # in memory channel by channel


# ---- blends ----


def edge_mask(rgb: np.ndarray) -> np.ndarray:
    """K1: gradient of the luma, 60 as full, averaged over 3 x 3; borders are 0."""
    luma = luma_256(rgb)
    h, w = luma.shape
    raw, out = np.zeros((h, w), np.int32), np.zeros((h, w), np.int32)
    if h < 3 or w < 3:
        return out
    raw[1:-1, 1:-1] = (np.abs(luma[1:-1, 2:] - luma[1:-1, :-2]) + np.abs(luma[2:, 1:-1] - luma[:-2, 1:-1])) * 255 // 60
    box = sum(raw[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    out[1:-1, 1:-1] = np.minimum(box // 9, 255)
    return out


def box_blur(plane: np.ndarray, scale: int) -> np.ndarray:
    """K2: rows, then columns, each divided as integers towards zero; edges repeat."""
    r = min(max(2 * scale, 2), 12)
    n = 2 * r + 1
    most = max(abs(int(plane.max(initial=0))), abs(int(plane.min(initial=0)))) * (max(plane.shape) + n)
    whole = np.int32 if most < 2**31 else np.int64

    def along(p: np.ndarray) -> np.ndarray:
        size = len(p)
        sums = np.zeros((size + n, p.shape[1]), whole)  # sums[k]: of the first k of the padded lines
        np.multiply(p[0], np.arange(1, r + 1, dtype=whole)[:, None], out=sums[1 : r + 1], dtype=whole)
        np.cumsum(p, axis=0, dtype=whole, out=sums[r + 1 : r + 1 + size])
        sums[r + 1 : r + 1 + size] += sums[r]
        np.multiply(p[-1], np.arange(1, r + 1, dtype=whole)[:, None], out=sums[r + 1 + size :], dtype=whole)
        sums[r + 1 + size :] += sums[r + size]
        total = sums[n:] - sums[:-n]
        return total // n if total.min(initial=0) >= 0 else np.sign(total) * (np.abs(total) // n)

    return along(np.ascontiguousarray(along(np.ascontiguousarray(plane.T)).T))


def faithful(out: np.ndarray, source: np.ndarray, strength: float) -> np.ndarray:
    """K3, C11: the source's colour and low frequencies with the network's detail, in fixed point times four."""
    if strength <= 0.01:
        return out
    k = min(max(int(strength * 256), 0), 256)
    scale = out.shape[1] // source.shape[1]
    base = upsample_x4(source, scale)
    y_base = luma_256(base)
    cb, cr = ((base[..., 2] - y_base) * 144) >> 8, ((base[..., 0] - y_base) * 183) >> 8
    y_ai = luma_256(out) << 2
    blur = lambda p: box_blur(p, scale).astype(np.int32, copy=False)
    detail, base_detail = y_ai - blur(y_ai), y_base - blur(y_base)
    edge = edge_mask(source).repeat(scale, axis=0).repeat(scale, axis=1)
    weight = 179 + ((77 * edge) >> 8)
    y_new = (y_base - base_detail) + ((detail * weight) >> 8)
    y = (y_new * k + y_ai * (256 - k)) >> 8
    ai = np.ascontiguousarray(out.transpose(2, 0, 1), np.int32).transpose(1, 2, 0) << 2
    mix = lambda mine, raw: (mine * k + raw * (256 - k)) >> 8
    cb, cr = mix(cb, ((ai[..., 2] - y_ai) * 144) >> 8), mix(cr, ((ai[..., 0] - y_ai) * 183) >> 8)
    rgb = np.empty(out.shape, np.uint8)
    for c, plane in enumerate((y + ((cr * 359) >> 8), y - ((cb * 88) >> 8) - ((cr * 183) >> 8), y + ((cb * 454) >> 8))):
        rgb[..., c] = np.clip((plane + 2) >> 2, 0, 255)
    return rgb


def grade(rgb: np.ndarray, mode: str) -> np.ndarray:
    """Contrast about the middle, a share of an S-curve, saturation; floats in 0 to 1."""
    amounts = {"AUTO": (1.12, 1.15), "VIVID": (1.22, 1.35)}.get(mode)
    c = rgb.astype(np.float64) / 255
    if amounts is None:
        return c
    c = (c - 0.5) * amounts[0] + 0.5
    t = np.clip(c, 0, 1)
    c = c * 0.65 + t * t * (3 - 2 * t) * 0.35
    luma = (c @ np.array([0.299, 0.587, 0.114]))[..., None]
    return np.clip(luma * (1 - amounts[1]) + c * amounts[1], 0, 1)


def rendered(rgb: np.ndarray, colour: str, sharpen: float) -> np.ndarray:
    """K6: graded, and sharpened adaptively (C14) against the ungraded neighbours."""
    c = grade(rgb, colour)
    if sharpen > 0.001:
        p = np.pad(rgb.astype(np.float64) / 255, ((1, 1), (1, 1), (0, 0)), mode="edge")
        h, w, _ = rgb.shape
        around = sum(p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))
        high = c - (around + c) / 9
        size = np.sqrt((high**2).sum(axis=-1, keepdims=True))
        step = lambda lo, hi: (lambda t: t * t * (3 - 2 * t))(np.clip((size - lo) / (hi - lo), 0, 1))
        weight = step(0.0, 0.08) * (1 - step(0.25, 0.6))
        c = np.clip(c + high * sharpen * (0.4 + 0.6 * weight), 0, 1)
    return np.floor(c * 255 + 0.5).astype(np.uint8)


def gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of three deviations' radius, mirrored at the edges."""
    r = max(1, int(round(3 * sigma)))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()

    def along(p: np.ndarray) -> np.ndarray:
        index = np.arange(-r, p.shape[1] + r)
        period = max(1, 2 * (p.shape[1] - 1))
        index = np.abs(index) % period
        index = np.where(index >= p.shape[1], period - index, index)
        wide = p[:, index]
        return sum(k * wide[:, i : i + p.shape[1]] for i, k in enumerate(kernel))

    return along(along(plane).T).T


def faithful_float(out: np.ndarray, source: np.ndarray, natural: float) -> np.ndarray:
    """K4: the same idea in floats: Gaussian split at the scale, edge weight from the source's Sobel gradient."""
    if natural <= 0:
        return out.astype(np.float64)
    h, w, _ = out.shape
    scale = w / source.shape[1]
    base = np.clip(lanczos(source, w, h), 0, 255)
    weights = np.array([0.299, 0.587, 0.114])
    y_base, y_ai = base @ weights, out.astype(np.float64) @ weights
    detail = y_ai - gaussian(y_ai, scale)
    low = gaussian(y_base, scale)
    gray = np.pad(source.astype(np.float64) @ weights, 1, mode="reflect" if min(source.shape[:2]) > 1 else "edge")
    gx = (gray[:-2, 2:] + 2 * gray[1:-1, 2:] + gray[2:, 2:]) - (gray[:-2, :-2] + 2 * gray[1:-1, :-2] + gray[2:, :-2])
    gy = (gray[2:, :-2] + 2 * gray[2:, 1:-1] + gray[2:, 2:]) - (gray[:-2, :-2] + 2 * gray[:-2, 1:-1] + gray[:-2, 2:])
    edge = np.clip(gaussian(np.sqrt(gx**2 + gy**2), 1.0) / 30, 0, 1)
    edge = bilinear(np.repeat((edge * 255)[..., None], 3, axis=2).astype(np.uint8), w, h)[..., 0] / 255
    weight = (0.7 + 0.3 * edge) * natural + (1 - natural)
    y = (low + detail * weight) * natural + y_ai * (1 - natural)
    chroma = (base - y_base[..., None]) * natural + (out - y_ai[..., None]) * (1 - natural)
    return np.clip(y[..., None] + chroma, 0, 255)


# ---- temporal ----


def stabilised(out: np.ndarray, last_out: np.ndarray | None, source: np.ndarray, last_source: np.ndarray | None, strength: float) -> np.ndarray:
    """Blends with the previous output where the source stands still; motion of 24 or more is not blended."""
    if last_out is None or last_source is None or strength <= 0.001 or last_out.shape != out.shape:
        return out
    scale = out.shape[1] // source.shape[1]
    motion = np.abs(source.astype(np.int32) - last_source.astype(np.int32)).sum(axis=2)
    alpha = np.where(motion >= 24, 0, int(strength * 256) * (24 - motion) // 24)
    rows = np.minimum(np.arange(out.shape[0]) // scale, source.shape[0] - 1)
    cols = np.minimum(np.arange(out.shape[1]) // scale, source.shape[1] - 1)
    if not alpha.any():
        return out
    a = alpha[rows][:, cols][..., None]
    if 0 <= strength <= 1 and out.dtype == last_out.dtype == np.uint8:  # 255 * 256 fits 16 bits
        h, w, channels = out.shape
        a = a[..., 0].astype(np.uint16).repeat(channels, axis=1)  # a sample each, as loops over channels are short
        return ((out.reshape(h, -1) * (256 - a) + last_out.reshape(h, -1) * a) >> 8).astype(np.uint8).reshape(h, w, channels)
    return ((out.astype(np.int32) * (256 - a) + last_out.astype(np.int32) * a) >> 8).astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def compensated(out: np.ndarray, last_out: np.ndarray | None, source: np.ndarray, last_source: np.ndarray | None) -> np.ndarray:
    """Blends with the previous output moved along the source's motion; none where they differ or at a cut.

    Motion is dense (see flow), found on the sources and brought to the output's size; the previous output
    is sampled at fractional places, mirrored at its edges.
    """
    now = out.astype(np.float64)
    if last_out is None or last_source is None or last_out.shape != out.shape or last_source.shape != source.shape:
        return now
    h, w = out.shape[:2]
    motion = flow.resized(flow.dense_flow(grey(last_source), grey(source)), h, w) * (w / source.shape[1])
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    moved = flow.sampled(last_out.astype(np.float64), x - motion[..., 0], y - motion[..., 1], reflect=True)
    error = np.abs(moved - now).mean(axis=2, keepdims=True)
    alpha = np.clip(1 - error / 18, 0, 1) * 0.55 * (error.mean() <= 25)
    return now * (1 - alpha) + moved * alpha
