"""Dense motion between two grey planes by polynomial expansion, and sampling along it.

After G. Farnebaeck, "Two-frame motion estimation based on polynomial expansion"
(2003): each neighbourhood is fitted by a quadratic polynomial under a Gaussian weight; a
shift of the plane changes the linear coefficients, so the shift follows from them and
is solved by least squares over a window.  Image pyramids give large shifts, and each
level begins with the shift found at the coarser one.  Flows are (height, width, 2)
arrays of (dx, dy) with last(p) = now(p + flow(p)).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Sides up to which a filter along them is a matrix.
MATRIX_SIDE = 64
#: Pyramid: factor between levels, levels besides the full size, least side of a level.
FACTOR, LEVELS, LEAST_SIDE = 0.5, 3, 16
#: Window of the least squares, turns at each level; reach and width of the Gaussian weight.
WINDOW, TURNS = 15, 3
REACH, SIGMA = 5, 1.2


@lru_cache(64)
def _matrix(taps: tuple[float, ...], before: int, size: int) -> np.ndarray:
    """(size, size): correlation with taps, of which so many lie before the place; edges repeat."""
    out = np.zeros((size, size))
    for place in range(size):
        np.add.at(out[place], np.clip(np.arange(len(taps)) + place - before, 0, size - 1), taps)
    return out


def _along(planes: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with taps along one of the last two axes; edges repeat.  Short sides are a product with a matrix."""
    reach, axis, size = len(taps) // 2, axis % planes.ndim, planes.shape[axis]
    if size <= MATRIX_SIDE:
        matrix = _matrix(tuple(taps.tolist()), reach, size)
        return np.matmul(matrix, planes) if axis == planes.ndim - 2 else (planes.reshape(-1, size) @ matrix.T).reshape(planes.shape)
    padded = np.pad(planes, [(reach, reach) if a == axis else (0, 0) for a in range(planes.ndim)], mode="edge")
    front = (slice(None),) * axis
    out = taps[0] * padded[(*front, slice(0, size))]
    part = np.empty_like(out)
    for k in range(1, len(taps)):
        out += np.multiply(padded[(*front, slice(k, k + size))], taps[k], out=part)
    return out


def _expansions(planes: np.ndarray) -> np.ndarray:
    """(5: xx, yy, xy / 2, x, y; n, h, w) of the polynomials around each place of planes (n, h, w)."""
    t = np.arange(-REACH, REACH + 1)
    g = np.exp(-(t**2) / (2 * SIGMA**2))
    g /= g.sum()
    s2, s4 = (g * t**2).sum(), (g * t**4).sum()
    rows = [_along(planes, g * t**k, -2) for k in range(3)]
    moment = lambda x, y: _along(rows[y], g * t**x, -1)
    # 1, x**2 and y**2 are not orthogonal under the weight; the others are
    inverse = np.linalg.inv(np.array([[1, s2, s2], [s2, s4, s2 * s2], [s2, s2 * s2, s4]]))
    even = moment(0, 0), moment(2, 0), moment(0, 2)
    xx, yy = (sum(i * e for i, e in zip(inverse[k], even, strict=True)) for k in (1, 2))
    return np.stack([xx, yy, moment(1, 1) / (s2 * s2) / 2, moment(1, 0) / s2, moment(0, 1) / s2])


def expansion(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A (h, w, 3: xx, yy, xy / 2) and b (h, w, 2) of the polynomial x' A x + b' x + c around each place."""
    out = np.moveaxis(_expansions(plane[None])[:, 0], 0, -1)
    return out[..., :3], out[..., 3:]


def sampled(values: np.ndarray, x: np.ndarray, y: np.ndarray, reflect: bool = False) -> np.ndarray:
    """Values (h, w, ...) at fractional places, bilinear; outside, edges repeat or the plane is mirrored at them."""
    h, w = values.shape[:2]

    def within(i: np.ndarray, n: int) -> np.ndarray:
        if not reflect:
            return np.clip(i, 0, n - 1)
        i = np.mod(i, 2 * n)
        return np.where(i < n, i, 2 * n - 1 - i)

    if not reflect:
        x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    tail = (...,) + (None,) * (values.ndim - 2)
    fx, fy = (x - x0)[tail], (y - y0)[tail]
    left, right, up, down = within(x0, w), within(x0 + 1, w), within(y0, h), within(y0 + 1, h)
    return (values[up, left] * (1 - fx) + values[up, right] * fx) * (1 - fy) + (values[down, left] * (1 - fx) + values[down, right] * fx) * fy


def resized(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sample centres aligned."""
    h, w = values.shape[:2]
    y = (np.arange(height) + 0.5) * h / height - 0.5
    x = (np.arange(width) + 0.5) * w / width - 0.5
    return sampled(values, *(p.astype(np.float64) for p in np.meshgrid(x, y)))


def _all_resized(planes: np.ndarray, height: int, width: int) -> np.ndarray:
    """resized() of planes (..., h, w)."""
    flat = planes.reshape(-1, *planes.shape[-2:])
    return np.ascontiguousarray(np.moveaxis(resized(np.moveaxis(flat, 0, -1), height, width), -1, 0)).reshape(*planes.shape[:-2], height, width)


def _window_means(values: np.ndarray, size: int) -> np.ndarray:
    """Means over windows of size x size of planes (..., h, w); edges repeat."""
    reach = size // 2
    for axis in (values.ndim - 2, values.ndim - 1):
        if values.shape[axis] <= MATRIX_SIDE:
            values = _along(values, np.full(size, 1 / size), axis)
            continue
        padded = np.pad(values, [(reach + 1, reach) if a == axis else (0, 0) for a in range(values.ndim)], mode="edge")
        sums = np.cumsum(padded, axis=axis, out=padded)
        n, front = values.shape[axis], (slice(None),) * axis
        values = sums[(*front, slice(size, size + n))] - sums[(*front, slice(0, n))]
        values /= size
    return values


def _moved(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """sampled() of values (k, n, h, w) at the n planes' own places; edges repeat."""
    k, n, h, w = values.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = x.astype(np.intp), y.astype(np.intp)
    fx, fy = x - x0, y - y0
    gx, gy = 1 - fx, 1 - fy
    up = y0 * w + (np.arange(n) * (h * w))[:, None, None]
    down = np.where(y0 < h - 1, up + w, up)
    right = np.minimum(x0 + 1, w - 1)
    places = up + x0, up + right, down + x0, down + right
    out, held = np.empty_like(values), [np.empty(x.shape) for _ in places]
    for c in range(k):
        a, b, d, e = (np.take(values[c].reshape(-1), p, out=o, mode="clip") for p, o in zip(places, held, strict=True))
        a *= gx
        b *= fx
        a += b
        d *= gx
        e *= fx
        d += e
        a *= gy
        d *= fy
        np.add(a, d, out=out[c])
    return out


def _refined(one: np.ndarray, other: np.ndarray, flow: np.ndarray | None) -> np.ndarray:
    """The flows (2, n, h, w) after one turn; none before the first one."""
    moved = other
    if flow is not None:
        y, x = np.mgrid[0 : flow.shape[2], 0 : flow.shape[3]].astype(np.float64)
        moved = _moved(other, x + flow[0], y + flow[1])
    xx, yy, xy = (one[:3] + moved[:3]) / 2
    dx, dy = (one[3:] - moved[3:]) / 2
    if flow is not None:
        dx += xx * flow[0] + xy * flow[1]
        dy += xy * flow[0] + yy * flow[1]
    products = np.empty(one.shape)
    cross = xy * xy
    np.add(xx * xx, cross, out=products[0])
    np.add(yy * yy, cross, out=products[1])
    np.multiply(xy, xx + yy, out=products[2])
    np.add(xx * dx, xy * dy, out=products[3])
    np.add(xy * dx, yy * dy, out=products[4])
    p, q, r, u, v = _window_means(products, WINDOW)
    det = p * q - r * r + 1e-3  # flat areas stay still
    out = np.empty((2, *det.shape))
    np.divide(q * u - r * v, det, out=out[0])
    np.divide(p * v - r * u, det, out=out[1])
    return out


def flows(planes: np.ndarray, last: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Flows (m, 2: dx, dy; h, w) between m pairs of grey planes (n, h, w) of one size, given by their numbers; each plane is expanded once."""
    planes, last, now = planes.astype(np.float64), np.asarray(last, np.intp), np.asarray(now, np.intp)
    h, w = planes.shape[1:]
    flow = None
    for level in range(LEVELS, -1, -1):
        share = FACTOR**level
        height, width = round(h * share), round(w * share)
        if level and min(height, width) < LEAST_SIDE:
            continue
        small = planes
        if level:
            width_of = (1 / share - 1) * 0.5
            reach = max(1, round(3 * width_of))
            t = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * width_of**2))
            small = _all_resized(_along(_along(planes, t / t.sum(), -2), t / t.sum(), -1), height, width)
        found = _expansions(small)
        one, other = found[:, last], found[:, now]
        if flow is not None:
            flow = _all_resized(flow, height, width) * (np.array([width, height]) / np.array(flow.shape[:1:-1]))[:, None, None, None]
        for _ in range(TURNS):
            flow = _refined(one, other, flow)
    return flow.swapaxes(0, 1)


def dense_flow(last: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Flow from one grey plane to the next."""
    return np.moveaxis(flows(np.stack([last, now]), [0], [1])[0], 0, -1)
