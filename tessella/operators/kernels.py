"""Dense kernels on one raster (NumPy), called batch by batch from Arrow; rounding is half-even."""

from __future__ import annotations

import math
from functools import cache

import numpy as np


def mirrored(a: np.ndarray, pad: int, axis: int) -> np.ndarray:
    """Pads without repeating the edge; an axis of one cell repeats it."""
    if a.shape[axis] == 1:
        return np.repeat(a, 2 * pad + 1, axis=axis)
    widths = [(0, 0)] * a.ndim
    widths[axis] = (pad, pad)
    return np.pad(a, widths, mode="reflect")


def correlate(a: np.ndarray, kernel, axis: int) -> np.ndarray:
    r, n = len(kernel) // 2, a.shape[axis]
    wide = mirrored(a.astype(np.float64), r, axis)
    return sum(k * np.take(wide, range(i, i + n), axis=axis) for i, k in enumerate(kernel) if k)


@cache
def gaussian(size: int, sigma: float) -> tuple[float, ...]:
    if size < 3 or size % 2 == 0:
        raise ValueError("the kernel size must be odd and 3 or more")
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return tuple((k / k.sum()).tolist())


def to_byte(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def blur(a: np.ndarray, size: int = 5, sigma: float = 1.0) -> np.ndarray:
    k = gaussian(size, sigma)
    return to_byte(correlate(correlate(a, k, 1), k, 0))


def median(a: np.ndarray, size: int = 3) -> np.ndarray:
    if size < 3 or size % 2 == 0:
        raise ValueError("the kernel size must be odd and 3 or more")
    wide = mirrored(mirrored(a, size // 2, 0), size // 2, 1)
    view = np.lib.stride_tricks.sliding_window_view(wide, (size, size)).reshape(*a.shape, -1)
    return np.partition(view, size * size // 2, axis=-1)[..., size * size // 2]


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    smooth, step = (1, 2, 1), (-1, 0, 1)
    return correlate(correlate(a, smooth, 0), step, 1), correlate(correlate(a, smooth, 1), step, 0)


def by_peak(a: np.ndarray) -> np.ndarray:
    """Scaled to 255 at the peak, truncated; zero stays zero."""
    peak = a.max(initial=0)
    return (a * (255.0 / peak)).astype(np.uint8) if peak > 0 else np.zeros(a.shape, np.uint8)


def sobel(a: np.ndarray) -> np.ndarray:
    gx, gy = gradient(a)
    return by_peak(np.sqrt(gx * gx + gy * gy))


def sobel_x(a: np.ndarray) -> np.ndarray:
    return by_peak(np.abs(gradient(a)[0]))


def otsu(a: np.ndarray) -> int:
    """Greatest between-class variance in exact integers, the least level on a tie."""
    count = np.bincount(a.ravel(), minlength=256)
    n, m = np.cumsum(count), np.cumsum(count * np.arange(256))
    total, weight = int(n[-1]), int(m[-1])
    best, at = -1.0, 0
    for v in range(256):
        low = int(n[v])
        if 0 < low < total:
            s = (weight * low - total * int(m[v])) ** 2 / (low * (total - low))
            if s > best:
                best, at = s, v
    return at


def threshold(a: np.ndarray, t: int, invert: bool = False) -> np.ndarray:
    return np.where((a <= t) if invert else (a > t), 255, 0).astype(np.uint8)


def clahe(a: np.ndarray, grid: tuple[int, int] = (8, 8), clip: float = 2.0) -> np.ndarray:
    """Tile histograms clipped once; the excess is spread evenly, its rest to the lowest levels."""
    h, w = a.shape
    ty, tx = grid
    th, tw = -(-h // ty), -(-w // tx)
    rows = np.concatenate([np.arange(h), [_reflect(i, h) for i in range(h, th * ty)]]).astype(int)
    cols = np.concatenate([np.arange(w), [_reflect(i, w) for i in range(w, tw * tx)]]).astype(int)
    tiles = a[rows][:, cols].reshape(ty, th, tx, tw).swapaxes(1, 2).reshape(ty * tx, th * tw)
    hist = np.stack([np.bincount(t, minlength=256) for t in tiles])
    limit = max(1, int(clip * th * tw / 256))
    excess = np.maximum(hist - limit, 0).sum(axis=1)
    hist = np.minimum(hist, limit) + (excess // 256)[:, None] + (np.arange(256)[None, :] < (excess % 256)[:, None])
    lut = np.rint(np.cumsum(hist, axis=1) * 255.0 / (th * tw)).reshape(ty, tx, 256)

    def blend(n, size, count):
        at = np.clip(np.arange(n) / size - 0.5, 0, count - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, count - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = blend(h, th, ty), blend(w, tw, tx)
    top = lut[y0[:, None], x0[None, :], a] * (1 - fx) + lut[y0[:, None], x1[None, :], a] * fx
    low = lut[y1[:, None], x0[None, :], a] * (1 - fx) + lut[y1[:, None], x1[None, :], a] * fx
    return to_byte(top * (1 - fy[:, None]) + low * fy[:, None])


def _reflect(i: int, n: int) -> int:
    if n == 1:
        return 0
    i %= 2 * n - 2
    return i if i < n else 2 * n - 2 - i


def slide(a: np.ndarray, size: int, axis: int, most: bool) -> np.ndarray:
    """Sliding max (mirrored) or min (outside is 0) over an odd or even extent."""
    before = size // 2
    widths = [(0, 0)] * 2
    widths[axis] = (before, size - 1 - before)
    if most:
        wide = np.pad(a, widths, mode="reflect" if a.shape[axis] > max(widths[axis]) else "edge")
    else:
        wide = np.pad(a, widths)
    view = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis)
    return view.max(axis=-1) if most else view.min(axis=-1)


def dilate(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return slide(slide(threshold(a, 0), w, 1, True), h, 0, True)


def erode(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return slide(slide(threshold(a, 0), w, 1, False), h, 0, False)


def rect(h: int, w: int) -> np.ndarray:
    if h <= 0 or w <= 0:
        raise ValueError("the element must have a size")
    return np.ones((h, w), bool)


def cross(size: int) -> np.ndarray:
    if size < 3 or size % 2 == 0:
        raise ValueError("a cross has an odd size of 3 or more")
    out = np.zeros((size, size), bool)
    out[size // 2] = out[:, size // 2] = True
    return out


def morph(a: np.ndarray, element: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation (mirrored border) or erosion (0 outside) by any element, centred at size // 2."""
    (eh, ew), (h, w) = element.shape, a.shape
    if not element.any():
        raise ValueError("the element is empty")
    rows = [y - eh // 2 for y in range(h + eh)]
    cols = [x - ew // 2 for x in range(w + ew)]
    flat = threshold(a, 0)
    if grow:
        wide = flat[[_reflect(abs(y), h) for y in rows]][:, [_reflect(abs(x), w) for x in cols]]
    else:
        wide = np.zeros((h + eh, w + ew), np.uint8)
        wide[eh // 2 : eh // 2 + h, ew // 2 : ew // 2 + w] = flat
    parts = [wide[dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(element), strict=True)]
    return np.maximum.reduce(parts) if grow else np.minimum.reduce(parts)


def close(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return erode(dilate(a, h, w), h, w)


def box_dark(a: np.ndarray, size: int, offset: float) -> np.ndarray:
    """255 where a cell is darker than the mean of its window (cut at the border) less offset."""
    if size <= 0 or size % 2 == 0:
        raise ValueError("the window must be odd and positive")
    h, w = a.shape
    r = size // 2
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = a.astype(np.int64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return np.where(a < total / area - offset, 255, 0).astype(np.uint8)


def label(mask: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, int]:
    """Components of the runs of each row, numbered by their first cell in raster order."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    h, w = mask.shape
    edge = np.diff(np.pad((mask > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    root = list(range(len(ys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, first = int(connectivity == 8), np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(root))], int)
    number = np.cumsum(roots == np.arange(len(roots))) if len(roots) else roots
    out = np.zeros((h, w), np.int32)
    for y, a, b, r in zip(ys, starts, ends, roots, strict=True):
        out[y, a:b] = number[r]
    return out, int(number[-1]) if len(roots) else 0


def stats(labels: np.ndarray, n: int) -> list[dict]:
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs] - 1
    area = np.bincount(of, minlength=n)
    low, high = np.full((2, n), 1 << 30), np.full((2, n), -1)
    for k, c in enumerate((xs, ys)):
        np.minimum.at(low[k], of, c)
        np.maximum.at(high[k], of, c)
    cx, cy = (np.bincount(of, weights=c, minlength=n) / np.maximum(area, 1) for c in (xs, ys))
    return [{"label": i + 1, "x": int(low[0, i]), "y": int(low[1, i]), "width": int(high[0, i] - low[0, i] + 1), "height": int(high[1, i] - low[1, i] + 1), "area": int(area[i]), "cx": float(cx[i]), "cy": float(cy[i])} for i in range(n)]


def crop(a: np.ndarray, box, margin: float = 0.08, fill: int = 255) -> np.ndarray:
    x, y, w, h = (int(v) for v in box)
    if w <= 0 or h <= 0 or margin < 0:
        raise ValueError("the box must have a size and the margin may not be negative")
    mx, my = round(w * margin), round(h * margin)
    out = np.full((h + 2 * my, w + 2 * mx), fill, np.uint8)
    y0, x0 = y - my, x - mx
    ya, yb, xa, xb = max(y0, 0), min(y0 + out.shape[0], a.shape[0]), max(x0, 0), min(x0 + out.shape[1], a.shape[1])
    if ya < yb and xa < xb:
        out[ya - y0 : yb - y0, xa - x0 : xb - x0] = a[ya:yb, xa:xb]
    return out


def bilinear(a: np.ndarray, xs: np.ndarray, ys: np.ndarray, fill: float = 255) -> np.ndarray:
    h, w = a.shape
    x0, y0 = np.clip(np.floor(xs), 0, w - 1).astype(int), np.clip(np.floor(ys), 0, h - 1).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = np.clip(xs - x0, 0, 1), np.clip(ys - y0, 0, 1)
    b = a.astype(np.float64)
    out = (b[y0, x0] * (1 - fx) + b[y0, x1] * fx) * (1 - fy) + (b[y1, x0] * (1 - fx) + b[y1, x1] * fx) * fy
    return to_byte(np.where((xs < 0) | (ys < 0) | (xs > w - 1) | (ys > h - 1), fill, out))


def rotate(a: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    if abs(degrees) < 1e-8:
        return a.copy()
    h, w = a.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dy, dx = np.mgrid[0:h, 0:w].astype(float) - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    return bilinear(a, (w - 1) / 2 + c * dx + s * dy, (h - 1) / 2 - s * dx + c * dy, fill)


def resize(a: np.ndarray, shape: tuple[int, int], fill: int = 255) -> np.ndarray:
    if min(shape) <= 0:
        raise ValueError("the target must have a size")
    if a.shape == tuple(shape):
        return a.copy()
    ys, xs = (np.linspace(0, n - 1, m) if m > 1 else np.zeros(1) for n, m in zip(a.shape, shape, strict=True))
    return bilinear(a, *np.broadcast_arrays(xs[None, :], ys[:, None]), fill)


def hough(edges: np.ndarray, thetas: np.ndarray, most: int = 10, near: tuple[int, int] = (6, 2), least: int | None = None) -> list[tuple[float, float, int]]:
    """(rho, theta, votes): peaks by greedy suppression, ties in raster order of (rho, theta)."""
    ys, xs = np.nonzero(edges)
    least = max(8, round(0.05 * min(edges.shape))) if least is None else least
    if not len(ys):
        return []
    reach = math.hypot(*edges.shape)  # bins are whole steps from -reach, which is mostly not whole
    votes = np.zeros((math.ceil(2 * reach) + 1, len(thetas)), np.int64)
    for k, t in enumerate(np.radians(thetas)):
        at = np.rint(np.round(xs * math.cos(t) + ys * math.sin(t) + reach, 9)).astype(int)
        votes[:, k] = np.bincount(at, minlength=len(votes))[: len(votes)]
    out = []
    while len(out) < most:
        r, k = divmod(int(votes.argmax()), len(thetas))
        if votes[r, k] < least or votes[r, k] == 0:
            break
        out.append((r - reach, float(thetas[k]), int(votes[r, k])))
        votes[max(0, r - near[0]) : r + near[0] + 1, max(0, k - near[1]) : k + near[1] + 1] = 0
    return out


def skew(edges: np.ndarray, limit: float = 15.0, step: float = 0.5) -> float:
    thetas = np.arange(90 - limit, 90 + limit + step / 2, step)
    lines = hough(edges, thetas, 5, (6, max(1, round(1 / step))))
    return sum((t - 90) * v for _, t, v in lines) / max(1, sum(v for _, _, v in lines))


def hog(a: np.ndarray, cell: int = 8, block: int = 2, bins: int = 9, eps: float = 1e-6) -> np.ndarray:
    v = np.pad(a / 255.0, 1, mode="edge")
    gx, gy = v[1:-1, 2:] - v[1:-1, :-2], v[2:, 1:-1] - v[:-2, 1:-1]
    size, angle = np.hypot(gx, gy), (np.degrees(np.arctan2(gy, gx)) + 180.0) % 180.0
    ny, nx = a.shape[0] // cell, a.shape[1] // cell
    at = angle / (180.0 / bins)
    low = np.floor(at).astype(int)
    part = at - low
    hist = np.zeros((ny, nx, bins))
    cy, cx = np.mgrid[0 : ny * cell, 0 : nx * cell] // cell
    inside = (slice(0, ny * cell), slice(0, nx * cell))
    np.add.at(hist, (cy, cx, low[inside] % bins), (size * (1 - part))[inside])
    np.add.at(hist, (cy, cx, (low[inside] + 1) % bins), (size * part)[inside])
    if ny < block or nx < block:
        flat = hist.ravel()
        return flat / np.sqrt((flat**2).sum() + eps**2)
    blocks = [hist[i : i + block, j : j + block].ravel() for i in range(ny - block + 1) for j in range(nx - block + 1)]
    return np.concatenate([b / np.sqrt((b**2).sum() + eps**2) for b in blocks])


def zoning(a: np.ndarray, grid: tuple[int, int] = (4, 4), over: int = 127) -> np.ndarray:
    if min(grid) <= 0:
        raise ValueError("the grid must be positive")
    ys, xs = (np.linspace(0, n, g + 1).astype(int) for n, g in zip(a.shape, grid, strict=True))
    return np.array([(a[p:q, r:s] > over).mean() if q > p and s > r else 0.0 for p, q in zip(ys, ys[1:], strict=False) for r, s in zip(xs, xs[1:], strict=False)])


def glyph_features(a: np.ndarray) -> np.ndarray:
    return np.concatenate([hog(a), zoning(a)]).astype(np.float32)


def fit_glyph(mask: np.ndarray, shape: tuple[int, int] = (32, 32)) -> np.ndarray:
    """Tight box, scaled alike in both directions, cut at 127 and centred on zeros."""
    out = np.zeros(shape, np.uint8)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return out
    tight = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    scale = min(shape[0] / tight.shape[0], shape[1] / tight.shape[1])
    h, w = (max(1, min(m, round(n * scale))) for n, m in zip(tight.shape, shape, strict=True))
    small = threshold(resize(threshold(tight, 0), (h, w), 0), 127)
    y, x = (shape[0] - h) // 2, (shape[1] - w) // 2
    out[y : y + h, x : x + w] = small
    return out
