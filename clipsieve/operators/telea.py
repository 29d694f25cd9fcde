"""Filling masked pixels by fast marching: from the border inwards, in order of the distance to it.

The method of A. Telea, "An image inpainting technique based on the fast marching method" (2004). A narrow band of
pixels is kept in a heap by arrival time, the distance to the border of the mask as the eikonal equation gives it. A
pixel is painted when the band reaches it: the mean of the known pixels around it, each carried on along its gradient,
weighted by direction (along the gradient of the arrival time), nearness, and closeness of its level to the pixel's.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: A direction's weight is no smaller than this, so that pixels seen along the front still count.
LEAST = 1e-6
_NEXT = ((-1, 0), (0, -1), (0, 1), (1, 0))


def arrival(up: float, down: float, left: float, right: float) -> float:
    """The time at which the front arrives, from those of the neighbours (infinite if not known)."""
    a, b = min(up, down), min(left, right)
    if abs(a - b) < 1.0:
        return (a + b + math.sqrt(2.0 - (a - b) ** 2)) / 2.0
    return min(a, b) + 1.0


def _march(open_: np.ndarray, time: np.ndarray, band: list[tuple[int, int]], paint=None, stop: float = math.inf) -> None:
    """Moves the front from a band, where time is 0, over open pixels; time is infinite there. Both arrays have a rim."""
    settled = np.zeros(open_.shape, bool)
    heap = [(0.0, y, x) for y, x in sorted(band)]
    while heap:
        t, y, x = heapq.heappop(heap)
        if settled[y, x]:
            continue
        if t > stop:
            return
        settled[y, x] = True
        for dy, dx in _NEXT:
            v, u = y + dy, x + dx
            if settled[v, u] or not (open_[v, u] or 0.0 < time[v, u] < math.inf):
                continue
            near = [time[v + a, u + b] if settled[v + a, u + b] else math.inf for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
            now = arrival(*near)
            if open_[v, u]:
                time[v, u] = now
                if paint is not None:
                    paint(v, u)
                open_[v, u] = False
            elif now < time[v, u]:
                time[v, u] = now
            else:
                continue
            heapq.heappush(heap, (now, v, u))


def _slope(values: np.ndarray, known: np.ndarray, before: tuple, at: tuple, after: tuple) -> np.ndarray:
    """Differences along an axis, from both neighbours, or the known one, or 0."""
    b, a = known[before], known[after]
    wide = (lambda k: k[..., None]) if values.ndim == 3 else (lambda k: k)
    here, low, high = values[at], values[before], values[after]
    return np.where(wide(a & b), (high - low) / 2.0, np.where(wide(a), high - here, np.where(wide(b), here - low, 0.0)))


def telea(image: np.ndarray, mask: np.ndarray, radius: int = 5) -> np.ndarray:
    """An image (h, w, 3) of bytes with the masked pixels (h, w) filled. One that is masked all over stays as it is."""
    mask = mask.astype(bool)
    if not mask.any() or mask.all():
        return image.copy()
    rim = radius + 2
    values = np.pad(image.astype(np.float64), ((rim, rim), (rim, rim), (0, 0)))
    hole = np.pad(mask, rim)
    inside = np.pad(np.ones(mask.shape, bool), rim)
    known = inside & ~hole
    edge = known & (np.roll(hole, 1, 0) | np.roll(hole, -1, 0) | np.roll(hole, 1, 1) | np.roll(hole, -1, 1))
    band = [(int(y), int(x)) for y, x in zip(*np.nonzero(edge), strict=True)]
    # Outwards first: the levels of known pixels are their distances, below 0.
    outside = np.where(known & ~edge, np.inf, 0.0)
    _march(known & ~edge, outside, band, stop=radius + 1)
    time = np.where(hole, np.inf, -np.where(np.isinf(outside), radius + 1.0, outside))
    dy, dx = (a.reshape(-1) for a in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    keep = (dy * dy + dx * dx <= radius * radius) & ((dy != 0) | (dx != 0))
    dy, dx = dy[keep], dx[keep]
    length = dy * dy + dx * dx

    def paint(y: int, x: int) -> None:
        ok = known[y + dy, x + dx]
        ys, xs, ry, rx, square = y + dy[ok], x + dx[ok], -dy[ok], -dx[ok], length[ok]
        gy = float(_slope(time, known, (y - 1, x), (y, x), (y + 1, x)))
        gx = float(_slope(time, known, (y, x - 1), (y, x), (y, x + 1)))
        direction = np.maximum(np.abs(ry * gy + rx * gx) / np.sqrt(square), LEAST)
        weight = direction / square / (1.0 + np.abs(time[ys, xs] - time[y, x]))
        along = _slope(values, known, (ys - 1, xs), (ys, xs), (ys + 1, xs)) * ry[:, None] + _slope(values, known, (ys, xs - 1), (ys, xs), (ys, xs + 1)) * rx[:, None]
        values[y, x] = np.clip((weight[:, None] * (values[ys, xs] + along)).sum(axis=0) / weight.sum(), 0.0, 255.0)
        known[y, x] = True

    _march(hole.copy(), time, band, paint)
    out = image.copy()
    out[mask] = np.rint(values[rim:-rim, rim:-rim][mask]).astype(np.uint8)
    return out
