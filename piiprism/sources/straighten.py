"""Pages made ready for a reader: straightened by their widest line of print, evened in contrast, and a band for small print.

All in numpy on Arrow batches, an image at a time. A dark line of print is found by what a closing adds to the page
(black hat), its strokes by their slope along the line, and its extent by the connected components of what is left;
the smallest rectangle around the first wide one says by how much the page is turned. The way back is a 2 x 3 matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import images

#: Width at which the print is looked for, the share of the page above the band, and the least turn that counts.
WIDTH, BAND, LEAST = 600, 0.65, 0.5


def extreme(x: np.ndarray, tall: int, wide: int, most: bool = True) -> np.ndarray:
    """The highest or lowest value in a window around each pixel; beyond an edge stands nothing. Windows double, so a
    wide one costs the logarithm of its width."""
    best, worst = (np.maximum, 0) if most else (np.minimum, 255)
    for axis, size in ((0, tall), (1, wide)):
        n, before = x.shape[axis], (size - 1) // 2
        pad = [(before, size) if a == axis else (0, 0) for a in (0, 1)]
        run, have = np.pad(x, pad, constant_values=worst), 1
        part = lambda a, lo, hi, axis=axis: a[lo:hi] if axis == 0 else a[:, lo:hi]
        while have < size:
            step = min(have, size - have)
            long = run.shape[axis] - step
            run, have = best(part(run, 0, long), part(run, step, step + long)), have + step
        x = part(run, 0, n)
    return x


def closed(x: np.ndarray, tall: int, wide: int) -> np.ndarray:
    return extreme(extreme(x, tall, wide), tall, wide, False)


def black_hat(x: np.ndarray, tall: int, wide: int) -> np.ndarray:
    """What is darker than its surroundings, and smaller than the window."""
    return closed(x, tall, wide) - x


def threshold(x: np.ndarray) -> int:
    """The value that parts the pixels into two classes of the least variance within (Otsu)."""
    count = np.bincount(x.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 0


def components(mask: np.ndarray) -> list[np.ndarray]:
    """Connected parts of a mask (neighbours at corners count), the largest first, each as runs (row, first, last): runs of
    a row that touch a run of the row before are united."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, first), last = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
    top = list(range(len(rows)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    begin = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if first[i] <= last[j] + 1 and first[j] <= last[i] + 1:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    parts: dict[int, list[int]] = {}
    for i in range(len(rows)):
        parts.setdefault(root(i), []).append(i)
    runs = np.stack([rows, first, last], axis=1) if len(rows) else np.empty((0, 3), int)
    found = [runs[p] for p in parts.values()]
    return sorted(found, key=lambda r: (-int((r[:, 2] - r[:, 1] + 1).sum()), int(r[0, 0]), int(r[0, 1])))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), in order."""
    order = sorted(map(tuple, np.unique(points, axis=0).tolist()))

    def half(line: list) -> list:
        out: list = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]) or order, float)


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Length, height and angle (degrees, down to the right above zero, at most 45 either way from its longer side's
    axis) of the smallest rectangle around points: one side of it lies on a side of the hull."""
    corners = hull(points)
    if len(corners) < 3:
        d = corners[-1] - corners[0]
        return float(np.hypot(*d)), 0.0, float(np.degrees(np.arctan2(d[1], d[0]))) if d.any() else 0.0
    sides = np.roll(corners, -1, axis=0) - corners
    angles = np.arctan2(sides[:, 1], sides[:, 0])
    best = None
    for a in np.unique(np.round(angles, 12)):
        along = corners @ np.array([np.cos(a), np.sin(a)])
        down = corners @ np.array([-np.sin(a), np.cos(a)])
        w, h = np.ptp(along), np.ptp(down)
        if best is None or w * h < best[0]:
            best = (w * h, w, h, np.degrees(a))
    _, w, h, turn = best
    if h > w:
        w, h, turn = h, w, turn + 90
    turn = (turn + 90) % 180 - 90
    return float(w), float(h), float(turn)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, from the middles of pixels."""
    return sampled(x, (np.arange(width)[None, :] + 0.5) * x.shape[1] / width - 0.5 + np.zeros((height, 1)), (np.arange(height)[:, None] + 0.5) * x.shape[0] / height - 0.5 + np.zeros((1, width)))


def sampled(x: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Values between pixels; beyond an edge stands the edge."""
    h, w = x.shape
    at_x, at_y = np.clip(at_x, 0, w - 1), np.clip(at_y, 0, h - 1)
    i, j = np.minimum(at_y.astype(int), max(h - 2, 0)), np.minimum(at_x.astype(int), max(w - 2, 0))
    dy, dx, down, right = at_y - i, at_x - j, np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    y = x.astype(np.float32)
    out = (y[i, j] * (1 - dx) + y[i, right] * dx) * (1 - dy) + (y[down, j] * (1 - dx) + y[down, right] * dx) * dy
    return np.rint(out).astype(np.uint8)


def turn_matrix(angle: float, width: int, height: int) -> np.ndarray:
    """Where points go when a page is turned by an angle against the clock around its middle."""
    a, b, cx, cy = np.cos(np.radians(angle)), np.sin(np.radians(angle)), width // 2, height // 2
    return np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy]])


def turned(x: np.ndarray, angle: float) -> np.ndarray:
    m = turn_matrix(-angle, x.shape[1], x.shape[0])
    ys, xs = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    return sampled(x, m[0, 0] * xs + m[0, 1] * ys + m[0, 2], m[1, 0] * xs + m[1, 1] * ys + m[1, 2])


def page_angle(gray: np.ndarray) -> float:
    """By how many degrees the widest line of print falls to the right; 0 where there is none."""
    ratio = WIDTH / gray.shape[1]
    small = resized(gray, max(1, int(gray.shape[0] * ratio)), WIDTH)
    dark = black_hat(images.blur(small, 5), 5, 21).astype(np.float32)
    p = np.pad(dark, 1, mode="reflect") if min(dark.shape) > 1 else np.pad(dark, 1)
    slope = np.abs(3 * (p[:-2, 2:] - p[:-2, :-2]) + 10 * (p[1:-1, 2:] - p[1:-1, :-2]) + 3 * (p[2:, 2:] - p[2:, :-2]))
    if np.ptp(slope) == 0:
        return 0.0
    strokes = closed((255 * (slope - slope.min()) / np.ptp(slope)).astype(np.uint8), 5, 21)
    mask = closed(((strokes > threshold(strokes)) * 255).astype(np.uint8), 21, 21)
    for _ in range(2):
        mask = extreme(mask, 3, 3, False)
    for runs in components(mask > 0)[:5]:
        wide, tall = runs[:, 2].max() - runs[:, 1].min() + 1, runs[:, 0].max() - runs[:, 0].min() + 1
        if wide > 3 * tall and wide > WIDTH / 2:
            ends = np.concatenate([runs[:, [1, 0]], runs[:, [2, 0]]])
            turn = smallest_rectangle(ends)[2]
            return turn - 90 if turn > 45 else turn + 90 if turn < -45 else turn
    return 0.0


def evened(x: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast by the ranks of values in tiles, with a limit to how common a value may count; between the middles of
    tiles the four nearest are mixed."""
    h, w = x.shape
    tiles = max(1, min(tiles, h // 8, w // 8))
    ys, xs = np.arange(h) * tiles // h, np.arange(w) * tiles // w
    place = (ys[:, None] * tiles + xs) * 256 + x
    count = np.bincount(place.ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256).astype(float)
    pixels = count.sum(axis=2, keepdims=True)
    most = np.maximum(1, clip * pixels / 256)
    over = np.maximum(count - most, 0).sum(axis=2, keepdims=True)
    table = np.cumsum(np.minimum(count, most) + over / 256, axis=2) * 255 / np.maximum(pixels, 1)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i, j = fy.astype(int), fx.astype(int)
    dy, dx = (fy - i)[:, None], (fx - j)[None, :]
    down, right = np.minimum(i + 1, tiles - 1)[:, None], np.minimum(j + 1, tiles - 1)[None, :]
    i, j = i[:, None], j[None, :]
    out = (table[i, j, x] * (1 - dx) + table[i, right, x] * dx) * (1 - dy) + (table[down, j, x] * (1 - dx) + table[down, right, x] * dx) * dy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gray_of(pixels: np.ndarray) -> np.ndarray:
    """Luminance of BGR pixels, or the one channel."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, c].astype(np.int64) for c in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


PREPARED = "path string, height int, width int, gray binary, band binary, band_top int, angle double, matrix array<array<double>>"


def prepared(pages: DataFrame) -> DataFrame:
    """PREPARED for each image (path, height, width, channels, data): the straightened page in gray, its lower band with dark
    print on white, where the band begins, the angle that was taken out, and the matrix from the straight page back
    to the frame (null where it was straight: under LEAST degrees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, h, w, c, data in zip(*(b.column(n).to_pylist() for n in ("path", "height", "width", "channels", "data")), strict=True):
                gray = gray_of(np.frombuffer(data, np.uint8).reshape(h, w, c))
                angle = page_angle(gray)
                back = None
                if abs(angle) > LEAST:
                    gray, back = turned(gray, angle), turn_matrix(-angle, w, h).tolist()
                gray = evened(gray)
                top = int(h * BAND)
                band = 255 - black_hat(gray[top:], 15, 15)
                out.append({"path": path, "height": h, "width": w, "gray": gray.tobytes(), "band": band.tobytes(), "band_top": top, "angle": float(angle) if back else 0.0, "matrix": back})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("gray", pa.binary()), ("band", pa.binary()), ("band_top", pa.int32()), ("angle", pa.float64()), ("matrix", pa.list_(pa.list_(pa.float64())))]))

    return pages.where("data IS NOT NULL AND height > 0 AND width > 0").select("path", "height", "width", "channels", "data").mapInArrow(run, PREPARED)
