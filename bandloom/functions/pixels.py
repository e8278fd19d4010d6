"""Measures of one image as NumPy arrays (height, width, blue-green-red): helpers of Arrow functions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

DARK, INK = 210, 245  # fixed values: gray below which a pixel is dark, or not background
BAND = 1 << 14  # pixels worked on at a time


def _by_bands(of_band: Callable[[np.ndarray], np.ndarray], bgr: np.ndarray) -> np.ndarray:
    """A byte for each pixel, worked out a band of lines at a time: wide intermediate values stay in the processor's cache."""
    out, step = np.empty(bgr.shape[:2], np.uint8), max(1, BAND // max(1, bgr.shape[1]))
    for y in range(0, len(out), step):
        out[y : y + step] = of_band(bgr[y : y + step])
    return out


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma in fixed point with 14 bits, rounded."""

    def luma(band: np.ndarray) -> np.ndarray:
        blue, green, red = (band[..., i].astype(np.int32) for i in range(3))
        return (1868 * blue + 9617 * green + 4899 * red + (1 << 13)) >> 14

    return _by_bands(luma, bgr)


def saturation(bgr: np.ndarray) -> np.ndarray:
    """255 * (max - min) / max, rounded; 0 for black."""

    def looked_up(band: np.ndarray) -> np.ndarray:
        blue, green, red = (band[..., i] for i in range(3))
        top, low = np.maximum(np.maximum(blue, green), red), np.minimum(np.minimum(blue, green), red)
        return _SATURATION.take(256 * top.astype(np.int64) + low)

    return _by_bands(looked_up, bgr)


def _saturations() -> np.ndarray:
    """Saturation by 256 times the largest of a pixel's three values and the smallest."""
    top, low = np.divmod(np.arange(1 << 16), 256)
    return np.where(low <= top, (255 * (top - low) * 2 + top) // np.maximum(2 * top, 1), 0).astype(np.uint8)


_SATURATION = _saturations()


def _spread(mask: np.ndarray, axis: int, size: int, before: int) -> np.ndarray:
    """Whether any pixel is set from `before` places before each, `size` in all: spans that double, so work grows with the logarithm of size."""
    n, shape = mask.shape[axis], list(mask.shape)
    before, after = max(0, min(before, n - 1)), max(0, min(size - 1 - before, n - 1))  # a window beyond the image sees no more
    size = before + 1 + after
    shape[axis] = before + n + after
    out, span = np.zeros(shape, bool), 1
    out[(slice(None),) * axis + (slice(before, before + n),)] = mask
    while span < size:
        step = min(span, size - span)
        out = out[:-step] | out[step:] if axis == 0 else out[:, :-step] | out[:, step:]
        span += step
    return out


def erode(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose whole window is set; what lies outside the image counts as set. Of an even side the extra pixel lies before the centre."""
    return ~_spread(_spread(~mask, 0, height, height // 2), 1, width, width // 2)


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels with a set pixel in their window. Of an even side the extra pixel lies behind the centre."""
    return _spread(_spread(mask, 0, height, (height - 1) // 2), 1, width, (width - 1) // 2)


def features(bgr: np.ndarray, luma: np.ndarray | None = None) -> tuple[float, float, float, float, float]:
    """Mean saturation, dark share, share of horizontal strokes, and the relative deviation of row and column profiles.

    luma, where it is known, is the image's gray.
    """
    luma = gray(bgr) if luma is None else luma
    dark = luma < DARK
    strokes = dilate(erode(dark, 3, 35), 3, 35)
    ink = 255 - luma
    rows, columns = ink.mean(1), ink.mean(0)
    return float(saturation(bgr).mean()), float(dark.mean()), float(strokes.mean()), float(rows.std() / (rows.mean() + 1e-6)), float(columns.std() / (columns.mean() + 1e-6))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _runs(mask: np.ndarray) -> Runs:
    """Row, first and last column of every run of set pixels, in scan order."""
    framed = np.pad(mask, ((0, 0), (1, 1)))
    row, column = np.divmod(np.flatnonzero(framed[:, 1:] != framed[:, :-1]), mask.shape[1] + 1)  # each row turns on and off in turn
    return row[::2], column[::2], column[1::2] - 1


def _met(row: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int, others: Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first of the others in its row that overlaps it within reach, and the one after the last."""
    other_row, other_begin, other_end = others
    line = width + 2  # no run within a reach of 1 gets into another row
    first = np.searchsorted(other_row * line + other_end, row * line + begin - reach)
    return first, np.searchsorted(other_row * line + other_begin, row * line + end + reach, "right")


def label_runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs with the number of their connected region (the number of its first run).

    All runs work at once: each region joins the first region that it touches, until none touches another. In two rounds
    every region that touches one has joined or been joined, so rounds grow with the logarithm of the runs.
    """
    runs = row, begin, end = _runs(mask)
    first, last = _met(row - 1, begin, end, int(diagonal), runs, mask.shape[1])
    root, met = np.arange(len(row)), last - first
    below = np.repeat(root, met)
    above = np.arange(len(below)) - np.repeat(np.cumsum(met) - last, met)
    while True:
        one, other = root[above], root[below]
        apart = one != other
        if not apart.any():
            return row, begin, end, root
        above, below, one, other = above[apart], below[apart], one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, width and height of each connected region that does not lie in a hole of another, from the bottom up.

    Regions touch over corners too; the order is that of their first pixels in the scan, reversed.
    """
    if not mask.any():
        return []
    lines = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]).any(1)))  # a line like the one above joins the same to the same
    mask, last_of = mask[lines], np.append(lines[1:], len(mask)) - 1
    row, begin, end, region = label_runs(mask, True)
    around = np.pad(~mask, 1, constant_values=True)
    *free, free_region = label_runs(around, False)
    outside = tuple(a[free_region == 0] for a in free)
    seen = np.zeros(len(row), bool)  # runs that the outside touches
    for dy in (0, 1, 2):  # in the frame's rows, the one above, its own and the one below
        first, last = _met(row + dy, begin + 1, end + 1, 1, outside, around.shape[1])
        seen |= last > first
    order = np.argsort(region, kind="stable")
    numbers, at = np.unique(region[order], return_index=True)
    x, right = np.minimum.reduceat(begin[order], at), np.maximum.reduceat(end[order], at)
    y, bottom = lines[row[numbers]], last_of[np.maximum.reduceat(row[order], at)]
    boxes = np.stack([x, y, right - x + 1, bottom - y + 1], 1)[np.logical_or.reduceat(seen[order], at)]
    return [tuple(box) for box in boxes[::-1].tolist()]


def ink_boxes(bgr: np.ndarray, side: int = 45, luma: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes of ink after gaps narrower than side are closed and the result is grown by half of it; luma as of features.

    Growing is all of it: a mask that is grown, shrunk (which closes its gaps) and grown again is the mask grown once.
    """
    return outer_boxes(dilate((gray(bgr) if luma is None else luma) < INK, side, side))


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic kernel with slope -1/2 at 1."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place the old places under the kernel, widened by the scale, and their weights, which sum to 1."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    low = np.maximum((centre - 2 * scale + 0.5).astype(int), 0)
    high = np.minimum((centre + 2 * scale + 0.5).astype(int), old)
    at = low[:, None] + np.arange(int((high - low).max()))
    weight = np.where(at < high[:, None], _cubic((at + 0.5 - centre[:, None]) / scale), 0.0)
    return np.minimum(at, old - 1), weight / weight.sum(1, keepdims=True)


def shrink(bgr: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size by cubic resampling, first along rows, then along columns, rounded after each."""
    out = bgr
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] == size:
            continue
        at, weight = _taps(out.shape[axis], size)
        lines = np.moveaxis(out, axis, 0).astype(np.float32)
        sums = np.zeros((size, *lines.shape[1:]), np.float32)
        for k in range(at.shape[1]):  # a tap at a time: the kernel is a few dozen wide at most
            sums += lines[at[:, k]] * weight[:, k, None, None].astype(np.float32)
        out = np.moveaxis(np.clip(np.floor(sums + 0.5), 0, 255).astype(np.uint8), 0, axis)
    return np.ascontiguousarray(out)


def png(bgr: np.ndarray) -> bytes:
    """An RGB image file of the pixels."""
    height, width = bgr.shape[:2]
    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each line opens with filter 0
    for i in range(3):
        lines[:, 1 + i :: 3] = bgr[..., 2 - i]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
