"""Images as rows: HSV histograms of raw pixels, and smoothing, gradients and distances of grey rows.

A row holds one image (bytes, width, height); images are independent, so these are maps without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value in [0, 1] of pixels (n, 3) in 0 .. 255."""
    x = rgb.astype(float) / 255
    top, low = x.max(1), x.min(1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x.T
    hue = np.select([top == low, top == r, top == g], [0 * r, ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
    return np.column_stack([hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top])


def hsv_histogram(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of pixels in bins**3 cells of hue, saturation and value."""
    at = np.minimum((hsv(rgb) * bins).astype(int), bins - 1)
    n = np.bincount((at[:, 0] * bins + at[:, 1]) * bins + at[:, 2], minlength=bins**3)
    return n / max(1, n.sum())


def smooth(grey: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian smoothing, edges extended."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(grey, pad, mode="edge")
        grey = sum(k[i] * np.take(wide, range(i, i + grey.shape[axis]), axis) for i in range(2 * r + 1))
    return grey


def gradient(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Modulus and angle in [0, 2 pi) of central differences."""
    dy, dx = np.gradient(grey.astype(float))
    return np.hypot(dx, dy), np.arctan2(dy, dx) % (2 * np.pi)


def distance_transform(cost: np.ndarray) -> np.ndarray:
    """min over pixels q of cost[q] + |p - q|^2, axis by axis."""
    out = cost.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        gap = (np.arange(n)[:, None] - np.arange(n)) ** 2
        rows = np.moveaxis(out, axis, -1)
        out = np.moveaxis((rows[..., None, :] + gap).min(-1), -1, axis)
    return out


def hog(grey: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Gradient histograms of square cells by undirected angle, each over the length of its 3 x 3 neighbourhood."""
    size, angle = gradient(grey)
    h, w = grey.shape[0] // cell, grey.shape[1] // cell
    at = (angle[: h * cell, : w * cell] % np.pi / np.pi * bins).astype(int) % bins
    rows, cols = np.indices(at.shape)
    out = np.zeros((h, w, bins))
    np.add.at(out, (rows // cell, cols // cell, at), size[: h * cell, : w * cell])
    energy = np.pad((out**2).sum(2), 1)
    near = sum(energy[i : i + h, j : j + w] for i in range(3) for j in range(3))
    return out / np.sqrt(near + 1e-12)[..., None]


def lbp(grey: np.ndarray) -> np.ndarray:
    """Local binary patterns of inner pixels: bit k is set if neighbour k, clockwise from the right, is brighter."""
    c = grey[1:-1, 1:-1]
    h, w = c.shape
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    return sum(((grey[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] > c).astype(np.uint8) << k) for k, (dy, dx) in enumerate(steps))


def frame_histograms(frames: DataFrame, bins: int = 16) -> DataFrame:
    """clip, frame, hist from frames (clip, frame, rgb binary), pixels being three bytes each."""

    def run(batches):
        for b in batches:
            hists = [hsv_histogram(np.frombuffer(x.as_py(), np.uint8).reshape(-1, 3), bins).tolist() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hists, pa.list_(pa.float64()))], ["clip", "frame", "hist"])

    s = frames.schema
    return frames.select("clip", "frame", "rgb").mapInArrow(run, f"clip {s['clip'].dataType.simpleString()}, frame {s['frame'].dataType.simpleString()}, hist array<double>")
