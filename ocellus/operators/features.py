"""Feature extraction from grey images by numpy: dense gradient descriptors, superpixels, mode seeking, corners.

Each works on one image; ``per_image`` maps them over rows of (path, width, height, pixels) without a shuffle.
Detectors with scale selection (affine-covariant regions, extremal regions) are left to an external
extractor, whose files the sources read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ocellus.operators.images import gradient, smooth


def dense_descriptors(grey: np.ndarray, step: int = 4, cell: int = 4, angles: int = 8, clip: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(centers as x, y; descriptors) on a grid: 4 x 4 cells of ``angles`` gradient directions, unit length, clipped, unit length."""
    size, angle = gradient(grey)
    at = (angle / (2 * np.pi) * angles).astype(int) % angles
    planes = np.zeros((angles, *grey.shape))
    np.put_along_axis(planes, at[None], size[None], 0)
    table = np.pad(planes.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    span = 4 * cell
    ys, xs = np.arange(0, grey.shape[0] - span + 1, step), np.arange(0, grey.shape[1] - span + 1, step)
    if not len(ys) or not len(xs):
        return np.zeros((0, 2)), np.zeros((0, 16 * angles))
    y, x = (g.ravel() for g in np.meshgrid(ys, xs, indexing="ij"))
    parts = []
    for i in range(4):
        for j in range(4):
            a, b = y + i * cell, x + j * cell
            parts.append((table[:, a + cell, b + cell] - table[:, a, b + cell] - table[:, a + cell, b] + table[:, a, b]).T)
    d = np.concatenate(parts, 1)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.column_stack([x, y]) + (span - 1) / 2, unit(np.minimum(unit(d), clip))


def corners(grey: np.ndarray, sigma: float = 1.0, k: float = 0.04) -> np.ndarray:
    """Corner strength: determinant less k times squared trace of the smoothed gradient products."""
    dy, dx = np.gradient(grey.astype(float))
    a, b, c = smooth(dx * dx, sigma), smooth(dy * dy, sigma), smooth(dx * dy, sigma)
    return a * b - c * c - k * (a + b) ** 2


def superpixels(image: np.ndarray, region: int, weight: float, rounds: int = 10) -> np.ndarray:
    """Label of each pixel: k-means in color and place from a grid of ``region`` pixels, each center looking nearby only."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, _ = image.shape
    ys, xs = np.arange(region // 2, h, region), np.arange(region // 2, w, region)
    centers = np.array([[*image[y, x], y, x] for y in ys for x in xs], float)
    grid = np.dstack([image.astype(float), *np.indices((h, w))])
    labels = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, c in enumerate(centers):
            y0, y1, x0, x1 = (int(v) for v in (max(0, c[-2] - region), min(h, c[-2] + region + 1), max(0, c[-1] - region), min(w, c[-1] + region + 1)))
            part = grid[y0:y1, x0:x1] - c
            d = (part[..., :-2] ** 2).sum(-1) + (weight / region) ** 2 * (part[..., -2:] ** 2).sum(-1)
            near = d < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][near] = d[near]
            labels[y0:y1, x0:x1][near] = k
        moved = np.array([grid[labels == k].mean(0) if (labels == k).any() else c for k, c in enumerate(centers)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return labels


def mode_seeking(points: np.ndarray, sigma: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(parents, density): each point's nearest denser point within ``most``, or itself; ties in density by place."""
    d2 = ((points[:, None] - points) ** 2).sum(2)
    density = np.exp(-d2 / (2 * sigma * sigma)).sum(1)
    rank = np.empty(len(points), int)
    rank[np.lexsort((np.arange(len(points)), -density))] = np.arange(len(points))
    higher = np.where((rank[None, :] < rank[:, None]) & (d2 <= most * most), d2, np.inf)
    return np.where(np.isfinite(higher.min(1)), higher.argmin(1), np.arange(len(points))), density


def per_image(images: DataFrame, extract: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """path, feat_id, geom, desc from rows (path, width, height, pixels binary of grey bytes)."""

    def run(batches):
        for b in batches:
            for path, w, h, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                geom, desc = extract(np.frombuffer(data, np.uint8).reshape(h, w).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(desc), pa.string()), pa.array(range(len(desc)), pa.int32()), pa.array(geom.tolist(), pa.list_(pa.float64())), pa.array(desc.tolist(), pa.list_(pa.float64()))], ["path", "feat_id", "geom", "desc"])

    return images.select("path", "width", "height", "pixels").mapInArrow(run, "path string, feat_id int, geom array<double>, desc array<double>")
