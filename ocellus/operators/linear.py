"""Small dense linear algebra on the driver, and products of large matrices with small ones in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hat(v: np.ndarray) -> np.ndarray:
    """The skew matrix H with H @ x = v x x (cross product)."""
    x, y, z = v
    return np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]], float)


def unhat(h: np.ndarray) -> np.ndarray:
    return np.array([h[2, 1], h[0, 2], h[1, 0]], float)


def rotation(v: np.ndarray) -> np.ndarray:
    """The rotation about v by |v| radians."""
    angle = np.linalg.norm(v)
    if angle < 1e-12:
        return np.eye(3) + hat(v)
    k = hat(np.asarray(v) / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """The inverse of ``rotation``, with an angle of pi at most."""
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return unhat((r - r.T) / 2)
    if np.pi - angle < 1e-6:  # the skew part vanishes; the axis is a column of (R + 1) / 2
        m = (r + np.eye(3)) / 2
        axis = m[:, np.argmax(np.diag(m))]
        return angle * axis / np.linalg.norm(axis)
    return angle / (2 * np.sin(angle)) * unhat(r - r.T)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """x with a @ x = b, or None where a is singular."""
    return None if np.linalg.matrix_rank(a) < len(a) else np.linalg.solve(a, b)


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def eigen(a: np.ndarray, b: np.ndarray | None = None, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values descending, vectors as columns) of a symmetric problem a v = l v, or a v = l b v with b positive definite."""
    if b is None:
        values, vectors = np.linalg.eigh(a)
    else:
        inv = np.linalg.inv(np.linalg.cholesky(b))
        values, u = np.linalg.eigh(inv @ a @ inv.T)
        vectors = inv.T @ u
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order]


def hadamard(n: int) -> np.ndarray:
    """An orthogonal matrix of signs; n is a power of two."""
    if n < 1 or n & (n - 1):
        raise ValueError(f"{n} is no power of two")
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def orthogonal(n: int, seed: int = 0) -> np.ndarray:
    """A random orthonormal basis."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def partial_svd(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as rows): the k largest of a tall matrix, by its Gram matrix, one pass."""
    from ocellus.operators.cluster import _partial

    dim = len(rows.head()[vector])
    values, vectors = eigen(_partial(rows, vector, lambda v: v.T @ v, dim), k=k)
    return np.sqrt(np.maximum(values, 0)), vectors.T


def multiplied(rows: DataFrame, vector: str, matrix: np.ndarray, out: str = "product") -> DataFrame:
    """rows with ``out`` = vector @ matrix, by a product on each Arrow batch."""
    names = rows.columns

    def run(batches):
        for b in batches:
            v = np.array(b.column(names.index(vector)).to_pylist(), float).reshape(b.num_rows, matrix.shape[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((v @ matrix).tolist(), pa.list_(pa.float64()))], [*names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<double>"]))


def submatrix(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells (i, j, v) with i and j in half-open ranges, numbered from 0."""
    i, j = F.col("i") - rows[0], F.col("j") - cols[0]
    return cells.filter((F.col("i") >= rows[0]) & (F.col("i") < rows[1]) & (F.col("j") >= cols[0]) & (F.col("j") < cols[1])).select(i.alias("i"), j.alias("j"), "v")


def stacked(top: DataFrame, bottom: DataFrame, height: int) -> DataFrame:
    """Two matrices in long form, the second below the ``height`` rows of the first."""
    return top.select("i", "j", "v").unionByName(bottom.select((F.col("i") + height).alias("i"), "j", "v"))


def centered(cells: DataFrame) -> DataFrame:
    """Columns less their means."""
    means = cells.groupBy("j").agg(F.avg("v").alias("_m"))
    return cells.join(means, "j").select("i", "j", (F.col("v") - F.col("_m")).alias("v"))
