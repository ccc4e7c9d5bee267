"""Model fitting: k-means, diagonal Gaussian mixtures, hierarchical k-means, hashed-cell neighbours, PCA, spectral.

Data stay in Spark; each round is one pass whose per-cluster sums are combined map-side, and only the
model, of a size that doesn't depend on the data, is on the driver.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sample(rows: DataFrame, vector: str, n: int, seed: int) -> np.ndarray:
    """About n rows' vectors (all, if there are fewer), by hash of the vector and seed."""
    count = rows.count()
    chosen = rows if count <= n else rows.filter(F.pmod(F.xxhash64(F.col(vector), F.lit(seed)), F.lit(count)) < n)
    return np.array([r[0] for r in chosen.select(vector).limit(4 * n).collect()], float)


def spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a chance in proportion to its squared distance to those before."""
    centers = [x[rng.integers(len(x))]]
    d = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centers)], "k int, mu array<double>")


def _partial(rows: DataFrame, vector: str, assign, width: int) -> np.ndarray:
    """Sum over all rows of assign(x) (a K x width array for an Arrow batch), added up batch by batch in Spark."""

    from ocellus.operators.neighbours import matrix

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = assign(matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], ["k", "s"])

    sums = rows.select(vector).mapInArrow(run, "k int, s array<double>").select("k", F.posexplode("s").alias("j", "s")).groupBy("k", "j").agg(F.sum("s").alias("s"))
    out: dict[tuple[int, int], float] = {(r["k"], r["j"]): r["s"] for r in sums.collect()}
    n = 1 + max((k for k, _ in out), default=-1)
    return np.array([[out.get((k, j), 0.0) for j in range(width)] for k in range(n)])


def kmeans(rows: DataFrame, k: int, vector: str = "d", rounds: int = 20, redo: int = 1, seed: int = 0, tolerance: float = 1e-9, spread: bool = True, unit: bool = False, metric: str = "l2", initial: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(centers, mean squared distance) of the best of ``redo`` runs of Lloyd's rounds.

    Seeds come from a bounded sample, spread by squared distance or uniform. An empty cluster takes half
    of the largest: its center a little to either side. A run stops when the error falls by less than
    ``tolerance`` of itself. ``unit`` normalises centers. ``initial``: centers to begin with.
    ``metric`` l1 assigns by absolute distance and takes medians, exactly, by one grouped percentile;
    chi2 assigns by the chi-squared distance of non-negative vectors and takes means. Both need not the
    squared error's sums, so the mean distance is what falls.
    """
    best: tuple[np.ndarray, float] | None = None
    for run in range(redo):
        rng = np.random.default_rng(seed + run)
        x = _sample(rows, vector, max(2000, 50 * k), seed + run)
        centers = np.array(initial, float) if initial is not None else spread_seeds(x, k, rng) if spread else x[rng.permutation(len(x))[:k]]
        error, dim = math.inf, x.shape[1]
        for _ in range(rounds):

            def assign(v, c=centers):
                d = _to_centers(v, c, metric)
                own = d.argmin(1)
                out = np.zeros((len(c), dim + 2))
                np.add.at(out, own, np.column_stack([v, np.ones(len(v)), np.maximum(d[np.arange(len(v)), own], 0)]))
                return out

            sums = _partial(rows, vector, assign, dim + 2)
            n, now = sums[:, dim], sums[:, dim + 1].sum() / max(1, sums[:, dim].sum())
            old, centers = centers, np.where(n[:, None] > 0, sums[:, :dim] / np.maximum(n, 1)[:, None], centers)
            if metric == "l1":
                centers = _medians(rows, vector, old, centers)
            for e in np.flatnonzero(n == 0):
                big = int(n.argmax())
                centers[e], centers[big] = centers[big] * (1 + 1e-4), centers[big] * (1 - 1e-4)
                n[e], n[big] = n[big] // 2, n[big] - n[big] // 2
            if unit:
                centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
            if error - now <= tolerance * abs(error) and error < math.inf:
                error = min(error, now)
                break
            error = now
        if best is None or error < best[1]:
            best = (centers, float(error))
    return best


def _to_centers(v: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to each center."""
    if metric == "l1":
        return np.abs(v[:, None] - c).sum(2)
    if metric == "chi2":
        both = v[:, None] + c
        return np.divide((v[:, None] - c) ** 2, both, out=np.zeros_like(both), where=both != 0).sum(2)
    return (v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)


def _medians(rows: DataFrame, vector: str, centers: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Median of each cluster's elements, by absolute distance to ``centers``; ``default`` for empty clusters."""

    def assign(batches):
        for b in batches:
            if b.num_rows:
                own = _to_centers(np.array(b.column(0).to_pylist(), float), centers, "l1").argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0)], ["k", "v"])

    long = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(assign, "k int, v array<double>").select("k", F.posexplode("v").alias("j", "x"))
    out = default.copy()
    for r in long.groupBy("k", "j").agg(F.expr("percentile(x, 0.5)").alias("m")).collect():
        out[r["k"], r["j"]] = r["m"]
    return out


def ikmeans(rows: DataFrame, k: int, vector: str = "d", rounds: int = 20, seed: int = 0, initial: np.ndarray | None = None) -> np.ndarray:
    """Integer centers (k x length, or fewer if there are fewer different rows) of vectors of integers.

    Lloyd's rounds until no center moves: a center is its rows' mean, rounded down; ties go to the
    smaller center, and a center without rows stays. Distances are exact below 2**53.
    """
    if initial is None:
        x = np.unique(_sample(rows, vector, 1000 * k, seed), axis=0)
        initial = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))]
    centers = np.array(initial, np.int64)
    for _ in range(rounds):

        def assign(v, c=centers.astype(float)):
            out = np.zeros((len(c), c.shape[1] + 1))
            np.add.at(out, _to_centers(v, c, "l2").argmin(1), np.column_stack([v, np.ones(len(v))]))
            return out

        s = _partial(rows, vector, assign, centers.shape[1] + 1)
        moved = np.where(s[:, -1:] > 0, np.floor(s[:, :-1] / np.maximum(s[:, -1:], 1)), centers).astype(np.int64)
        if (moved == centers).all():
            break
        centers = moved
    return centers


def first_vectors(rows: DataFrame, key: str, k: int, vector: str = "d", start: int = 0) -> np.ndarray:
    """The vectors of the k rows with the least keys of at least ``start``: centers that don't depend on chance."""
    return np.array([r[0] for r in rows.filter(F.col(key) >= start).orderBy(key).limit(k).select(vector).collect()], float)


def gmm_fit(rows: DataFrame, k: int, vector: str = "d", rounds: int = 20, seed: int = 0, floor: float = 1e-10, tolerance: float = 1e-5, initial: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, means, variances, mean log likelihood) of a diagonal mixture, by EM from k-means centers or from ``initial``."""
    if initial is None:
        mu, error = kmeans(rows, k, vector, rounds=5, seed=seed)
        w, sigma = np.full(k, 1 / k), np.full(mu.shape, max(error / mu.shape[1], floor))
    else:
        w, mu, sigma = (np.array(x, float) for x in initial)
    dim, last = mu.shape[1], -math.inf
    for _ in range(rounds):

        def expect(v, w=w, mu=mu, sigma=sigma):
            log = np.log(w) - 0.5 * (dim * math.log(2 * math.pi) + np.log(sigma).sum(1) + (mu * mu / sigma).sum(1)) + v @ (mu / sigma).T - 0.5 * (v * v) @ (1 / sigma).T
            top = log.max(1, keepdims=True)
            p = np.exp(log - top)
            s = p.sum(1, keepdims=True)
            out = np.column_stack([(p / s).T @ v, (p / s).T @ (v * v), (p / s).sum(0), np.zeros(k)])
            out[0, -1] = (top + np.log(s)).sum()
            return out

        s = _partial(rows, vector, expect, 2 * dim + 2)
        n, total = s[:, 2 * dim], s[:, 2 * dim].sum()
        ll = s[0, -1] / total
        some = n > 1e-9
        mu = np.where(some[:, None], s[:, :dim] / np.maximum(n, 1e-9)[:, None], mu)
        sigma = np.where(some[:, None], np.maximum(s[:, dim : 2 * dim] / np.maximum(n, 1e-9)[:, None] - mu * mu, floor), sigma)
        w = np.maximum(n / total, 1e-12)
        if last > -math.inf and ll - last <= tolerance * abs(last):
            last = ll
            break
        last = ll
    return w, mu, sigma, float(last)


def gmm_frame(spark: SparkSession, w: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, float(w[k]), mu[k].tolist(), sigma[k].tolist()) for k in range(len(w))], "k int, w double, mu array<double>, sigma array<double>")


def hkm_fit(rows: DataFrame, levels: int, branch: int, vector: str = "d", rounds: int = 10, seed: int = 0, integer: bool = False) -> list[np.ndarray]:
    """Centers of a tree with ``branch`` children a node: one array of branch**(level + 1) centers a level.

    integer: the vectors have integers, and so have the centers, rounded down.

    All nodes of a level are fitted in the same passes, each on the rows that the levels above send it.
    """
    x = _sample(rows, vector, 2000 * branch, seed)
    tree: list[np.ndarray] = []
    for level in range(levels):
        rng, parents = np.random.default_rng(seed + level), branch**level
        own = hkm_paths(tree, x, branch)
        centers = np.concatenate([spread_seeds(x[own == p] if (own == p).any() else x, branch, rng) for p in range(parents)])
        for _ in range(rounds):

            def assign(v, c=centers, t=tuple(tree)):
                at = _child(v, hkm_paths(list(t), v, branch), c, branch)
                out = np.zeros((len(c), v.shape[1] + 1))
                np.add.at(out, at, np.column_stack([v, np.ones(len(v))]))
                return out

            s = _partial(rows, vector, assign, x.shape[1] + 1)
            moved = np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), centers)
            moved = np.floor(moved) if integer else moved
            if np.allclose(moved, centers, atol=1e-12):
                break
            centers = moved
        tree.append(centers)
    return tree


def _child(v: np.ndarray, parent: np.ndarray, centers: np.ndarray, branch: int) -> np.ndarray:
    c = centers.reshape(-1, branch, centers.shape[1])[parent]
    return parent * branch + ((v[:, None] - c) ** 2).sum(2).argmin(1)


def hkm_paths(tree: list[np.ndarray], v: np.ndarray, branch: int) -> np.ndarray:
    """Each vector's node at the lowest level."""
    at = np.zeros(len(v), np.int64)
    for centers in tree:
        at = _child(v, at, centers, branch)
    return at


def hkm_assign(rows: DataFrame, tree: list[np.ndarray], branch: int, vector: str = "d") -> DataFrame:
    """rows with ``node``."""
    names = [c for c in rows.columns if c != vector]

    def run(batches):
        for b in batches:
            v = np.array(b.column(b.schema.get_field_index(vector)).to_pylist(), float).reshape(b.num_rows, -1)
            at = hkm_paths(tree, v, branch) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(at)], [*names, "node"])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "node long"]))


def cell_neighbours(queries: DataFrame, base: DataFrame, k: int, tables: int, cells: int, seed: int = 0, initial: list[np.ndarray] | None = None, rounds: int = 5) -> DataFrame:
    """query_id, base_id, dist, rank: exact neighbours among rows that share a k-means cell in one of ``tables`` tables.

    queries: query_id, q. base: base_id, b. Centers of each table come from other seeds, or from ``initial``.
    Cells are searched where their rows lie (see ``in_cells``): pairs are never shuffled.
    """
    from ocellus.operators.neighbours import in_cells

    tabled = [kmeans(base.select(F.col("b").alias("d")), cells, rounds=rounds, seed=seed + t, initial=initial[t] if initial else None, tolerance=-1 if initial else 1e-9)[0] for t in range(tables)]

    def cells_of(v):
        return np.stack([nearest_center(v, c) for c in tabled], 1)

    def visits_of(v):
        own = cells_of(v)
        return np.repeat(np.arange(len(v)), tables), np.tile(np.arange(tables), len(v)), own.ravel(), np.zeros(own.size)

    return in_cells(queries, base, k, cells_of, visits_of)


def nearest_center(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Each row's center by squared distance rounded to 12 digits, ties to the smaller: as ``gmm.nearest`` has it."""
    from ocellus.operators.neighbours import exact_distances

    d = exact_distances(v[:, None], centers)
    d[np.isnan(d)] = np.inf
    own, least = d.argmin(1), d.min(1)
    rounds_alike = (d <= least[:, None] + 2e-12).argmax(1)
    for i in np.flatnonzero(rounds_alike < own):
        own[i] = min((_twelve_digits(x), k) for k, x in enumerate(d[i].tolist()))[1]
    return own


def _twelve_digits(x: float) -> float:
    """x rounded half up, as Spark's ``round``."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-12"), ROUND_HALF_UP, Context(400))) if math.isfinite(x) else x


def pca(rows: DataFrame, vector: str = "d", centered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, eigenvalues descending, eigenvectors as rows) of the covariance over n, from one pass of outer products."""
    s = _partial(rows, vector, lambda v: np.column_stack([np.vstack([v.T @ v, v.sum(0)]), np.full(v.shape[1] + 1, len(v))]), len(rows.head()[vector]) + 1)
    n, mean = s[0, -1], s[-1, :-1] / s[0, -1]
    return mean, *_axes(s[:-1, :-1] / n - (0 if centered else np.outer(mean, mean)))


def _axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending, and eigenvectors as rows whose largest element is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    vectors = vectors[:, order].T
    flip = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return values[order], vectors * flip[:, None]


def moments(rows: DataFrame, vector: str = "d") -> DataFrame:
    """i, j (from 0, i <= j), n, si, sj, sij: what a covariance needs of these rows. Tables of several loads add up in ``merged``."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(0).to_pylist(), float)
                part = np.vstack([v.T @ v, v.sum(0)])
                n, total = n + len(v), part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), *(pa.array(x) for x in (total[-1, i], total[-1, j], total[i, j]))], ["i", "j", "n", "si", "sj", "sij"])

    return merged(rows.select(vector).mapInArrow(run, "i int, j int, n long, si double, sj double, sij double"))


def merged(*parts: DataFrame) -> DataFrame:
    """One table of moments for the rows of all parts."""
    return reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def moments_covariance(m: DataFrame) -> DataFrame:
    """i, j, mean_i, mean_j, cov (over n) of moments."""
    means = m.select("i", "j", (F.col("si") / F.col("n")).alias("mean_i"), (F.col("sj") / F.col("n")).alias("mean_j"), (F.col("sij") / F.col("n")).alias("_m"))
    return means.withColumn("cov", F.col("_m") - F.col("mean_i") * F.col("mean_j")).drop("_m")


def pca_of(m: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, eigenvalues descending, eigenvectors as rows) of moments."""
    rows = moments_covariance(m).collect()
    d = 1 + max(r["j"] for r in rows)
    mean, cov = np.zeros(d), np.zeros((d, d))
    for r in rows:
        mean[r["j"]] = r["mean_j"]
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    return mean, *_axes(cov)


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Cluster of each row of a small symmetric affinity matrix: top eigenvectors of the normalised matrix, unit rows, k-means."""
    a = affinity - np.diag(np.diag(affinity))
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    vectors = np.linalg.eigh(a * d[:, None] * d)[1][:, -k:]
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centers = spread_seeds(u, k, np.random.default_rng(seed))
    for _ in range(100):
        own = ((u[:, None] - centers) ** 2).sum(2).argmin(1)
        moved = np.array([u[own == c].mean(0) if (own == c).any() else centers[c] for c in range(k)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return own
