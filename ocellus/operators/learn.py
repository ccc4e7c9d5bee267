"""Agglomerative information bottleneck, linear classifiers, additive-kernel feature maps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plogp(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0.0)


def information(joint: np.ndarray) -> float:
    """Mutual information, in nats, of a joint table that sums to 1."""
    return float(_plogp(joint).sum() - _plogp(joint.sum(0)).sum() - _plogp(joint.sum(1)).sum())


def aib(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents, costs): merge rows of a joint table pair by pair, each time with the least loss of information.

    Leaves are 0 .. n - 1, merge t makes node n + t; parents of 2 n - 1 nodes, the root's is 0. costs[0] is
    the information of the table, costs[t] what is left after t merges. Rows without mass aren't merged: parent -1.
    """
    p = np.asarray(joint, float)
    n = len(p)
    p = p / p.sum()
    rows = {k: p[k] for k in range(n) if p[k].sum() > 0}
    parents = np.full(2 * n - 1, -1)
    costs, node = [information(p)], n

    def loss(a: np.ndarray, b: np.ndarray) -> float:
        c = a + b
        return float((_plogp(a) + _plogp(b) - _plogp(c)).sum() - (_plogp(a.sum()) + _plogp(b.sum()) - _plogp(c.sum())))

    gaps = {(a, b): loss(rows[a], rows[b]) for a in rows for b in rows if a < b}
    while gaps:
        (a, b), gap = min(gaps.items(), key=lambda x: (x[1], x[0]))
        parents[[a, b]] = node
        costs.append(costs[-1] - gap)
        merged = rows.pop(a) + rows.pop(b)
        gaps = {k: v for k, v in gaps.items() if a not in k and b not in k}
        gaps |= {(k, node): loss(rows[k], merged) for k in rows}
        rows[node] = merged
        node += 1
    for k in rows:
        parents[k] = 0
    return parents[:node], np.array(costs)


def aib_cut(parents: np.ndarray, clusters: int) -> np.ndarray:
    """Each leaf's cluster (from 0) after merges until ``clusters`` are left; -1 for leaves never merged."""
    n = (len(parents) + 1) // 2
    last = len(parents) - clusters
    top = np.arange(len(parents))
    for k in range(last, -1, -1):
        if parents[k] > k and parents[k] <= last:
            top[k] = top[parents[k]]
    leaves = np.where(parents[:n] >= 0, top[:n], -1)
    kept = np.unique(leaves[leaves >= 0])
    return np.where(leaves >= 0, np.searchsorted(kept, leaves), -1)


LOSSES = {
    "hinge": lambda z, y: F.greatest(F.lit(0.0), 1 - y * z),
    "hinge2": lambda z, y: F.pow(F.greatest(F.lit(0.0), 1 - y * z), F.lit(2.0)),
    "logistic": lambda z, y: F.log1p(F.exp(-y * z)),
    "l1": lambda z, y: F.abs(z - y),
    "l2": lambda z, y: (z - y) * (z - y) / 2,
}


def linear_fit(rows: DataFrame, loss: str = "hinge", lam: float = 1e-3, features: str = "d", label: str = "label", rounds: int = 100, weight: str | None = None) -> tuple[np.ndarray, float, float]:
    """(weights, bias, mean loss + lam / 2 |w|^2) of a linear model for labels -1 and 1; the bias has no penalty.

    loss: hinge, hinge2 (squared hinge), logistic, l1 (absolute error) or l2 (half the squared error);
    ``weight`` names a column of row weights, over whose sum the mean is taken. hinge, logistic and l2 have
    Spark's own solvers, the others ``reweighted_fit``.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    if loss not in LOSSES:
        raise ValueError(loss)
    x = rows.select(array_to_vector(features).alias("x"), F.col(features).alias("v"), F.col(label).cast("double").alias("y"), (F.col(label) > 0).cast("double").alias("c"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("r"))
    common = {"featuresCol": "x", "weightCol": "r", "regParam": lam, "maxIter": rounds}
    if loss in ("hinge2", "l1"):
        w, b, _ = reweighted_fit(x, loss, lam, rounds)
    else:
        if loss == "hinge":
            m = LinearSVC(labelCol="c", standardization=False, **common).fit(x)
        elif loss == "logistic":
            m = LogisticRegression(labelCol="c", standardization=False, **common).fit(x)
        else:
            m = LinearRegression(labelCol="y", standardization=False, **common).fit(x)
        w, b = m.coefficients.toArray(), float(m.intercept)
    margin = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(k)) for k in w]), lambda a, c: a * c), F.lit(b), lambda a, t: a + t)
    mean = x.agg(F.sum(F.col("r") * LOSSES[loss](margin, F.col("y"))) / F.sum("r")).head()[0]
    return w, b, float(mean) + lam / 2 * float(w @ w)


def reweighted_fit(rows: DataFrame, loss: str, lam: float, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-6) -> tuple[np.ndarray, float, list[float]]:
    """(weights, bias, objective by round) by least squares with weights renewed each round: v, y, r (row weight).

    hinge2: Newton's method, rows within the margin count and steps are halved until the objective falls.
    l1: rows weigh one over their error, ``floor`` at least. A round is one pass of outer products, added
    up in Spark; it stops when the objective falls by less than ``tolerance`` of itself.
    """
    from ocellus.operators.cluster import _partial

    packed = rows.select(F.concat(F.col("v").cast("array<double>"), F.array("y", "r")).alias("v"))
    dim = len(packed.head()["v"]) - 2
    penalty = np.append(np.full(dim, lam), 0.0)

    def evaluate(model):
        def part(m):
            x, y, r = np.column_stack([m[:, :dim], np.ones(len(m))]), m[:, dim], m[:, dim + 1]
            z = x @ model
            if loss == "hinge2":
                value, own = np.maximum(0, 1 - y * z) ** 2, 2.0 * (y * z < 1)
            else:
                value = np.abs(z - y)
                own = 1 / np.maximum(value, floor)
            out = np.column_stack([(x * (r * own)[:, None]).T @ x, x.T @ (r * own * y), np.zeros((dim + 1, 2))])
            out[0, -2:] = (r * value).sum(), r.sum()
            return out

        s = _partial(packed, "v", part, dim + 4)
        total = s[0, -1]
        return s[0, -2] / total + float(penalty @ model**2) / 2, s[:, : dim + 1] / total + np.diag(penalty), s[:, dim + 1] / total

    model = np.zeros(dim + 1)
    objective, gram, aim = evaluate(model)
    history = [objective]
    for _ in range(rounds):
        step = np.linalg.lstsq(gram, aim, rcond=None)[0] - model
        for _ in range(20):
            now = evaluate(model + step)
            if now[0] <= objective:
                break
            step = step / 2
        else:
            break
        model, last = model + step, objective
        objective, gram, aim = now
        history.append(objective)
        if last - objective <= tolerance * abs(last):
            break
    return model[:-1], float(model[-1]), history


def _spectrum(kernel: str, x: float) -> float:
    sech = 1 / math.cosh(min(700.0, abs(math.pi * x)))
    return {"chi2": sech, "intersection": 2 / math.pi / (1 + 4 * x * x), "js": 2 / math.log(4) * sech / (1 + 4 * x * x)}[kernel]


def kernel_map(x: Column, kernel: str = "chi2", order: int = 1, period: float = 0.6) -> Column:
    """2 * order + 1 features of a non-negative x whose inner products approximate an additive homogeneous kernel.

    The kernel's spectrum is sampled at multiples of ``period``: a constant term, then a cosine and a
    sine of log x for each multiple, all times sqrt(x). 0 maps to zeros.
    """
    log = F.log(F.when(x > 0, x).otherwise(F.lit(1.0)))
    parts = [F.sqrt(x * F.lit(period * _spectrum(kernel, 0.0)))]
    for j in range(1, order + 1):
        size = F.sqrt(x * F.lit(2 * period * _spectrum(kernel, j * period)))
        parts += [size * F.cos(F.lit(j * period) * log), size * F.sin(F.lit(j * period) * log)]
    return F.array(*parts)
