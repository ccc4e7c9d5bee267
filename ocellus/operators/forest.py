"""Neighbours by a forest of randomised kd-trees: leaves of bounded boxes, the nearest ones searched."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.cluster import _sample
from ocellus.operators.neighbours import _ranked, box_bounds, in_cells


class Tree(NamedTuple):
    """A complete tree: node n has children 2 n + 1 and 2 n + 2; values above ``cut`` in element ``dim`` go right."""

    dim: np.ndarray
    cut: np.ndarray
    levels: int


def build_forest(rows: DataFrame, trees: int = 4, levels: int = 6, vector: str = "d", median: bool = True, widest: int = 5, fit_rows: int = 50_000, seed: int = 0) -> list[Tree]:
    """Trees fitted to a sample of about ``fit_rows`` rows; the size of the model doesn't depend on the data.

    A node splits at the median or mean of an element drawn from the ``widest`` ones of largest variance
    among the node's sampled rows. Nodes without rows split at their parent's sample. No rows: no trees.
    """
    x = _sample(rows, vector, fit_rows, seed)
    if not len(x):
        return []
    forest = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        dim, cut, at = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), [x]
        for n in range(2**levels - 1):
            own = at[n]
            order = np.argsort(-own.var(0), kind="stable")[:widest]
            dim[n] = rng.choice(order)
            cut[n] = np.median(own[:, dim[n]]) if median else own[:, dim[n]].mean()
            right = own[:, dim[n]] > cut[n]
            at += [own[~right] if (~right).any() else own, own[right] if right.any() else own]
        forest.append(Tree(dim, cut, levels))
    return forest


def leaves(tree: Tree, v: np.ndarray) -> np.ndarray:
    """Each row's leaf, from 0."""
    at = np.zeros(len(v), np.int64)
    for _ in range(tree.levels):
        at = 2 * at + 1 + (v[np.arange(len(v)), tree.dim[at]] > tree.cut[at])
    return at - (2**tree.levels - 1)


def leaf_boxes(tree: Tree, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper sides of the leaves' boxes, leaves x elements; infinite where no cut is."""
    low, high = np.full((1, width), -np.inf), np.full((1, width), np.inf)
    for level in range(tree.levels):
        nodes, at = slice(2**level - 1, 2 ** (level + 1) - 1), np.arange(2**level)
        left, right = high.copy(), low.copy()
        left[at, tree.dim[nodes]] = np.minimum(left[at, tree.dim[nodes]], tree.cut[nodes])
        right[at, tree.dim[nodes]] = np.maximum(right[at, tree.dim[nodes]], tree.cut[nodes])
        low, high = np.stack([low, right], 1).reshape(-1, width), np.stack([left, high], 1).reshape(-1, width)
    return low, high


def leaf_bounds(tree: Tree, v: np.ndarray) -> np.ndarray:
    """Rows x leaves: a lower bound of the squared distance from a row to all that lies in a leaf's box."""
    return box_bounds(v, *leaf_boxes(tree, v.shape[1]))


def visits(forest: list[Tree], v: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows, trees, leaves and bounds: the ``probes`` nearest leaves over all trees of each row.

    The leaves of a tree hold all rows: where all leaves of all trees are asked for, one tree's are visited.
    """
    if probes >= len(forest) * 2 ** forest[0].levels:
        forest = forest[:1]
    size, out = 2 ** forest[0].levels, []
    block = max(1, 1 << 18 >> min(18, forest[0].levels))  # bounds' memory grows with leaves
    for start in range(0, len(v), block):
        bound = np.concatenate([leaf_bounds(t, v[start : start + block]) for t in forest], 1)
        best = np.argsort(bound, 1, kind="stable")[:, :probes]
        at = np.repeat(np.arange(len(best)), best.shape[1])
        out.append((at + start, best.ravel() // size, best.ravel() % size, bound[at, best.ravel()]))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest_neighbours(queries: DataFrame, base: DataFrame, k: int, forest: list[Tree], probes: int = 16, salts: int = 1) -> DataFrame:
    """query_id, base_id, dist, rank: the k nearest by squared distance among rows of the ``probes`` nearest leaves.

    queries: query_id, q. base: base_id, b; null vectors take no part. Leaves of all trees compete, and the
    nearest by their boxes are searched, so at least one leaf that holds the query's place is. As many
    probes as there are leaves make it exact. Leaves are searched where their rows lie (see ``in_cells``):
    no leaf's rows are brought together, so ``salts``, into which a leaf was dealt, changes nothing.
    """
    if not forest:
        return _ranked(queries.join(base, F.lit(False)).select("query_id", "base_id", F.lit(0.0).alias("dist")), k)
    return in_cells(queries, base, k, lambda v: np.stack([leaves(t, v) for t in forest], 1), lambda v: visits(forest, v, probes))
