"""Special functions as columns: bells, sigmoids, their derivatives, raised cosine, binary entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(x: Column, sigma: float = 1.0) -> Column:
    """Density of a centred normal variable."""
    return F.exp(-x * x / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)


def dgaussian(x: Column, sigma: float = 1.0) -> Column:
    return -x / (sigma * sigma) * gaussian(x, sigma)


def ddgaussian(x: Column, sigma: float = 1.0) -> Column:
    return (x * x / (sigma * sigma) - 1) / (sigma * sigma) * gaussian(x, sigma)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dsigmoid(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 - s)


def raised_cosine(x: Column) -> Column:
    """(1 + cos(pi x)) / 2 within [-1, 1], else 0."""
    return F.when(F.abs(x) <= 1, (1 + F.cos(x * math.pi)) / 2).otherwise(F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at both ends."""
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return part(p) + part(1 - p)
