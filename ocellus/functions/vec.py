"""Column builders over array columns: norms, distances, kernels, sign packing. All stay in the JVM.

Sums run over the elements in order, in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def pair_sum(a: Column, b: Column, f: Pair) -> Column:
    return total(F.zip_with(a, b, f))


def word(v: Column, k: int, dim: int) -> Column:
    """Elements of word ``k`` (from 0) of a vector that holds words of ``dim`` elements."""
    return F.slice(v, k * dim + 1, dim)


def l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))


def l2sq(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def l2(v: Column) -> Column:
    return F.sqrt(l2sq(v))


def dot(a: Column, b: Column) -> Column:
    return pair_sum(a, b, lambda x, y: x * y)


def scaled(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x * s)


def normalized(v: Column, least: float = 0.0) -> Column:
    """v over its length; left alone unless the length exceeds ``least``."""
    n = l2(v)
    return F.when(n > least, F.transform(v, lambda x: x / n)).otherwise(v)


def signed_power(v: Column, power: float) -> Column:
    """sign(x) * |x|**power of each element; a square root where power is one half."""
    grow = (lambda x: F.sqrt(F.abs(x))) if power == 0.5 else (lambda x: F.pow(F.abs(x), F.lit(power)))
    return F.transform(v, lambda x: F.signum(x) * grow(x))


def pack_signs(v: Column) -> Column:
    """Bits x > 0, the first element highest, as a long. Zero gives bit 0."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_sample(bits: Column, positions: list[int]) -> Column:
    """Bit i of the result is bit positions[i] of ``bits``."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(bits, p).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def _part(x: Column, m: Column) -> Column:
    """x * log2(x / m), 0 where x is 0."""
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


#: Distances and kernels by name. Distances are the squared kind where one exists.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "l2": lambda a, b: pair_sum(a, b, lambda x, y: (x - y) * (x - y)),
    "l1": lambda a, b: pair_sum(a, b, lambda x, y: F.abs(x - y)),
    "chi2": lambda a, b: pair_sum(a, b, lambda x, y: _ratio((x - y) * (x - y), x + y)),
    "hellinger": lambda a, b: pair_sum(a, b, lambda x, y: x + y - 2 * F.sqrt(x * y)),
    "js": lambda a, b: pair_sum(a, b, lambda x, y: _part(x, (x + y) / 2) + _part(y, (x + y) / 2)),
    "linf": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "l0": lambda a, b: pair_sum(a, b, lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0))),
    "kl2": dot,
    "kl1": lambda a, b: pair_sum(a, b, lambda x, y: F.least(x, y)),
    "kchi2": lambda a, b: pair_sum(a, b, lambda x, y: _ratio(2 * x * y, x + y)),
    "khell": lambda a, b: pair_sum(a, b, lambda x, y: F.sqrt(x * y)),
    "kjs": lambda a, b: pair_sum(a, b, lambda x, y: (_part(x, x * x / (x + y)) + _part(y, y * y / (x + y))) / 2),
}


def mahalanobis(a: Column, b: Column, inverse_variance: Column) -> Column:
    """Squared, with a diagonal inverse covariance."""
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), inverse_variance, lambda d, s: d * s))


def distance(name: str, a: Column, b: Column) -> Column:
    return DISTANCES[name](a, b)


def sparse(v: Column) -> Column:
    """Non-zero elements as (index from 0, value) structs."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda s: s["v"] != 0)


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, s: t + s["v"] * F.coalesce(F.element_at(F.map_from_entries(b), s["i"]), F.lit(0.0)))


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))))


def seconds(t: Column) -> Column:
    """``h:m:s``, ``m:s`` or ``s`` as seconds; -1 with more than three parts."""
    parts = F.split(t, ":")
    return F.when(F.size(parts) > 3, F.lit(-1)).otherwise(F.aggregate(parts, F.lit(0), lambda a, x: a * 60 + x.cast("int")))
