"""Elementwise and structural operations on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a + scale * b."""
    return F.zip_with(a, b, lambda x, y: x + y * scale)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def over(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def shifted(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x + by)


def mapped(source: Column, places: Column) -> Column:
    """Element i is source[places[i]], places counting from 0; null outside."""
    return F.transform(places, lambda p: F.get(source, p))


def inverse_permutation(places: Column) -> Column:
    """The permutation q with q[places[i]] = i."""
    pairs = F.array_sort(F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    return F.transform(pairs, lambda s: s["i"])


def sort_order(a: Column, descending: bool = False) -> Column:
    """Places of the elements in ascending (descending) order, ties by place."""
    keyed = F.array_sort(F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("x"), i.alias("i"))))
    return F.transform(keyed, lambda s: s["i"])


def first_index(a: Column, value) -> Column:
    """Place from 0 of the first equal element, -1 if there is none."""
    return (F.array_position(a, value) - 1).cast("int")


def nonzero(a: Column) -> Column:
    """Places of elements that aren't 0."""
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != 0), lambda s: s["i"])


def dense(entries: Column, size: int) -> Column:
    """An array of ``size`` from sparse (i, v) structs; elsewhere 0."""
    m = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def purged(a: Column) -> Column:
    """Finite elements only, in order."""
    return F.filter(a, finite)


def replaced(a: Column, value: float) -> Column:
    """Elements that aren't finite become ``value``."""
    return F.transform(a, lambda x: F.when(finite(x), x).otherwise(F.lit(value)))


def normalized(a: Column, order: int = 2) -> Column:
    """Over the 1-norm or 2-norm, if that isn't 0."""
    n = F.aggregate(a, F.lit(0.0), lambda t, x: t + (F.abs(x) if order == 1 else x * x))
    n = n if order == 1 else F.sqrt(n)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def running(a: Column) -> Column:
    """Sums of all prefixes."""
    return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0.0), lambda t, y: t + y))


def counts(a: Column, low: float, high: float) -> Column:
    """Struct of counts: below low, within [low, high), at or above high, zero, NaN."""
    n = lambda f: F.size(F.filter(a, f))
    return F.struct(n(lambda x: x < low).alias("below"), n(lambda x: (x >= low) & (x < high)).alias("inside"), n(lambda x: (x >= high) & ~F.isnan(x)).alias("above"), n(lambda x: x == 0).alias("zero"), n(lambda x: F.isnan(x)).alias("nan"))
