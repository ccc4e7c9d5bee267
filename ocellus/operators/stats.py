"""Statistics: histograms, bin search, cumulative and rank operators, order statistics, entropy, integral tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """bin, n of integer values; with ``bins`` they are clipped to 0 .. bins - 1."""
    v = F.col(value).cast("long")
    v = F.greatest(F.least(v, F.lit(bins - 1)), F.lit(0)) if bins else v
    return rows.groupBy(v.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def range_histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), n of values in equal bins of [low, high); what lies outside goes to the end bins."""
    b = F.floor((F.col(value) - low) / (high - low) * bins)
    return rows.filter(~F.isnan(value)).groupBy(F.greatest(F.least(b, F.lit(bins - 1)), F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def joint_histogram(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def marginal(cells: DataFrame, keep: list[str], n: str = "n") -> DataFrame:
    """A histogram summed over all axes but ``keep``."""
    return cells.groupBy(*keep).agg(F.sum(n).alias(n))


def bin_search(x: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` are at most x: the bin from 1, or 0 below the first."""
    return reduce(lambda a, e: a + F.when(x >= F.lit(float(e)), 1).otherwise(0), edges, F.lit(0))


def weighted_histogram(rows: DataFrame, value: str, weight: str, edges: list[float]) -> DataFrame:
    """bin (from 1), w: weights summed between edges; the last bin holds x == last edge alone; NaN and what lies outside drop."""
    x, k = F.col(value), bin_search(F.col(value), edges)
    inside = ~F.isnan(x) & (k > 0) & ((k < len(edges)) | (x == F.lit(float(edges[-1]))))
    return rows.filter(inside).groupBy(k.alias("bin")).agg(F.sum(weight).alias("w"))


def binned_sum(rows: DataFrame, index: str, value: str, accumulator: DataFrame | None = None) -> DataFrame:
    """index, total: values summed by index, index 0 left out, onto the accumulator (index, total) if given."""
    sums = rows.filter(F.col(index) != 0).groupBy(index).agg(F.sum(value).alias("total"))
    if accumulator is None:
        return sums
    both = accumulator.select(index, F.col("total").alias("_a")).join(sums, index, "left")
    return both.select(index, (F.col("_a") + F.coalesce("total", F.lit(0))).alias("total"))


def cumulative(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """rows with csum, cmax and diff (the first row's diff is its value)."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    return rows.withColumns({"csum": F.sum(v).over(run), "cmax": F.max(v).over(run), "diff": v - F.coalesce(F.lag(v).over(w), F.lit(0))})


def local_maxima(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """Rows above both neighbours; the ends of a sequence have only one and don't count."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    return rows.withColumns({"_a": F.lag(value).over(w), "_z": F.lead(value).over(w)}).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_z"))).drop("_a", "_z")


def local_maxima_grid(cells: DataFrame, row: str, col: str, value: str, by: str | None = None) -> DataFrame:
    """Cells above all eight neighbours; cells at the border of the grid have fewer and don't count.

    Neighbours come from two windows, columns then rows, so each cell is shuffled twice and never multiplied.
    """
    keys = [by] if by else []
    v = F.col(value)
    across = Window.partitionBy(*keys, row).orderBy(col)
    wide = cells.withColumns({"_a": F.lag(v).over(across), "_z": F.lead(v).over(across)}).withColumn("_m", F.when(F.col("_a").isNotNull() & F.col("_z").isNotNull(), F.greatest("_a", "_z", v)))
    down = Window.partitionBy(*keys, col).orderBy(row)
    tall = wide.withColumns({"_u": F.lag("_m").over(down), "_d": F.lead("_m").over(down)})
    return tall.filter((v > F.col("_a")) & (v > F.col("_z")) & (v > F.col("_u")) & (v > F.col("_d"))).select(*cells.columns)


def min_max_ranks(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """rows with min_rank, max_rank from 0 by descending value: values above it, and values at least as large."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    up = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    ranks = counts.select(*keys, value, (up - F.col("_n")).alias("min_rank"), up.alias("max_rank"))
    return rows.join(ranks, [*keys, value])


def k_least(rows: DataFrame, value: str, order: str, k: int, by: str | None = None, largest: bool = False) -> DataFrame:
    """The k rows of smallest (or largest) value with their rank from 1, ties by ``order``."""
    if by is None:
        best = rows.orderBy(F.desc(value) if largest else F.asc(value), order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value) if largest else F.asc(value), order)))
    w = Window.partitionBy(by).orderBy(F.desc(value) if largest else F.asc(value), order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def summary(value: str, first: str) -> list[Column]:
    """Aggregates of a vector: counts, sums, norms, extremes and where they first are. ``first`` orders ties."""
    x = F.col(value).cast("double")
    return [
        F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(x == 0).alias("n_zero"), F.count_if(x > 0).alias("n_gt"), F.count_if(x < 0).alias("n_lt"),
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.sum(x * x).alias("sum_sq"), F.sqrt(F.sum(x * x)).alias("norm2"), F.sum(F.abs(x)).alias("norm1"),
        F.min(x).alias("least"), F.max(x).alias("most"), F.min_by(first, F.struct(x, F.col(first))).alias("argmin"), F.max_by(first, F.struct(x, -F.col(first))).alias("argmax"),
    ]


def order_statistics(rows: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """by, median (the middle two's mean), quantile (the value at that share), exactly."""
    return rows.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("quantile"))


def entropy(cells: DataFrame, by: str | None = None, n: str = "n") -> DataFrame:
    """entropy in bits, and unbalance n * sum(h^2) / sum(h)^2, of histogram rows."""
    keys = [by] if by else []
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    return cells.withColumn("_p", p).groupBy(*keys).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log2("_p")).otherwise(0.0)).alias("entropy"), (F.count(F.lit(1)) * F.sum(F.col(n) * F.col(n)) / (F.sum(n) * F.sum(n))).alias("unbalance"))


def mutual_information(cells: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """mi, joint entropy h, in nats, of a joint histogram."""
    total = cells.agg(F.sum(n).alias("_t"))
    pa, pb = cells.groupBy(a).agg(F.sum(n).alias("_a")), cells.groupBy(b).agg(F.sum(n).alias("_b"))
    c = cells.join(pa, a).join(pb, b).join(F.broadcast(total)).filter(F.col(n) > 0)
    p = F.col(n) / F.col("_t")
    return c.agg(F.sum(p * F.log(p * F.col("_t") * F.col("_t") / (F.col("_a") * F.col("_b")))).alias("mi"), F.sum(-p * F.log(p)).alias("h"))


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """i, j (from 0, i <= j), mean_i, mean_j, cov over n: moments by two sums a pair, map-side."""
    x = rows.select(F.posexplode(vector).alias("i", "x"), vector)
    pairs = x.select("i", "x", F.posexplode(vector).alias("j", "y")).filter("i <= j")
    s = pairs.groupBy("i", "j").agg(F.avg("x").alias("mean_i"), F.avg("y").alias("mean_j"), F.avg(F.col("x") * F.col("y")).alias("_xy"))
    return s.select("i", "j", "mean_i", "mean_j", (F.col("_xy") - F.col("mean_i") * F.col("mean_j")).alias("cov"))


def integral(cells: DataFrame, row: str, col: str, value: str, by: str | None = None) -> DataFrame:
    """cells with ``area``: the sum over all cells above and left of each, itself included. The grid must be full."""
    keys = [by] if by else []
    run = lambda p, o: Window.partitionBy(*keys, p).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_s", F.sum(value).over(run(row, col))).withColumn("area", F.sum("_s").over(run(col, row))).drop("_s")


def box_sums(table: DataFrame, boxes: DataFrame, row: str, col: str) -> DataFrame:
    """boxes (id, r0, c0, r1, c1, inclusive) with ``total``, by four corners of an integral table."""
    corners = boxes.select("id", F.explode(F.array(*[F.struct(r.alias(row), c.alias(col), F.lit(s).alias("_g")) for r, c, s in ((F.col("r1"), F.col("c1"), 1), (F.col("r0") - 1, F.col("c1"), -1), (F.col("r1"), F.col("c0") - 1, -1), (F.col("r0") - 1, F.col("c0") - 1, 1))])).alias("_k")).select("id", "_k.*")
    hit = corners.join(table.select(row, col, "area"), [row, col], "left")
    return boxes.join(hit.groupBy("id").agg(F.sum(F.coalesce("area", F.lit(0)) * F.col("_g")).alias("total")), "id")


def integral_histogram(cells: DataFrame, row: str, col: str, bin_: str, bins: int) -> DataFrame:
    """cells with ``hist``: how many cells above and left of each, itself included, have each bin from 0. The grid must be full."""
    run = lambda p, o: Window.partitionBy(p).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_h{b}" for b in range(bins)]
    across = cells.withColumns({n: F.sum((F.col(bin_) == b).cast("long")).over(run(row, col)) for b, n in enumerate(names)})
    return across.withColumns({n: F.sum(n).over(run(col, row)) for n in names}).withColumn("hist", F.array(*names)).drop(*names)


def box_histograms(table: DataFrame, boxes: DataFrame, row: str, col: str) -> DataFrame:
    """id, bin, n of boxes (id, r0, c0, r1, c1, inclusive), by four corners of an integral histogram."""
    corners = boxes.select("id", F.explode(F.array(*[F.struct(r.alias(row), c.alias(col), F.lit(s).alias("_g")) for r, c, s in ((F.col("r1"), F.col("c1"), 1), (F.col("r0") - 1, F.col("c1"), -1), (F.col("r1"), F.col("c0") - 1, -1), (F.col("r0") - 1, F.col("c0") - 1, 1))])).alias("_k")).select("id", "_k.*")
    hit = corners.join(table.select(row, col, "hist"), [row, col]).select("id", "_g", F.posexplode("hist").alias("bin", "n"))
    return hit.groupBy("id", "bin").agg(F.sum(F.col("n") * F.col("_g")).alias("n"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of two matrices in long form (i, j, v): a join on the shared index and a grouped sum."""
    return a.select("i", F.col("j").alias("_k"), F.col("v").alias("_x")).join(b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_y")), "_k").groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))


def block_sums(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Sums of a matrix (i, j, v) by clusters of its rows (i, ci) and of its columns (j, cj)."""
    return cells.join(rows, "i").join(cols, "j").groupBy("ci", "cj").agg(F.sum("v").alias("v"))


def merge_ordered(*tables: DataFrame, label: str = "label") -> DataFrame:
    """All rows of the tables by label, duplicates kept, with their source's number."""
    parts = [t.withColumn("source", F.lit(k)) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts).orderBy(label, "source")


def find_first(table: DataFrame, wanted: DataFrame, label: str = "label", pos: str = "pos") -> DataFrame:
    """wanted with the first position of each label, -1 if absent."""
    first = table.groupBy(label).agg(F.min(pos).alias(pos))
    return wanted.join(first, label, "left").withColumn(pos, F.coalesce(pos, F.lit(-1)))


def below_ratio(rows: DataFrame, value: str, by: str, ratio: float) -> DataFrame:
    """Rows below the group's least value times ``ratio``."""
    least = rows.groupBy(by).agg(F.min(value).alias("_least"))
    return rows.join(least, by).filter(F.col(value) < F.col("_least") * ratio).drop("_least")
