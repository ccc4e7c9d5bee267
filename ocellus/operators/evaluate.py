"""Evaluation: precision at 1, average precision, temporal Jaccard, PR, ROC and DET curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_precision(results: DataFrame, truth: DataFrame, k: int | None = None, substring: bool = False) -> DataFrame:
    """query_id, ap, p1 for every query of ``truth``; queries without results have 0.

    results: query_id, rank, clip. truth: query_id, clip. Of a clip that comes again only the first hit
    counts, and ranks close up behind it; the denominator is all clips of the truth. ``substring``
    takes a clip as relevant if its name is part of a true one's name.
    """
    gt = truth.select("query_id", "clip").distinct()
    first = results.groupBy("query_id", "clip").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "clip")
    first = first.withColumn("rank", F.row_number().over(order))
    if k is not None:
        first = first.filter(F.col("rank") <= k)
    if substring:
        names = gt.groupBy("query_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("clip"))).alias("_line"))
        rel = first.join(names, "query_id", "left").withColumn("hit", F.coalesce((F.instr("_line", F.col("clip")) > 0).cast("int"), F.lit(0)))
    else:
        rel = first.join(gt.withColumn("_g", F.lit(1)), ["query_id", "clip"], "left").withColumn("hit", F.coalesce("_g", F.lit(0)))
    precision = F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("rank")
    sums = rel.withColumn("_p", F.when(F.col("hit") == 1, precision).otherwise(0.0)).groupBy("query_id").agg(F.sum("_p").alias("_s"), F.max(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).alias("_one"))
    n = gt.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(sums, "query_id", "left").select("query_id", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("ap"), F.coalesce("_one", F.lit(0)).cast("double").alias("p1"))


def temporal_jaccard(found: DataFrame, truth: DataFrame, tolerance: int = 0) -> DataFrame:
    """query_id, jaccard: mean over the query's true clips of seconds in both over seconds in either.

    found, truth: query_id, clip, start, stop in whole seconds, both ends counted; several rows a clip
    are united. ``tolerance`` widens true segments at both ends. Clips not in the truth don't count.
    """
    def covered(rows: DataFrame, t: int, name: str) -> DataFrame:
        seconds = F.sequence(F.greatest(F.col("start") - t, F.lit(0)), F.col("stop") + t)
        return rows.filter("start <= stop").select("query_id", "clip", F.explode(seconds).alias("s")).distinct().withColumn(name, F.lit(1))

    both = covered(truth, tolerance, "_t").join(covered(found, 0, "_f"), ["query_id", "clip", "s"], "full")
    per = both.groupBy("query_id", "clip").agg(F.sum(F.coalesce(F.col("_t") * F.col("_f"), F.lit(0))).alias("i"), F.count(F.lit(1)).alias("u"), F.max("_t").alias("_t"))
    return per.filter("_t = 1").groupBy("query_id").agg((F.sum(F.col("i") / F.col("u")) / F.count(F.lit(1))).alias("jaccard"))


def _ranges(scored: DataFrame, score: str, ranges: int) -> DataFrame:
    """scored with _r: its range of scores, 0 the highest; equal scores share a range. Borders are approximate quantiles."""
    borders = scored.select(F.percentile_approx(score, [k / ranges for k in range(1, ranges)], 1000)).head()[0] or []
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(borders))])
    return scored.withColumn("_r", F.size(F.filter(cuts, lambda c: c > F.col(score))) if borders else F.lit(0))


def tp_fp(scored: DataFrame, by: str | None = None, score: str = "score", label: str = "label", order: str = "id", ranges: int = 64) -> DataFrame:
    """scored with tp, fp, n_pos, n_neg, pos: running counts by descending score, ties in the order of ``order``.

    label > 0 is positive. Rows with score -inf are never retrieved: they count in n_pos and n_neg only
    and their tp and fp don't grow. Counts run within each group of ``by``; without it, within ranges of
    scores, to which the counts of the ranges above are added from a table of ``ranges`` rows, so no
    task orders the whole table.
    """
    key = by or "_r"
    rows = scored if by else _ranges(scored, score, ranges)
    seen, pos, neg = F.col(score) > float("-inf"), F.col(label) > 0, F.col(label) <= 0
    one = lambda c: F.when(c, 1).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"tp": F.sum(one(pos & seen)).over(run), "fp": F.sum(one(neg & seen)).over(run), "pos": F.row_number().over(w)})
    sums = rows.groupBy(key).agg(F.sum(one(pos & seen)).alias("_tp"), F.sum(one(neg & seen)).alias("_fp"), F.count(F.lit(1)).alias("_pos"), F.sum(one(pos)).alias("n_pos"), F.sum(one(neg)).alias("n_neg"))
    if by:
        return counted.join(sums.select(by, "n_pos", "n_neg"), by)
    above = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    before = sums.select("_r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_tp", "_fp", "_pos")], *[F.sum(c).over(every).alias(c) for c in ("n_pos", "n_neg")])
    out = counted.join(F.broadcast(before), "_r")
    return out.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp"), "pos": (F.col("pos") + F.col("_pos")).cast("int")}).drop("_r", "_tp", "_fp", "_pos")


def pr_curve(scored: DataFrame, by: str | None = None, **names) -> DataFrame:
    """tp_fp with precision and recall at each row; before the first both are 1 and 0."""
    c = tp_fp(scored, by, **names)
    return c.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.col("n_pos")})


def pr_summary(scored: DataFrame, by: str | None = None, label: str = "label", score: str = "score", **names) -> DataFrame:
    """ap: mean precision at the positives found; auc: area by trapezoids; ap11: mean of the best precision at 11 recalls."""
    c = pr_curve(scored, by, label=label, score=score, **names)
    keys = [by] if by else []
    seen = F.col(score) > float("-inf")
    hit, miss = (F.col(label) > 0) & seen, (F.col(label) <= 0) & seen
    # The row before has one hit or miss less.
    tp, fp = F.col("tp") - hit.cast("int"), F.col("fp") - miss.cast("int")
    c = c.withColumns({"_p": F.when(F.col("pos") == 1, 1.0).otherwise(tp / F.greatest(tp + fp, F.lit(1))), "_r": tp / F.col("n_pos")})
    best = [F.coalesce(F.max(F.when(F.col("recall") >= t / 10, F.col("precision"))), F.lit(0.0)) for t in range(11)]
    aggs = [
        (F.sum(F.when(hit, F.col("precision")).otherwise(0.0)) / F.max("n_pos")).alias("ap"),
        F.sum((F.col("precision") + F.col("_p")) / 2 * (F.col("recall") - F.col("_r"))).alias("auc"),
        (sum(best[1:], best[0]) / 11).alias("ap11"),
    ]
    return c.groupBy(*keys).agg(*aggs)


def roc_curve(scored: DataFrame, by: str | None = None, **names) -> DataFrame:
    """tp_fp with tpr, fpr, tnr, fnr."""
    c = tp_fp(scored, by, **names)
    tpr, fpr = F.col("tp") / F.col("n_pos"), F.col("fp") / F.col("n_neg")
    return c.withColumns({"tpr": tpr, "fpr": fpr, "tnr": 1 - fpr, "fnr": 1 - tpr})


def roc_summary(scored: DataFrame, by: str | None = None, label: str = "label", score: str = "score", **names) -> DataFrame:
    """auc: area under the staircase; eer: the error at the first row where misses are no more than false alarms."""
    c = roc_curve(scored, by, label=label, score=score, **names)
    keys = [by] if by else []
    miss = ((F.col(label) <= 0) & (F.col(score) > float("-inf"))).cast("int")
    c = c.withColumn("_f", (F.col("fp") - miss) / F.col("n_neg"))
    at = F.when(F.col("fnr") <= F.col("fpr"), F.struct("pos", ((F.col("fnr") + F.col("fpr")) / 2).alias("e")))
    return c.groupBy(*keys).agg(F.sum(F.col("tpr") * (F.col("fpr") - F.col("_f"))).alias("auc"), F.min(at)["e"].alias("eer"))


def det_curve(scored: DataFrame, by: str | None = None, **names) -> DataFrame:
    """Misses (fnr) against false alarms (fpr), with both on the scale of normal deviates; ends are clipped to 1e-6."""
    from statistics import NormalDist

    c = roc_curve(scored, by, **names)
    edge = NormalDist().inv_cdf(1e-6)
    # Winitzki's form of the inverse error function; its error is below 2e-3 relative, enough for an axis.
    a = 0.147

    def deviate(p: Column) -> Column:
        x = 2 * p - 1
        log = F.log(1 - x * x)
        t = 2 / (3.141592653589793 * a) + log / 2
        return F.when(p <= 1e-6, F.lit(edge)).when(p >= 1 - 1e-6, F.lit(-edge)).otherwise(F.signum(x) * F.sqrt(F.greatest(F.lit(0.0), F.sqrt(t * t - log / a) - t)) * F.lit(2**0.5))

    return c.withColumns({"miss_deviate": deviate(F.col("fnr")), "alarm_deviate": deviate(F.col("fpr"))})


def reweighted(curve: DataFrame, positive_share: float) -> DataFrame:
    """Precision of a PR curve as it would be if ``positive_share`` of all rows were positive."""
    tp = F.col("tp") / F.col("n_pos") * positive_share
    fp = F.col("fp") / F.col("n_neg") * (1 - positive_share)
    return curve.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)))
