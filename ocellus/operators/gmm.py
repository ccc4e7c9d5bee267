"""Gaussian mixtures over descriptors: posteriors, Fisher vectors, soft assignment, VLAD, bags, point index.

The relational forms here explode a descriptor into its dimensions, which keeps sums map-side and in
the JVM; ``fisher_arrow`` computes the same Fisher vectors by matrix products on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import vec


def long(desc: DataFrame, keys: list[str], vector: str = "d") -> DataFrame:
    """keys, j, x: one row for each dimension."""
    return desc.select(*keys, F.posexplode(vector).alias("j", "x"))


def log_likelihood(d: Column, w: Column, mu: Column, sigma: Column) -> Column:
    """log(w N(d; mu, sigma)), sigma being variances."""
    m = vec.total(F.zip_with(F.zip_with(d, mu, lambda x, y: (x - y) * (x - y)), sigma, lambda a, s: a / s))
    logs = F.aggregate(sigma, F.lit(0.0), lambda a, s: a + F.log(s))
    return F.log(w) - 0.5 * (F.size(mu) * F.lit(math.log(2 * math.pi)) + logs + m)


def posterior(desc: DataFrame, gmm: DataFrame, key: str = "vec_id", vector: str = "d") -> DataFrame:
    """Columns of desc, k, p: each descriptor's posterior under every Gaussian, by a softmax of log likelihoods.

    The model is broadcast: it has one row for each Gaussian. The softmax is over an array of K values
    in the descriptor's own row, so nothing is shuffled.
    """
    g = gmm.agg(F.array_sort(F.collect_list(F.struct("k", "w", "mu", "sigma"))).alias("_g"))
    both = desc.join(F.broadcast(g))
    logs = both.withColumn("_l", F.transform("_g", lambda c: log_likelihood(F.col(vector), c["w"], c["mu"], c["sigma"])))
    grown = logs.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l")))).withColumn("_s", vec.total(F.col("_e")))
    out = grown.select(*desc.columns, F.posexplode(F.zip_with("_g", "_e", lambda c, x: F.struct(c["k"].alias("k"), x.alias("e")))).alias("_n", "_c"), "_s")
    return out.select(*desc.columns, F.col("_c.k").alias("k"), (F.col("_c.e") / F.col("_s")).alias("p"))


def soft_assignment(post: DataFrame, by: str) -> DataFrame:
    """by, k, soft: mean posterior."""
    return post.groupBy(by, "k").agg(F.avg("p").alias("soft"))


def fisher_mu(post: DataFrame, gmm: DataFrame, by: str, vector: str = "d") -> DataFrame:
    """by, k, j, v: sum of p (x - mu) / sigma over sqrt(n w / sigma), for each Gaussian and dimension."""
    model = gmm.select("k", "w", F.posexplode(F.arrays_zip("mu", "sigma")).alias("j", "m"))
    rows = post.select(by, "k", "p", F.posexplode(vector).alias("j", "x"))
    sums = rows.groupBy(by, "k", "j").agg(F.sum(F.col("p") * F.col("x")).alias("px"), F.sum("p").alias("sp"), F.count(F.lit(1)).alias("n"))
    m, s = F.col("m.mu"), F.col("m.sigma")
    return sums.join(F.broadcast(model), ["k", "j"]).select(by, "k", "j", ((F.col("px") - F.col("sp") * m) / s / F.sqrt(F.col("n") * F.col("w") / s)).alias("v"))


def fisher_full(post: DataFrame, gmm: DataFrame, by: str, vector: str = "d", least: float = 1e-6) -> DataFrame:
    """by, k, j, u, v: mean and variance parts over n sqrt(w) and n sqrt(2 w); posteriors below ``least`` are left out."""
    model = gmm.select("k", "w", F.posexplode(F.arrays_zip("mu", "sigma")).alias("j", "m"))
    rows = post.select(by, "k", "p", F.posexplode(vector).alias("j", "x")).join(F.broadcast(model), ["k", "j"])
    z = (F.col("x") - F.col("m.mu")) / F.sqrt("m.sigma")
    p = F.when(F.col("p") >= least, F.col("p")).otherwise(0.0)
    sums = rows.groupBy(by, "k", "j").agg(F.sum(p * z).alias("u"), F.sum(p * (z * z - 1)).alias("v"), F.count(F.lit(1)).alias("n"), F.first("w").alias("w"))
    return sums.select(by, "k", "j", (F.col("u") / (F.col("n") * F.sqrt("w"))).alias("u"), (F.col("v") / (F.col("n") * F.sqrt(2 * F.col("w")))).alias("v"))


def fisher_weight(post: DataFrame, gmm: DataFrame, by: str) -> DataFrame:
    """by, k, v for all Gaussians but the first: its posteriors over w less the first's, over sqrt(n (1/w + 1/w first))."""
    sums = post.groupBy(by, "k").agg(F.sum("p").alias("sp"), F.count(F.lit(1)).alias("n")).join(F.broadcast(gmm.select("k", "w")), "k")
    first = sums.join(F.broadcast(gmm.agg(F.min("k").alias("k"))), "k").select(by, F.col("k").alias("_k"), F.col("w").alias("_w"), F.col("sp").alias("_sp"))
    both = sums.join(first, by).filter(F.col("k") != F.col("_k"))
    return both.select(by, "k", ((F.col("sp") / F.col("w") - F.col("_sp") / F.col("_w")) / F.sqrt(F.col("n") * (1 / F.col("w") + 1 / F.col("_w")))).alias("v"))


def _deviations(post: DataFrame, gmm: DataFrame, by: str, vector: str) -> DataFrame:
    """by, k, j, e (sum of p (z^2 - 1)), n, w, s (the variance)."""
    model = gmm.select("k", "w", F.posexplode(F.arrays_zip("mu", "sigma")).alias("j", "m"))
    rows = post.select(by, "k", "p", F.posexplode(vector).alias("j", "x"))
    p, x = F.col("p"), F.col("x")
    sums = rows.groupBy(by, "k", "j").agg(F.sum(p * x * x).alias("pxx"), F.sum(p * x).alias("px"), F.sum(p).alias("sp"), F.count(F.lit(1)).alias("n"))
    m, s = F.col("m.mu"), F.col("m.sigma")
    e = (F.col("pxx") - 2 * m * F.col("px") + m * m * F.col("sp")) / s - F.col("sp")
    return sums.join(F.broadcast(model), ["k", "j"]).select(by, "k", "j", e.alias("e"), "n", "w", s.alias("s"))


def fisher_sigma(post: DataFrame, gmm: DataFrame, by: str, vector: str = "d") -> DataFrame:
    """by, k, j, v: the part of the variances, sum of p (z^2 - 1) over sqrt(2 n w)."""
    return _deviations(post, gmm, by, vector).select(by, "k", "j", (F.col("e") / F.sqrt(2 * F.col("n") * F.col("w"))).alias("v"))


def fisher_one_sigma(post: DataFrame, gmm: DataFrame, by: str, vector: str = "d") -> DataFrame:
    """by, k, v: one variance for each Gaussian; all dimensions' sums over sqrt(2 d n w / the first dimension's variance)."""
    first = F.max(F.when(F.col("j") == 0, F.col("s")))
    sums = _deviations(post, gmm, by, vector).groupBy(by, "k").agg(F.sum(F.col("e") / F.sqrt("s")).alias("e"), F.count(F.lit(1)).alias("d"), F.first("n").alias("n"), F.first("w").alias("w"), first.alias("s"))
    return sums.select(by, "k", (F.col("e") / F.sqrt(2 * F.col("d") * F.col("n") * F.col("w") / F.col("s"))).alias("v"))


def hard(post: DataFrame, key: str = "vec_id") -> DataFrame:
    """Posteriors with 1 for each descriptor's most likely Gaussian (ties to the smaller k) and 0 for others."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "k")) == 1
    return post.withColumn("p", F.when(best, 1.0).otherwise(0.0))


def improved(fv: DataFrame, by: str, parts: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Signed square roots of all parts, then length 1 over all of them together."""
    fv = fv.withColumns({c: F.signum(c) * F.sqrt(F.abs(c)) for c in parts})
    n = F.sqrt(F.sum(sum((F.col(c) * F.col(c) for c in parts[1:]), F.col(parts[0]) * F.col(parts[0]))).over(Window.partitionBy(by)))
    return fv.withColumn("_n", n).withColumns({c: F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(F.col(c)) for c in parts}).drop("_n")


def word_l1(fv: DataFrame, by: str) -> DataFrame:
    return fv.groupBy(by, "k").agg(F.sum(F.abs("v")).alias("l1"))


def intra_normalized(fv: DataFrame, by: str) -> DataFrame:
    """Each word's part over its length; zero words stay."""
    n = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(by, "k")))
    return fv.withColumn("v", F.when(n > 0, F.col("v") / n).otherwise(F.col("v")))


def power_normalized(fv: DataFrame, by: str, power: float = 0.5, least: float = 1e-5) -> DataFrame:
    """Signed power, then length 1 if the length exceeds ``least``."""
    x = F.col("v")
    grown = F.sqrt(F.abs(x)) if power == 0.5 else F.pow(F.abs(x), F.lit(power))
    out = fv.withColumn("v", F.signum(x) * grown)
    n = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(by)))
    return out.withColumn("v", F.when(n > least, F.col("v") / n).otherwise(F.col("v")))


def global_descriptor(desc: DataFrame, gmm: DataFrame, by: str, intra: bool = True, power: float = 0.5) -> DataFrame:
    """by, k, l1, soft, fv, bits: the whole descriptor of frames, shots or scenes, by what ``by`` groups."""
    post = posterior(desc, gmm)
    fv = fisher_mu(post, gmm, by)
    flat = intra_normalized(fv, by) if intra else fv
    flat = power_normalized(flat, by, 1.0 if intra else power)
    packed = flat.groupBy(by, "k").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s")).select(by, "k", F.col("s.v").alias("fv"))
    return packed.join(word_l1(fv, by), [by, "k"]).join(soft_assignment(post, by), [by, "k"]).withColumn("bits", vec.pack_signs(F.col("fv")))


def fisher_arrow(desc: DataFrame, gmm: DataFrame, by: str, vector: str = "d") -> DataFrame:
    """by, k, j, v: ``fisher_mu`` by matrix products; each Arrow batch gives partial sums, which Spark adds."""
    rows = sorted(gmm.collect(), key=lambda r: r["k"])
    ks, w = [r["k"] for r in rows], np.array([r["w"] for r in rows])
    mu, sigma = np.array([r["mu"] for r in rows]), np.array([r["sigma"] for r in rows])
    const = np.log(w) - 0.5 * (mu.shape[1] * math.log(2 * math.pi) + np.log(sigma).sum(1) + (mu * mu / sigma).sum(1))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), float)
            groups, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            log = const + x @ (mu / sigma).T - 0.5 * (x * x) @ (1 / sigma).T
            p = np.exp(log - log.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            px = np.concatenate([p[at == g].T @ x[at == g] for g in range(len(groups))])
            sp = np.concatenate([p[at == g].sum(0) for g in range(len(groups))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups, len(ks))), pa.array(np.tile(ks, len(groups)), pa.int64()), pa.array(px.tolist(), pa.list_(pa.float64())), pa.array(sp), pa.array(np.repeat(np.bincount(at), len(ks)))], ["by", "k", "px", "sp", "n"])

    part = desc.select(F.col(by).cast("long").alias("by"), vector).mapInArrow(run, "by long, k long, px array<double>, sp double, n long")
    sums = part.select("by", "k", "sp", "n", F.posexplode("px").alias("j", "px")).groupBy("by", "k", "j").agg(F.sum("px").alias("px"), F.sum("sp").alias("sp"), F.sum("n").alias("n"))
    model = gmm.select(F.col("k").cast("long").alias("k"), "w", F.posexplode(F.arrays_zip("mu", "sigma")).alias("j", "m"))
    m, s = F.col("m.mu"), F.col("m.sigma")
    return sums.join(F.broadcast(model), ["k", "j"]).select(F.col("by").alias(by), "k", "j", ((F.col("px") - F.col("sp") * m) / s / F.sqrt(F.col("n") * F.col("w") / s)).alias("v"))


def nearest(desc: DataFrame, centers: DataFrame, vector: str = "d") -> DataFrame:
    """Columns of desc, k, dist: nearest center (k, mu) by squared distance, ties to the smaller k."""
    c = centers.agg(F.array_sort(F.collect_list(F.struct("k", "mu"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(F.round(vec.distance("l2", F.col(vector), c["mu"]), 12).alias("dist"), c["k"].alias("k"))))
    return desc.join(F.broadcast(c)).withColumn("_b", best).select(*desc.columns, F.col("_b.k").alias("k"), F.col("_b.dist").alias("dist"))


def bag(assigned: DataFrame, by: str) -> DataFrame:
    return assigned.groupBy(by, "k").agg(F.count(F.lit(1)).alias("n"))


def vlad(assigned: DataFrame, centers: DataFrame, by: str, vector: str = "d", mass: bool = False, component: bool = False, weight: Column | str | None = None, square_root: bool = False, whole: bool = False) -> DataFrame:
    """by, k, j, v: summed residuals of descriptors to their center.

    ``assigned``: a row for each descriptor and center that it counts for; ``weight``: by how much (soft
    assignment: the posterior). mass: over the sum of weights; square_root: signed square roots;
    component: each center's part gets length 1; whole: so does the group's vector.
    """
    rows = assigned.select(by, "k", (F.lit(1.0) if weight is None else F.expr(weight) if isinstance(weight, str) else weight).alias("wt"), F.posexplode(vector).alias("j", "x"))
    model = centers.select("k", F.posexplode("mu").alias("j", "mu"))
    sums = rows.join(F.broadcast(model), ["k", "j"]).groupBy(by, "k", "j").agg(F.sum(F.col("wt") * (F.col("x") - F.col("mu"))).alias("v"), F.sum("wt").alias("n"))
    if mass:
        sums = sums.withColumn("v", F.col("v") / F.col("n"))
    out = sums.select(by, "k", "j", "v")
    if square_root:
        out = out.withColumn("v", F.signum("v") * F.sqrt(F.abs("v")))
    out = intra_normalized(out, by) if component else out
    return power_normalized(out, by, 1.0, 0.0) if whole else out


def point_index(post: DataFrame, gmm: DataFrame, key: str = "vec_id", vector: str = "d") -> DataFrame:
    """key, word, weight, residual, bits: each feature's best Gaussian, p / sqrt(w), and (x - mu) / sigma."""
    best = post.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "k"))).filter("_n = 1")
    out = best.join(F.broadcast(gmm), "k")
    residual = F.zip_with(F.zip_with(vector, "mu", lambda x, m: x - m), "sigma", lambda r, s: r / s)
    return out.select(key, F.col("k").alias("word"), (F.col("p") / F.sqrt("w")).alias("weight"), residual.alias("residual"), vec.pack_signs(residual).alias("bits"))


def project(desc: DataFrame, mean: list[float], axes: list[list[float]], vector: str = "d", power: float = 0.5) -> DataFrame:
    """Columns of desc and ``projected``: signed power, length 1, minus the mean, inner products with the axes."""
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    grown = desc.withColumn("_u", vec.normalized(vec.signed_power(F.col(vector), power)))
    grown = grown.withColumn("_u", F.zip_with("_u", array(mean), lambda x, m: x - m))
    return grown.withColumn("projected", F.array(*[vec.dot(F.col("_u"), array(a)) for a in axes])).drop("_u")
