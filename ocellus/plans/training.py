"""Queries of model fitting: kernel maps have SQL; iterative ones are held against numpy in the tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ocellus.functions import vec
from ocellus.operators import cluster, forest, gmm, learn, stats
from ocellus.plans.fixtures import DESC, GMM, descriptors, read
from ocellus.plans.fixtures import gmm as closed_gmm
from ocellus.plans.registry import query

_P = 0.6
_K = [1.0, 1 / math.cosh(math.pi * _P)]


@query(
    f"""WITH {DESC}, x AS (SELECT vec_id, list_sum(list_transform(d, lambda v: abs(v))) AS x FROM descr)
SELECT vec_id, round(sqrt(x * {_P * _K[0]!r}), 6) AS a, round(sqrt(x * {2 * _P * _K[1]!r}) * cos({_P} * ln(x)), 6) + 0 AS b, round(sqrt(x * {2 * _P * _K[1]!r}) * sin({_P} * ln(x)), 6) + 0 AS c FROM x"""
)
def homkermap(spark, sf_dir):
    m = descriptors(spark, sf_dir).select("vec_id", learn.kernel_map(vec.l1(F.col("d")), "chi2", 1, _P).alias("m"))
    return m.select("vec_id", *[(F.round(F.col("m")[i], 6) + 0.0).alias(n) for i, n in enumerate("abc")])


_DL = f"{DESC}, dlong AS (SELECT vec_id, unnest(range(1, 9)) AS j, unnest(d) AS x FROM descr)"
_SQ = "(x - mu) * (x - mu)"


def kmeans_sql(p: str, k: int, rounds: int, start: int = 0, dist: str = _SQ, center: str = "avg(x)") -> str:
    """Rounds of k-means as tables {p}c0 ... (centers: k, j, mu), from the k least ids of at least ``start``; at the end {p}near."""
    out = [f"{p}c0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS k, j, x AS mu FROM dlong WHERE vec_id >= {start} AND vec_id < {start + k})"]
    for r in range(rounds + 1):
        near = f"{p}near" if r == rounds else f"{p}n{r}"
        out.append(f"{near} AS MATERIALIZED (SELECT vec_id, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (SELECT vec_id, k, round(sum({dist}), 12) AS dist FROM dlong JOIN {p}c{r} USING (j) GROUP BY vec_id, k) GROUP BY vec_id)")
        if r < rounds:
            out.append(f"{p}c{r + 1} AS MATERIALIZED (SELECT k, j, coalesce(m, mu) AS mu FROM {p}c{r} LEFT JOIN (SELECT k, j, {center} AS m FROM {near} JOIN dlong USING (vec_id) GROUP BY k, j) USING (k, j))")
    return ",\n".join(out)


@query(f"WITH {_DL}, {kmeans_sql('', 8, 4)} SELECT vec_id, k::INTEGER AS k, round(dist, 6) AS dist FROM near")
def kmeans(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    centers, _ = cluster.kmeans(d, 8, rounds=4, tolerance=-1, initial=cluster.first_vectors(d, "vec_id", 8))
    return gmm.nearest(d, cluster.centers_frame(spark, centers)).select("vec_id", "k", F.round("dist", 6).alias("dist"))


@query(f"WITH {_DL}, {kmeans_sql('', 6, 3, dist='abs(x - mu)', center='median(x)')} SELECT k::INTEGER AS k, count(*) AS n, round(sum(dist), 5) AS dist FROM near GROUP BY k")
def kmeans_l1(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    centers, _ = cluster.kmeans(d, 6, rounds=3, tolerance=-1, metric="l1", initial=cluster.first_vectors(d, "vec_id", 6))
    c = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in centers])
    best = F.array_min(F.transform(c, lambda m, k: F.struct(F.round(vec.distance("l1", F.col("d"), m), 12).alias("dist"), k.cast("int").alias("k"))))
    return d.select(best.alias("b")).groupBy(F.col("b.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b.dist"), 5).alias("dist"))


_BYTES = f"{DESC}, dlong AS (SELECT vec_id, unnest(range(1, 9)) AS j, unnest(list_transform(d, lambda v: least(255, greatest(0, floor(v * 32) + 128)))) AS x FROM descr)"


@query(f"WITH {_BYTES}, {kmeans_sql('', 8, 4, center='floor(sum(x) / count(*))')} SELECT vec_id, k::INTEGER AS k, round(dist, 6) AS dist FROM near")
def ikmeans(spark, sf_dir):
    whole = F.transform("d", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v * 32) + 128)).cast("double"))
    d = descriptors(spark, sf_dir).withColumn("d", whole)
    centers = cluster.ikmeans(d, 8, rounds=4, initial=cluster.first_vectors(d, "vec_id", 8))
    return gmm.nearest(d, cluster.centers_frame(spark, centers)).select("vec_id", "k", F.round("dist", 6).alias("dist"))


@query(f"WITH {_DL} SELECT (a.j - 1)::INTEGER AS i, (b.j - 1)::INTEGER AS j, round(avg(a.x), 6) + 0 AS mean_i, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 6) + 0 AS cov FROM dlong a JOIN dlong b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY ALL")
def pca_online(spark, sf_dir):
    """Moments of three loads of rows, merged."""
    d = descriptors(spark, sf_dir)
    m = cluster.merged(*[cluster.moments(d.filter(F.col("vec_id") % 3 == part)) for part in range(3)])
    return cluster.moments_covariance(m).select("i", "j", (F.round("mean_i", 6) + 0.0).alias("mean_i"), (F.round("cov", 6) + 0.0).alias("cov"))


_EM = f"""{GMM}, g0 AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS k, j, mu, sigma FROM gstat), w0 AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS k, w FROM gw)""" + "".join(
    f""",
l{r} AS MATERIALIZED (SELECT vec_id, k, ln(any_value(w)) - 0.5 * sum(ln(2 * pi() * sigma) + (x - mu) * (x - mu) / sigma) AS l FROM dlong JOIN g{r} USING (j) JOIN w{r} USING (k) GROUP BY vec_id, k),
p{r} AS MATERIALIZED (SELECT vec_id, k, exp(l - t) / sum(exp(l - t)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS t FROM l{r})),
g{r + 1} AS MATERIALIZED (SELECT k, j, sum(p * x) / sum(p) AS mu, greatest(sum(p * x * x) / sum(p) - pow(sum(p * x) / sum(p), 2), 1e-10) AS sigma FROM p{r} JOIN dlong USING (vec_id) GROUP BY k, j),
w{r + 1} AS MATERIALIZED (SELECT k, sum(p) / sum(sum(p)) OVER () AS w FROM p{r} GROUP BY k)"""
    for r in range(3)
)


@query(f"WITH {_EM} SELECT vec_id, k::INTEGER AS k, round(p, 5) AS p FROM p2")
def gmm_em(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    rows = closed_gmm(spark, sf_dir).orderBy("k").collect()
    w, mu, sigma, _ = cluster.gmm_fit(d, len(rows), rounds=2, tolerance=-1, initial=([r["w"] for r in rows], [r["mu"] for r in rows], [r["sigma"] for r in rows]))
    return gmm.posterior(d, cluster.gmm_frame(spark, w, mu, sigma)).select("vec_id", "k", F.round("p", 5).alias("p"))


@query()
def hkm_quantize(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    tree = cluster.hkm_fit(d, 2, 4, seed=1)
    return cluster.hkm_assign(d.select("vec_id", "d"), tree, 4)


@query(
    f"""WITH {_DL}, {", ".join(kmeans_sql(f"t{t}", 8, 2, 8 * t) for t in range(3))},
pairs AS (SELECT DISTINCT q.vec_id AS query_id, b.vec_id AS base_id FROM (SELECT 0 AS t, * FROM t0near UNION ALL SELECT 1, * FROM t1near UNION ALL SELECT 2, * FROM t2near) q
  JOIN (SELECT 0 AS t, * FROM t0near UNION ALL SELECT 1, * FROM t1near UNION ALL SELECT 2, * FROM t2near) b USING (t, k) WHERE q.vec_id % 100 = 0),
dd AS (SELECT query_id, base_id, round(list_sum(list_transform(range(1, 9), lambda i: (a.d[i] - b.d[i]) * (a.d[i] - b.d[i]))), 9) AS dist FROM pairs JOIN descr a ON a.vec_id = query_id JOIN descr b ON b.vec_id = base_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM dd)
SELECT query_id, base_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 5"""
)
def hashed_cell_neighbours(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    q = d.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("d").alias("q"))
    first = [cluster.first_vectors(d, "vec_id", 8, start=8 * t) for t in range(3)]
    found = cluster.cell_neighbours(q, d.select(F.col("vec_id").alias("base_id"), F.col("d").alias("b")), 5, 3, 8, initial=first, rounds=2)
    return found.select("query_id", "base_id", F.round("dist", 6).alias("dist"), "rank")


def _forest(spark, sf_dir, trees, levels, probes):
    d = descriptors(spark, sf_dir)
    q = d.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("d").alias("q"))
    built = forest.build_forest(d, trees, levels)
    found = forest.forest_neighbours(q, d.select(F.col("vec_id").alias("base_id"), F.col("d").alias("b")), 5, built, probes, salts=2)
    return found.select("query_id", "base_id", F.round("dist", 6).alias("dist"), "rank")


@query(
    f"""WITH {DESC}, dd AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, round(list_sum(list_transform(range(1, 9), lambda i: (a.d[i] - b.d[i]) * (a.d[i] - b.d[i]))), 9) AS dist
  FROM descr a CROSS JOIN descr b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM dd)
SELECT query_id, base_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 5"""
)
def kd_forest_exact(spark, sf_dir):
    """A forest all of whose leaves are searched finds the exact neighbours."""
    return _forest(spark, sf_dir, 2, 3, 16)


@query()
def kd_forest_neighbours(spark, sf_dir):
    return _forest(spark, sf_dir, 4, 6, 48)


@query()
def pca_eigs(spark, sf_dir):
    _, values, vectors = cluster.pca(descriptors(spark, sf_dir))
    return spark.createDataFrame([(k, float(v), [round(float(x), 6) for x in e]) for k, (v, e) in enumerate(zip(values, vectors))], "k int, value double, axis array<double>")


@query()
def svm_train(spark, sf_dir):
    rows = descriptors(spark, sf_dir).withColumn("label", F.when(F.col("label") < 5, -1).otherwise(1))
    w, b, objective = learn.linear_fit(rows, "hinge", 1e-2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate([*w, b, objective])], "i int, value double")


@query()
def aib_merge(spark, sf_dir):
    cells = stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_type").toPandas()
    table = cells.pivot_table(index="p_brand", columns="p_type", values="n", fill_value=0).to_numpy()
    parents, costs = learn.aib(table)
    return spark.createDataFrame([(k, int(p), float(costs[k]) if k < len(costs) else None) for k, p in enumerate(parents)], "node int, parent int, cost double")


@query()
def spectral_clusters(spark, sf_dir):
    rows = closed_gmm(spark, sf_dir).orderBy("k").collect()
    x = np.array([r["mu"] for r in rows])
    d = ((x[:, None] - x) ** 2).sum(2)
    own = cluster.spectral(np.exp(-d / d.mean()), min(3, len(rows)))
    return spark.createDataFrame([(r["k"], int(c)) for r, c in zip(rows, own)], "label int, k int")
