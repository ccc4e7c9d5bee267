"""Queries of elementwise and structural array operations, special functions, sampling and tree histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ocellus.functions import arrays, special, vec
from ocellus.operators import learn, sampling, stats, trees
from ocellus.plans.fixtures import DESC, descriptors, read
from ocellus.plans.registry import query

R = 6


def _r(c, name):
    return (F.round(c, R) + 0.0).alias(name)


_X = "x AS (SELECT event_id, value, (value % 7) - 3 AS x FROM events)"


@query(f"WITH {_X} SELECT event_id, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) + 0 AS g, round(-x * exp(-x * x / 2) / sqrt(2 * pi()), 6) + 0 AS dg, round((x * x - 1) * exp(-x * x / 2) / sqrt(2 * pi()), 6) + 0 AS ddg, round(1 / (1 + exp(-x)), 6) AS s, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS ds, round(CASE WHEN abs(x) <= 1 THEN (1 + cos(pi() * x)) / 2 ELSE 0 END, 6) AS rc FROM x")
def special_functions(spark, sf_dir):
    x = F.col("value") % 7 - 3
    return read(spark, sf_dir, "events").select("event_id", _r(special.gaussian(x), "g"), _r(special.dgaussian(x), "dg"), _r(special.ddgaussian(x), "ddg"), _r(special.sigmoid(x), "s"), _r(special.dsigmoid(x), "ds"), _r(special.raised_cosine(x), "rc"))


_V = DESC + ", v AS (SELECT a.vec_id, a.d AS a, b.d AS b FROM descr a JOIN descr b ON b.vec_id = 1)"


def _pair(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    return d.select("vec_id", F.col("d").alias("a")).join(F.broadcast(d.filter("vec_id = 1").select(F.col("d").alias("b"))))


def _list(c, name):
    return F.transform(c, lambda x: F.round(x, R) + 0.0).alias(name)


_I = "list_transform(range(1, 9), lambda i: round({}, 6) + 0)"


@query(f"WITH {_V} SELECT vec_id, {_I.format('a[i] + 2 * b[i]')} AS axpy, {_I.format('a[i] * b[i]')} AS product, {_I.format('a[i] / b[i]')} AS quotient, {_I.format('a[i] + 1')} AS shifted FROM v")
def vector_arithmetic(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pair(spark, sf_dir).select("vec_id", _list(arrays.plus(a, b, 2.0), "axpy"), _list(arrays.times(a, b), "product"), _list(arrays.over(a, b), "quotient"), _list(arrays.shifted(a, 1.0), "shifted"))


@query(
    f"""WITH {DESC}, o AS (SELECT vec_id, d, list_transform(list_sort(list_transform(range(1, 9), lambda i: {{'x': d[i], 'i': i - 1}})), lambda s: s.i) AS o FROM descr)
SELECT vec_id, list_transform(o, lambda i: i::INTEGER) AS sort_order, list_transform(range(0, 8), lambda i: (list_position(o, i) - 1)::INTEGER) AS inverse, (list_position(o, 3) - 1)::INTEGER AS place,
list_transform(range(1, 9), lambda i: round(list_sum(d[1:i]), 6) + 0) AS prefix, round(d[o[1] + 1], 6) + 0 AS least FROM o"""
)
def vector_order(spark, sf_dir):
    o = arrays.sort_order(F.col("d"))
    rows = descriptors(spark, sf_dir).select("vec_id", "d", o.alias("o"))
    return rows.select("vec_id", F.col("o").alias("sort_order"), arrays.inverse_permutation(F.col("o")).alias("inverse"), arrays.first_index(F.col("o"), F.lit(3)).alias("place"), _list(arrays.running(F.col("d")), "prefix"), _r(arrays.mapped(F.col("d"), F.col("o"))[0], "least"))


@query(f"WITH {DESC} SELECT vec_id, len(list_filter(d, lambda x: x < 0))::INTEGER AS below, len(list_filter(d, lambda x: x >= 0 AND x < 0.1))::INTEGER AS inside, len(list_filter(d, lambda x: x >= 0.1))::INTEGER AS above, {_I.format('d[i] / list_sum(list_transform(d, lambda x: abs(x)))')} AS unit FROM descr")
def vector_counts(spark, sf_dir):
    c = arrays.counts(F.col("d"), 0.0, 0.1)
    return descriptors(spark, sf_dir).select("vec_id", c["below"].alias("below"), c["inside"].alias("inside"), c["above"].alias("above"), _list(arrays.normalized(F.col("d"), 1), "unit"))


@query(f"WITH {DESC}, s AS (SELECT vec_id, list_transform(d, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0 END) AS v FROM descr) SELECT vec_id, list_transform(list_filter(range(1, 9), lambda i: v[i] <> 0), lambda i: (i - 1)::INTEGER) AS places, list_transform(v, lambda x: round(x, 6) + 0) AS dense FROM s")
def sparse_dense(spark, sf_dir):
    v = F.transform("d", lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))
    rows = descriptors(spark, sf_dir).select("vec_id", v.alias("v"))
    return rows.select("vec_id", arrays.nonzero(F.col("v")).alias("places"), _list(arrays.dense(vec.sparse(F.col("v")), 8), "dense"))


@query(f"WITH {DESC}, b AS (SELECT vec_id, list_transform(range(1, 9), lambda i: CASE WHEN (vec_id + i) % 5 = 0 THEN NULL ELSE d[i] END) AS v FROM descr) SELECT vec_id, len(list_filter(v, lambda x: x IS NOT NULL))::INTEGER AS left_over, round(list_sum(list_transform(v, lambda x: coalesce(x, 9))), 6) + 0 AS filled FROM b")
def purge_replace(spark, sf_dir):
    v = F.transform("d", lambda x, i: F.when((F.col("vec_id") + i + 1) % 5 == 0, F.when(F.col("vec_id") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(x))
    rows = descriptors(spark, sf_dir).select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.size(arrays.purged(F.col("v"))).alias("left_over"), _r(vec.total(arrays.replaced(F.col("v"), 9.0)), "filled"))


_CHANCE = "c AS (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey || ':3'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS c FROM orders)"


@query(f"WITH {_CHANCE} SELECT o_orderkey FROM c ORDER BY c, o_orderkey LIMIT 100")
def random_subset(spark, sf_dir):
    return sampling.subset(read(spark, sf_dir, "orders"), "o_orderkey", 100, seed=3).select("o_orderkey")


@query(f"WITH {_CHANCE} SELECT o_orderkey FROM c WHERE c < 0.1")
def random_share(spark, sf_dir):
    return sampling.share(read(spark, sf_dir, "orders"), "o_orderkey", 0.1, seed=3).select("o_orderkey")


def _aib(spark, sf_dir):
    cells = stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_type").toPandas()
    table = cells.pivot_table(index="p_brand", columns="p_type", values="n", fill_value=0).sort_index()
    return table, learn.aib(table.to_numpy())[0]


@query()
def aib_histogram(spark, sf_dir):
    table, parents = _aib(spark, sf_dir)
    leaf = spark.createDataFrame([(b, k) for k, b in enumerate(table.index)], "p_brand string, node int")
    rows = read(spark, sf_dir, "part").join(F.broadcast(leaf), "p_brand")
    return trees.histogram(rows, trees.ancestors(spark, trees.parents_frame(spark, parents)))


@query()
def aib_cut(spark, sf_dir):
    table, parents = _aib(spark, sf_dir)
    return spark.createDataFrame([(b, int(c)) for b, c in zip(table.index, learn.aib_cut(parents, min(5, int(np.sum(parents[: len(table)] >= 0)))))], "p_brand string, cluster int")


@query("WITH w AS (SELECT doc_id % 27 AS node FROM documents) SELECT level::INTEGER AS level, node // CASE level WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END AS node, count(*)::BIGINT AS n FROM w CROSS JOIN range(3) l(level) GROUP BY ALL")
def word_levels(spark, sf_dir):
    return trees.levels(read(spark, sf_dir, "documents").select((F.col("doc_id") % 27).alias("node")), 3, 3)
