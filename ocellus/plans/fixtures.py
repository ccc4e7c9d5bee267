"""Views of the test tables as the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import vec

QUERY_EVERY = 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, e: the vector in doubles."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("e"))


EMB = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, clip, d: each vector as eight local descriptors of 8 elements, ten vectors a clip."""
    parts = embeddings(spark, sf_dir).select(F.col("vec_id").alias("v"), "label", F.posexplode(F.array(*[vec.word(F.col("e"), k, 8) for k in range(8)])).alias("f", "d"))
    return parts.select((F.col("v") * 8 + F.col("f")).alias("vec_id"), "label", F.expr("v div 10").alias("clip"), "d")


DESC = "descr AS (SELECT vec_id * 8 + f AS vec_id, label, vec_id // 10 AS clip, (embedding::DOUBLE[])[8 * f + 1 : 8 * f + 8] AS d FROM embeddings CROSS JOIN range(8) r(f))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, fv (2 words of 32), bits (2 packed words), strengths (L1 of each word)."""
    e = embeddings(spark, sf_dir)
    words = [vec.word(F.col("e"), k, 32) for k in range(2)]
    return e.select(F.col("vec_id").alias("item_id"), F.col("e").alias("fv"), F.array(*[vec.pack_signs(w) for w in words]).alias("bits"), F.array(*[vec.l1(w) for w in words]).alias("strengths"))


def as_queries(items_: DataFrame) -> DataFrame:
    return items_.filter(F.col("item_id") % QUERY_EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("fv").alias("q_fv"), F.col("bits").alias("q_bits"), F.col("strengths").alias("q_strengths"))


def as_database(items_: DataFrame) -> DataFrame:
    return items_.select("item_id", F.col("fv").alias("d_fv"), F.col("bits").alias("d_bits"), F.col("strengths").alias("d_strengths"))


def _packed(a: int) -> str:
    return f"list_sum(list_transform(range(1, 33), lambda i: CASE WHEN e[{a} + i] > 0 THEN 1::BIGINT << (32 - i) ELSE 0::BIGINT END))::BIGINT"


ITEMS = f"""{EMB},
items AS (SELECT vec_id AS item_id, e[1:32] AS f0, e[33:64] AS f1, {_packed(0)} AS b0, {_packed(32)} AS b1,
  list_sum(list_transform(e[1:32], lambda x: abs(x))) AS s0, list_sum(list_transform(e[33:64], lambda x: abs(x))) AS s1 FROM emb)"""


def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Gaussian for each label, in closed form: k, w, mu, sigma (variances + 1e-6) of the descriptors."""
    d = descriptors(spark, sf_dir)
    long = d.select("label", F.posexplode("d").alias("j", "x"))
    stats = long.groupBy("label", "j").agg(F.avg("x").alias("mu"), (F.var_pop("x") + 1e-6).alias("sigma"), F.count(F.lit(1)).alias("n"))
    rows = stats.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "mu", "sigma"))).alias("s"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return rows.join(F.broadcast(total)).select(F.col("label").alias("k"), (F.col("n") / F.col("total")).alias("w"), F.col("s.mu").alias("mu"), F.col("s.sigma").alias("sigma"))


GMM = f"""{DESC},
dlong AS (SELECT vec_id, label, clip, unnest(range(1, 9)) AS j, unnest(d) AS x FROM descr),
gstat AS (SELECT label AS k, j, avg(x) AS mu, var_pop(x) + 1e-6 AS sigma FROM dlong GROUP BY ALL),
gw AS (SELECT label AS k, count(*)::DOUBLE / (SELECT count(*) FROM descr) AS w FROM descr GROUP BY ALL)"""

POSTERIOR = f"""{GMM},
gconst AS (SELECT k, ln(any_value(w)) - 0.5 * (8 * ln(2 * pi()) + sum(ln(sigma))) AS c FROM gstat JOIN gw USING (k) GROUP BY k),
mahal AS (SELECT vec_id, clip, k, sum((x - mu) * (x - mu) / sigma) AS m FROM dlong JOIN gstat USING (j) GROUP BY ALL),
lp AS (SELECT vec_id, clip, k, c - 0.5 * m AS l FROM mahal JOIN gconst USING (k)),
mx AS (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM lp),
post AS (SELECT vec_id, clip, k, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY vec_id) AS p FROM mx)"""
