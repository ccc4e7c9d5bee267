"""Queries of the statistics toolbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import paths, vec
from ocellus.operators import stats
from ocellus.plans.fixtures import EMB, embeddings, read
from ocellus.plans.registry import query

R = 6


def _r(c, name=None):
    return F.round(c, R).alias(name or c)


@query("SELECT greatest(least(l_quantity::BIGINT, 29), 0) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def int_histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 30)


@query("SELECT greatest(least(floor((l_extendedprice - 1000) / 49000 * 25)::BIGINT, 24), 0) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def float_histogram(spark, sf_dir):
    return stats.range_histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 1000.0, 50000.0, 25)


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def joint_histogram(spark, sf_dir):
    return stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def histogram_marginal(spark, sf_dir):
    return stats.marginal(stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_size"), ["p_brand"])


_EDGES = [1.0, 5.0, 10.0, 20.0, 35.0, 50.0]
_BIN = " + ".join(f"(l_quantity >= {e})::INTEGER" for e in _EDGES)


@query(f"SELECT l_orderkey, l_linenumber, {_BIN} AS bin FROM lineitem")
def bin_search(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.bin_search(F.col("l_quantity"), _EDGES).alias("bin"))


@query(f"WITH b AS (SELECT {_BIN} AS bin, l_quantity, l_discount FROM lineitem) SELECT bin, round(sum(l_discount), 4) AS w FROM b WHERE bin > 0 AND (bin < 6 OR l_quantity = 50) GROUP BY ALL")
def weighted_hist(spark, sf_dir):
    return stats.weighted_histogram(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", _EDGES).select("bin", F.round("w", 4).alias("w"))


@query("WITH s AS (SELECT l_linenumber % 5 AS idx, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY ALL) SELECT n_nationkey AS idx, round(n_regionkey + coalesce(t, 0), 2) AS total FROM nation LEFT JOIN s ON idx = n_nationkey")
def binned_sum(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).alias("idx"), "l_quantity")
    acc = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").cast("double").alias("total"))
    return stats.binned_sum(rows, "idx", "l_quantity", acc).select("idx", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS csum, max(o_totalprice) OVER w AS cmax, round(o_totalprice - coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0), 2) AS diff FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def cumulative(spark, sf_dir):
    return stats.cumulative(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", "o_custkey").select("o_orderkey", F.round("csum", 2).alias("csum"), "cmax", F.round("diff", 2).alias("diff"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice AS v, lag(o_totalprice) OVER w AS a, lead(o_totalprice) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE v > a AND v > z")
def local_maxima(spark, sf_dir):
    return stats.local_maxima(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", "o_custkey").select("o_orderkey")


@query("WITH v AS (SELECT p_partkey, p_brand, p_size FROM part) SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) - 1)::BIGINT AS min_rank, (count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE UNBOUNDED PRECEDING))::BIGINT AS max_rank FROM v")
def minmax_rank(spark, sf_dir):
    return stats.min_max_ranks(read(spark, sf_dir, "part"), "p_size", "p_brand").select("p_partkey", "min_rank", "max_rank")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 2")
def k_least(spark, sf_dir):
    return stats.k_least(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 2, "o_custkey").select("o_orderkey", "o_custkey", "rank")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 20")
def k_largest(spark, sf_dir):
    return stats.k_least(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 20, largest=True).select("o_orderkey", "rank")


@query("""WITH v AS (SELECT label, list_sum(e) AS x, vec_id FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))
SELECT label, count_if(isnan(x)) AS n_nan, count_if(x = 0) AS n_zero, count_if(x > 0) AS n_gt, count_if(x < 0) AS n_lt, round(sum(x), 6) AS total, round(avg(x), 6) AS mean, round(sum(x * x), 6) AS sum_sq, round(sqrt(sum(x * x)), 6) AS norm2,
round(sum(abs(x)), 6) AS norm1, round(min(x), 6) AS least, round(max(x), 6) AS most, arg_min(vec_id, x) AS argmin, arg_max(vec_id, x) AS argmax FROM v GROUP BY label""")
def vector_summary(spark, sf_dir):
    v = embeddings(spark, sf_dir).select("label", "vec_id", vec.total(F.col("e")).alias("x"))
    out = v.groupBy("label").agg(*stats.summary("x", "vec_id"))
    return out.select(*[_r(c) if c in ("total", "mean", "sum_sq", "norm2", "norm1", "least", "most") else F.col(c) for c in out.columns])


@query("SELECT l_returnflag, median(l_extendedprice) AS median, quantile_disc(l_extendedprice, 0.25) AS quantile FROM lineitem GROUP BY ALL")
def median_quantile(spark, sf_dir):
    return stats.order_statistics(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", 0.25)


@query("WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS p FROM h) SELECT p_brand, round(sum(-p * log2(p)), 6) AS entropy, round(count(*) * sum(n * n) / (sum(n) * sum(n)), 6) AS unbalance FROM p GROUP BY ALL")
def entropy(spark, sf_dir):
    return stats.entropy(stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_size"), "p_brand").select("p_brand", _r("entropy"), _r("unbalance"))


@query("WITH h AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM h) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi, round(sum(-n / t * ln(n / t)), 6) AS h FROM t")
def mutual_information(spark, sf_dir):
    return stats.mutual_information(stats.joint_histogram(read(spark, sf_dir, "part"), "p_brand", "p_type"), "p_brand", "p_type").select(_r("mi"), _r("h"))


@query(f"WITH {EMB}, x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS x FROM emb) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(avg(a.x), 6) + 0 AS mean_i, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 6) + 0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def covariance(spark, sf_dir):
    d = embeddings(spark, sf_dir).select(F.col("e").alias("d"))
    return stats.covariance(d, "d").select("i", "j", (F.round("mean_i", R) + 0.0).alias("mean_i"), (F.round("cov", R) + 0.0).alias("cov"))


_GRID = "g AS (SELECT n_regionkey AS r, n_nationkey % 5 AS c, count(*) AS v FROM nation GROUP BY ALL), grid AS (SELECT a.r, b.c, coalesce(v, 0)::BIGINT AS v FROM (SELECT unnest(range(0, 5)) AS r) a CROSS JOIN (SELECT unnest(range(0, 5)) AS c) b LEFT JOIN g ON g.r = a.r AND g.c = b.c), it AS (SELECT x.r, x.c, sum(y.v)::BIGINT AS area FROM grid x JOIN grid y ON y.r <= x.r AND y.c <= x.c GROUP BY ALL)"


def _grid(spark, sf_dir):
    cells = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("r"), (F.col("n_nationkey") % 5).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("v"))
    full = spark.range(5).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("c"))
    return stats.integral(full.join(cells, ["r", "c"], "left").fillna(0, ["v"]), "r", "c", "v")


@query(f"WITH {_GRID} SELECT r, c, area FROM it")
def integral_image(spark, sf_dir):
    return _grid(spark, sf_dir).select("r", "c", "area")


@query(f"WITH {_GRID}, b AS (SELECT n_nationkey AS id, n_nationkey % 3 AS r0, n_nationkey % 4 AS c0, n_nationkey % 3 + 2 AS r1, n_nationkey % 4 + 1 AS c1 FROM nation) SELECT id, sum(v)::BIGINT AS total FROM b JOIN grid ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY ALL")
def box_sums(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    boxes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (k % 3).alias("r0"), (k % 4).alias("c0"), (k % 3 + 2).alias("r1"), (k % 4 + 1).alias("c1"))
    return stats.box_sums(_grid(spark, sf_dir), boxes, "r", "c").select("id", "total")


@query(
    f"""WITH {EMB}, x AS (SELECT vec_id AS r, unnest(range(0, 64)) AS c, unnest(list_transform(e, lambda v: least(3, greatest(0, floor(v * 2) + 2)))) AS bin FROM emb),
b AS (SELECT vec_id AS id, vec_id AS r0, vec_id + 20 AS r1, vec_id % 7 AS c0, vec_id % 7 + 30 AS c1 FROM emb WHERE vec_id % 50 = 0 AND vec_id + 20 <= (SELECT max(vec_id) FROM emb))
SELECT id, bin::INTEGER AS bin, count(*) AS n FROM b JOIN x ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY ALL"""
)
def integral_histogram(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    x = e.select(F.col("vec_id").alias("r"), F.posexplode("e").alias("c", "v")).withColumn("c", F.col("c").cast("long"))
    cells = x.withColumn("bin", F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col("v") * 2) + 2)))
    table = stats.integral_histogram(cells, "r", "c", "bin", 4)
    k, last = F.col("vec_id"), e.agg(F.max("vec_id").alias("last"))
    boxes = e.filter(k % 50 == 0).join(F.broadcast(last)).filter(k + 20 <= F.col("last")).select(k.alias("id"), k.alias("r0"), (k % 7).alias("c0"), (k + 20).alias("r1"), (k % 7 + 30).alias("c1"))
    return stats.box_histograms(table, boxes, "r", "c").filter("n > 0")


@query(f"WITH {EMB}, x AS (SELECT label AS i, unnest(range(0, 64)) AS j, unnest(e) AS v FROM emb), m AS (SELECT i, j, sum(v) AS v FROM x GROUP BY ALL) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 5) + 0 AS v FROM m a JOIN m b ON a.j = b.j GROUP BY ALL")
def matrix_product(spark, sf_dir):
    m = embeddings(spark, sf_dir).select(F.col("label").alias("i"), F.posexplode("e").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    t = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return stats.matrix_product(m, t).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


@query("SELECT s_nationkey % 5 AS ci, l_linenumber % 2 AS cj, round(sum(l_quantity), 2) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def block_sums(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 5).alias("ci"))
    cols = li.select("j").distinct().withColumn("cj", F.col("j") % 2)
    return stats.block_sums(li, rows, cols).select("ci", "cj", F.round("v", 2).alias("v"))


@query("SELECT l_orderkey AS label, 0 AS source FROM lineitem UNION ALL SELECT o_orderkey, 1 FROM orders")
def ordered_merge(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"))
    return stats.merge_ordered(a, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label")))


@query("WITH n AS (SELECT c_custkey, 'B' || (c_custkey % 37) || 'x' || (c_custkey % 113) AS name, c_mktsegment FROM customer) SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 37, c_custkey % 113, c_custkey)::INTEGER AS rank FROM n")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("c_custkey")
    name = F.concat(F.lit("B"), k % 37, F.lit("x"), k % 113)
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", paths.natural_key(name).alias("key"))
    return rows.select("c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("key", "c_custkey")).alias("rank"))


@query("SELECT item_id, ordinal FROM (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents UNION ALL SELECT page_id + 1000000, row_number() OVER (ORDER BY page_id) - 1 + (SELECT count(*) FROM documents) FROM pages)")
def index_concat(spark, sf_dir):
    from ocellus.operators.index import concatenated

    parts = [read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), read(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("item_id"))]
    return concatenated(parts, "item_id").select("item_id", "ordinal")


@query("SELECT vec_id FROM embeddings WHERE NOT list_bool_or(list_transform(range(1, 65), lambda i: vec_id % 17 = 0 OR isnan(embedding[i])))")
def nan_purge(spark, sf_dir):
    bad = F.transform("e", lambda x: F.when(F.col("vec_id") % 17 == 0, F.lit(float("nan"))).otherwise(x))
    return embeddings(spark, sf_dir).withColumn("e", bad).filter(~F.exists("e", lambda x: F.isnan(x))).select("vec_id")


@query(f"WITH {EMB}, s AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN abs(x) > 0.15 THEN x ELSE 0 END) AS v FROM emb) SELECT a.vec_id, len(list_filter(a.v, lambda x: x <> 0))::INTEGER AS nz, round(list_inner_product(a.v, b.v), 6) + 0 AS dot FROM s a JOIN s b ON b.vec_id = 0")
def sparse_dot(spark, sf_dir):
    s = embeddings(spark, sf_dir).select("vec_id", vec.sparse(F.transform("e", lambda x: F.when(F.abs(x) > 0.15, x).otherwise(0.0))).alias("v"))
    one = s.filter("vec_id = 0").select(F.col("v").alias("o"))
    return s.join(F.broadcast(one)).select("vec_id", F.size("v").alias("nz"), (F.round(vec.sparse_dot(F.col("v"), F.col("o")), R) + 0.0).alias("dot"))


@query("SELECT o_orderkey AS label, coalesce((SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45), -1)::INTEGER AS pos FROM orders")
def find_labels(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("pos"))
    return stats.find_first(t, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"))).select("label", F.col("pos").cast("int").alias("pos"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice < m * 1.5")
def ratio_compress(spark, sf_dir):
    return stats.below_ratio(read(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", 1.5).select("o_orderkey")


_PIX = "px AS (SELECT l_linenumber::BIGINT AS r, floor(l_quantity / 5)::BIGINT AS c, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL)"


@query(f"WITH {_PIX} SELECT a.r, a.c, a.v FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY ALL HAVING count(*) = 8 AND max(b.v) < a.v")
def local_maxima_grid(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_linenumber").cast("long").alias("r"), F.floor(F.col("l_quantity") / 5).alias("c")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return stats.local_maxima_grid(cells, "r", "c", "v")


@query(f"WITH {EMB}, x AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, unnest(e) AS v FROM emb), s AS (SELECT i - 10 AS i, j - 2 AS j, v FROM x WHERE i >= 10 AND j >= 2 AND j < 6), b AS (SELECT i, j, v FROM s UNION ALL SELECT i + 1000000, j, v FROM s), m AS (SELECT j, avg(v) AS m FROM b GROUP BY j) SELECT i, j, round(v - m, 6) + 0 AS v FROM b JOIN m USING (j)")
def submatrix_stack(spark, sf_dir):
    from ocellus.operators import linear

    x = embeddings(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("e").alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    s = linear.submatrix(x, (10, 1 << 40), (2, 6))
    return linear.centered(linear.stacked(s, s, 1_000_000)).select("i", "j", (F.round("v", R) + 0.0).alias("v"))


@query("SELECT p_size % 4 AS g, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_retailprice DESC, p_partkey) <= 1")
def argmax_per_group(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("g"), "p_partkey", "p_retailprice")
    return stats.k_least(p, "p_retailprice", "p_partkey", 1, "g", largest=True).select("g", "p_partkey")
