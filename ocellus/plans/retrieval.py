"""Queries: packed words, scores in all modes, ranking, reranking, neighbours, inverted Bloom index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import vec
from ocellus.operators import bloom, neighbours, scoring
from ocellus.operators.scoring import QueryParams
from ocellus.plans.fixtures import EMB, ITEMS, as_database, as_queries, embeddings, items
from ocellus.plans.registry import query

R = 6


@query(f"WITH {ITEMS} SELECT item_id AS vec_id, b0 AS w0, b1 AS w1 FROM items")
def binarize_words(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("item_id").alias("vec_id"), F.col("bits")[0].alias("w0"), F.col("bits")[1].alias("w1"))


_TOP = """, pairs AS (SELECT q.item_id AS query_id, i.item_id, {score} AS score FROM items q JOIN items i ON q.item_id % 100 = 0 {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS rank FROM pairs)
SELECT query_id, item_id, {out} AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


@query("WITH " + ITEMS + _TOP.format(score="bit_count(xor(q.b0, i.b0)) + bit_count(xor(q.b1, i.b1))", on="AND q.item_id <> i.item_id", order="score", out="score::BIGINT"))
def hamming_topk(spark, sf_dir):
    it = items(spark, sf_dir)
    pairs = scoring.compared(as_queries(it), as_database(it)).filter("query_id <> item_id")
    pairs = pairs.select("query_id", "item_id", sum(vec.hamming(F.col("q_bits")[k], F.col("d_bits")[k]) for k in range(2)).cast("long").alias("score"))
    return scoring.ranked(pairs, 5)


def _energy(x: str, k: int, fv: bool) -> str:
    return f"list_inner_product({x}.f{k}, {x}.f{k})" if fv else "32.0::DOUBLE"


def _like(k: int, fv: bool) -> str:
    if fv:
        return f"list_inner_product(q.f{k}, i.f{k})"
    h = f"bit_count(xor(q.b{k}, i.b{k}))"
    return f"CASE WHEN {h} < 16 THEN ((32 - {h}) / 32.0::DOUBLE) / 2 * (32 - 2 * {h}) ELSE 0 END"


def score_sql(p: QueryParams, fv: bool) -> str:
    used = {"off": ("true", "true", "true"), "qags": ("{q}", "{q}", "{q}"), "dags": ("{d}", "{d}", "{d}"), "sgs": ("{q} AND {d}", "{q}", "{d}")}[p.mode]
    case = lambda cond, value: f"CASE WHEN {cond} THEN {value} ELSE 0 END"
    at = lambda s, k: s.format(q=f"q.s{k} > {p.threshold}", d=f"i.s{k} > {p.threshold}")
    ip = " + ".join(case(at(used[0], k), _like(k, fv)) for k in (0, 1))
    qn = " + ".join(case(at(used[1], k), _energy("q", k, fv)) for k in (0, 1))
    dn = " + ".join(case(at(used[2], k), _energy("i", k, fv)) for k in (0, 1))
    ex = " + ".join(case(at("{d}", k), _energy("i", k, fv)) for k in (0, 1))
    if p.mode == "qags":
        value = f"CASE WHEN ({qn}) <> 0 AND ({dn}) <> 0 AND ({ex}) <> 0 THEN -(({ip}) / sqrt(({qn}) * ({dn})) * pow(({ex}), {0.5 - p.power})) ELSE {scoring.FLT_MAX} END"
    else:
        value = f"CASE WHEN ({qn}) <> 0 AND ({dn}) <> 0 THEN -(({ip}) / pow(({qn}) * ({dn}), {p.power})) ELSE {scoring.FLT_MAX} END"
    if p.min_words:
        n = "2" if p.mode in ("off", "qags") else " + ".join(f"(i.s{k} > {p.threshold})::INTEGER" for k in (0, 1))
        value = f"CASE WHEN {n} <= {p.min_words} THEN {scoring.FLT_MAX} ELSE {value} END"
    return "WITH " + ITEMS + _TOP.format(score=f"round({value}, 9)", on="", order="score", out=f"round(score, {R})")


def _search(name: str, p: QueryParams, fv: bool):
    def run(spark, sf_dir):
        it = items(spark, sf_dir)
        drop = "bits" if fv else "fv"
        q, d = as_queries(it).drop(f"q_{drop}"), as_database(it).drop(f"d_{drop}")
        pairs = scoring.scored_pairs(q, d, p).withColumn("score", F.round("score", 9))
        return scoring.ranked(pairs, p.top_k).withColumn("score", F.round("score", R))

    run.__name__ = name
    query(score_sql(p, fv))(run)


_T = 3.6
for _name, _p, _fv in (
    ("weighted_hamming_topk", QueryParams(mode="off", power=0.5), False),
    ("score_off_fv", QueryParams(mode="off", power=0.5), True),
    ("score_qags_fv", QueryParams(mode="qags", threshold=_T, power=-0.3), True),
    ("score_dags_fv", QueryParams(mode="dags", threshold=_T, power=0.4), True),
    ("score_sgs_fv", QueryParams(mode="sgs", threshold=_T, power=0.5), True),
    ("score_qags_binary", QueryParams(mode="qags", threshold=_T, power=0.3), False),
    ("score_dags_binary", QueryParams(mode="dags", threshold=_T, power=0.5), False),
    ("score_sgs_binary", QueryParams(mode="sgs", threshold=_T, power=0.5), False),
    ("min_words_filter", QueryParams(mode="dags", threshold=_T, power=0.5, min_words=1), True),
):
    _search(_name, _p, _fv)


_RERANK = (
    "WITH "
    + ITEMS
    + """, g AS (SELECT item_id // 10 AS scene, item_id FROM items),
s1 AS (SELECT q.item_id AS query_id, g.scene, max(list_inner_product(q.f0, i.f0)) AS sim FROM items q JOIN items i ON q.item_id % 100 = 0 JOIN g ON g.item_id = i.item_id GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-sim, 9), scene) AS r FROM s1),
s2 AS (SELECT t.query_id, i.item_id, round(-(list_inner_product(q.f0, i.f0) + list_inner_product(q.f1, i.f1)), 9) AS score
  FROM t JOIN g USING (scene) JOIN items i ON i.item_id = g.item_id JOIN items q ON q.item_id = t.query_id WHERE t.r <= 8),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rank FROM s2)
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM z WHERE rank <= 5"""
)


@query(_RERANK)
def two_stage_rerank(spark, sf_dir):
    it = items(spark, sf_dir)
    pairs = scoring.compared(as_queries(it), as_database(it))
    scene = F.expr("item_id div 10")
    first = pairs.groupBy("query_id", scene.alias("item_id")).agg(F.round(-F.max(vec.dot(vec.word(F.col("q_fv"), 0, 32), vec.word(F.col("d_fv"), 0, 32))), 9).alias("score"))
    groups = it.select(scene.alias("group_id"), F.col("item_id").alias("member_id"))
    value = F.round(-sum(vec.dot(vec.word(F.col("q_fv"), k, 32), vec.word(F.col("d_fv"), k, 32)) for k in range(2)), 9)
    return scoring.rescore(scoring.ranked(first, 8), groups, as_queries(it), as_database(it), value, 8, 5).select("query_id", "item_id", F.round("score", R).alias("score"), "rank")


@query(
    "WITH "
    + EMB
    + """, p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.vec_id // 10 AS clip, round(-list_inner_product(q.e, i.e), 9) AS score FROM emb q JOIN emb i ON q.vec_id % 100 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS r FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, clip ORDER BY r) AS n FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM c WHERE n = 1)
SELECT query_id, item_id, clip, round(score, 6) AS score, rank::INTEGER AS rank FROM d WHERE rank <= 5"""
)
def dedupe_by_clip(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    pairs = scoring.compared(q, e).select("query_id", F.col("vec_id").alias("item_id"), F.expr("vec_id div 10").alias("clip"), F.round(-vec.dot(F.col("q"), F.col("e")), 9).alias("score"))
    return scoring.best_per_clip(pairs, 5).select("query_id", "item_id", "clip", F.round("score", R).alias("score"), "rank")


@query("SELECT q.vec_id AS query_id, list_sum(list_transform(q.embedding::DOUBLE[], lambda x: abs(x))) > 0 AS found FROM embeddings q WHERE vec_id % 100 = 0")
def query_descriptors(spark, sf_dir):
    it = embeddings(spark, sf_dir).filter("vec_id % 100 = 0")
    queries, given = it.select(F.col("vec_id").alias("query_id")), it.select(F.col("vec_id").alias("query_id"), "e")
    return scoring.with_descriptors(queries, given).select("query_id", (vec.l1(F.col("e")) > 0).alias("found"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def unfinished_items(spark, sf_dir):
    from ocellus.operators import index
    from ocellus.plans.fixtures import read

    return index.unfinished(read(spark, sf_dir, "embeddings").select("vec_id"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    from ocellus.plans.fixtures import read

    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


_DIST = {
    "l2": "(x - y) * (x - y)",
    "l1": "abs(x - y)",
    "chi2": "CASE WHEN x + y <> 0 THEN (x - y) * (x - y) / (x + y) ELSE 0 END",
    "hellinger": "x + y - 2 * sqrt(x * y)",
    "js": "CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END",
    "kl1": "least(x, y)",
    "kchi2": "CASE WHEN x + y <> 0 THEN 2 * x * y / (x + y) ELSE 0 END",
    "khell": "sqrt(x * y)",
    "kjs": "(CASE WHEN x > 0 THEN x * log2(x / (x * x / (x + y))) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / (y * y / (x + y))) ELSE 0 END) / 2",
    "kl2": "x * y",
}


def _dist_sql(name: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {_DIST[name].replace('x', 'a.h[i]').replace('y', 'b.h[i]').replace('ma.h[i]', 'max')}))"


_HIST = EMB + ", hh AS (SELECT vec_id, list_transform(e, lambda v: abs(v)) AS h FROM emb)"


def _hist(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.transform("e", F.abs).alias("h"))


def _knn(metric: str):
    sql = f"""WITH {_HIST}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, round({_dist_sql(metric)}, 9) AS dist FROM hh a JOIN hh b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM p)
SELECT query_id, base_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 4"""

    def run(spark, sf_dir):
        h = _hist(spark, sf_dir)
        q = h.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("h").alias("q"))
        b = h.select(F.col("vec_id").alias("base_id"), F.col("h").alias("b"))
        return neighbours.knn(q, b, 4, metric, exclude_self=True).select("query_id", "base_id", F.round("dist", R).alias("dist"), "rank")

    run.__name__ = f"knn_{metric}"
    query(sql)(run)


for _m in ("l2", "l1", "chi2", "hellinger", "js"):
    _knn(_m)


def _knn_of(name: str, dist: str, **kw):
    sql = f"""WITH {_HIST}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, round({dist}, 9) AS dist FROM hh a JOIN hh b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM p)
SELECT query_id, base_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 4"""

    def run(spark, sf_dir):
        h = _hist(spark, sf_dir)
        q = h.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("h").alias("q"))
        b = h.select(F.col("vec_id").alias("base_id"), F.col("h").alias("b"), *([(1 + F.col("vec_id") % 3).cast("double").alias("weight")] if kw.get("weighted") else []))
        if kw.get("mahalanobis"):
            pairs = scoring.compared(q, b).filter("query_id <> base_id")
            inverse = F.array(*[F.lit(1.0 + j % 4) for j in range(64)])
            pairs = pairs.select("query_id", "base_id", F.round(vec.mahalanobis(F.col("q"), F.col("b"), inverse), 9).alias("dist"))
            return neighbours._ranked(pairs, 4).select("query_id", "base_id", F.round("dist", R).alias("dist"), "rank")
        return neighbours.knn(q, b, 4, kw.get("metric", "l2"), exclude_self=True).select("query_id", "base_id", F.round("dist", R).alias("dist"), "rank")

    run.__name__ = name
    query(sql)(run)


_EACH = "list_transform(range(1, 65), lambda i: {})"
_knn_of("knn_linf", f"list_max({_EACH.format('abs(a.h[i] - b.h[i])')})", metric="linf")
_knn_of("knn_l0", f"list_sum({_EACH.format('(a.h[i] <> b.h[i])::INTEGER')})::DOUBLE", metric="l0")
_knn_of("knn_weighted", f"list_sum({_EACH.format('(a.h[i] - b.h[i]) * (a.h[i] - b.h[i])')}) * (1 + b.vec_id % 3)", weighted=True)
_knn_of("knn_mahalanobis", f"list_sum({_EACH.format('(a.h[i] - b.h[i]) * (a.h[i] - b.h[i]) * (1 + (i - 1) % 4)')})", mahalanobis=True)


@query(f"WITH {_HIST} SELECT a.vec_id AS query_id, b.vec_id AS base_id, " + ", ".join(f"round({_dist_sql(m)}, 6) AS {m}" for m in _DIST) + " FROM hh a JOIN hh b ON a.vec_id % 100 = 0")
def pairwise_kernels(spark, sf_dir):
    h = _hist(spark, sf_dir)
    q = h.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("h").alias("q"))
    b = h.select(F.col("vec_id").alias("base_id"), F.col("h").alias("b"))
    return neighbours.pairwise(q, b, list(_DIST), R)


@query(
    f"""WITH {EMB}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, round(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))), 9) AS dist FROM emb a JOIN emb b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank, lead(dist) OVER (PARTITION BY query_id ORDER BY dist, base_id) AS second FROM p)
SELECT query_id, base_id, round(dist, 6) AS dist FROM r WHERE rank = 1 AND 1.02 * dist < second"""
)
def ratio_match(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    b = e.select(F.col("vec_id").alias("base_id"), F.col("e").alias("b"))
    return neighbours.ratio_match(q, b, 1.02, exclude_self=True).select("query_id", "base_id", F.round("dist", R).alias("dist"))


@query(
    f"""WITH {EMB}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, a.e AS q, b.e AS b FROM emb a JOIN emb b ON a.vec_id % 100 = 0 AND a.label = b.label),
p AS (SELECT query_id, base_id, round(list_sum(list_transform(range(1, 65), lambda i: (q[i] - b[i]) * (q[i] - b[i]))), 9) AS dist FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS rank FROM p)
SELECT query_id, base_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 3"""
)
def shortlist_reorder(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    short = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("base_id"), "label"), "label").drop("label")
    q, b = e.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), e.select(F.col("vec_id").alias("base_id"), F.col("e").alias("b"))
    return neighbours.reorder(short, q, b, 3).select("query_id", "base_id", F.round("dist", R).alias("dist"), "rank")


# Inverted Bloom index: a hasher for each word, ten descriptors a clip.
_POS = [3, 7, 11, 19, 23, 29]
_BITS = " | ".join(f"((({{b}} >> {p}) & 1) << {i})" for i, p in enumerate(_POS))
_POINTS = f"""{ITEMS}, points AS (SELECT item_id, item_id // 10 AS clip, 0 AS hasher, {_BITS.format(b='b0')} AS bucket FROM items UNION ALL SELECT item_id, item_id // 10, 1, {_BITS.format(b='b1')} FROM items),
postings AS (SELECT DISTINCT hasher, bucket, clip FROM points)"""
_NORMS = f"""{_POINTS}, n AS (SELECT count(DISTINCT clip) AS n FROM points), cnt AS (SELECT hasher, bucket, count(*) AS cnt FROM postings GROUP BY ALL),
idf AS (SELECT hasher, bucket, cnt, ln((n // cnt)::DOUBLE) AS idf FROM cnt, n),
norms AS (SELECT clip, pow(sum(idf * idf), 0.5) AS norm FROM postings JOIN idf USING (hasher, bucket) GROUP BY clip)"""


def _points(spark, sf_dir):
    it = items(spark, sf_dir)
    one = lambda k: it.select("item_id", F.expr("item_id div 10").alias("clip"), F.lit(k).alias("hasher"), vec.bit_sample(F.col("bits")[k], _POS).alias("bucket"))
    return one(0).unionByName(one(1))


@query(f"WITH {_POINTS} SELECT hasher, bucket, clip FROM postings")
def bloom_postings(spark, sf_dir):
    return bloom.postings(_points(spark, sf_dir))


@query(f"WITH {_NORMS} SELECT hasher, bucket, cnt, round(idf, 6) AS idf FROM idf")
def bloom_idf(spark, sf_dir):
    p = bloom.postings(_points(spark, sf_dir))
    return bloom.idf(p).select("hasher", "bucket", "cnt", F.round("idf", R).alias("idf"))


@query(f"WITH {_NORMS} SELECT clip, round(norm, 6) AS norm FROM norms")
def bloom_norm(spark, sf_dir):
    p = bloom.postings(_points(spark, sf_dir))
    return bloom.norms(p, bloom.idf(p), 0.5).select("clip", F.round("norm", R).alias("norm"))


@query(
    f"""WITH {_NORMS}, hits AS (SELECT q.item_id AS query_id, p.clip, idf * idf AS v FROM points q JOIN postings p USING (hasher, bucket) JOIN idf USING (hasher, bucket) WHERE q.item_id % 100 = 0),
s AS (SELECT query_id, clip, sum(v) AS v FROM hits GROUP BY ALL),
f AS (SELECT i.item_id AS query_id, n.clip, round(CASE WHEN norm > 0 THEN -coalesce(v, 0) / norm ELSE 0 END, 6) + 0 AS score FROM items i JOIN norms n ON i.item_id % 100 = 0 LEFT JOIN s ON s.query_id = i.item_id AND s.clip = n.clip)
SELECT query_id, clip, score FROM f"""
)
def bloom_score(spark, sf_dir):
    points = _points(spark, sf_dir)
    index = bloom.BloomIndex.fit(points, alpha=0.5)
    found = index.query(points.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "hasher", "bucket"))
    return found.select("query_id", "clip", (F.round("score", R) + 0.0).alias("score"))
