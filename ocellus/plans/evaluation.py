"""Queries: ranked-retrieval metrics, temporal overlap, PR and ROC curves, result paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ocellus.functions import paths, vec
from ocellus.operators import evaluate, scoring
from ocellus.plans.fixtures import EMB, embeddings, read
from ocellus.plans.registry import query

R = 6

_RANKED = f"""{EMB}, p AS (SELECT q.vec_id AS query_id, q.label AS ql, i.vec_id AS item_id, i.label, round(-list_inner_product(q.e, i.e), 9) AS score FROM emb q JOIN emb i ON q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rank FROM p),
t AS (SELECT query_id, count(*) AS n FROM p WHERE ql = label GROUP BY ALL),
h AS (SELECT *, (ql = label)::INTEGER AS hit FROM r WHERE rank <= 50),
c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec FROM h),
ap AS (SELECT query_id, sum(CASE WHEN hit = 1 THEN prec ELSE 0 END) / any_value(n) AS ap, max(CASE WHEN rank = 1 THEN hit ELSE 0 END)::DOUBLE AS p1 FROM c JOIN t USING (query_id) GROUP BY query_id)"""


def _ap(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"), F.col("e").alias("q"))
    pairs = scoring.compared(q, e).filter("query_id <> vec_id")
    found = scoring.ranked(pairs.select("query_id", F.col("vec_id").alias("item_id"), F.round(-vec.dot(F.col("q"), F.col("e")), 9).alias("score")), 50)
    truth = pairs.filter("ql = label").select("query_id", F.col("vec_id").alias("clip"))
    return evaluate.average_precision(found.withColumnRenamed("item_id", "clip"), truth)


@query(f"WITH {_RANKED} SELECT query_id, round(ap, 6) AS ap FROM ap")
def ap_per_query(spark, sf_dir):
    return _ap(spark, sf_dir).select("query_id", F.round("ap", R).alias("ap"))


@query(f"WITH {_RANKED} SELECT round(avg(ap), 6) AS mean_ap, round(avg(p1), 6) AS mean_p1 FROM ap")
def mean_ap(spark, sf_dir):
    return _ap(spark, sf_dir).agg(F.round(F.avg("ap"), R).alias("mean_ap"), F.round(F.avg("p1"), R).alias("mean_p1"))


@query(f"WITH {_RANKED} SELECT query_id, p1 FROM ap")
def p_at_1(spark, sf_dir):
    return _ap(spark, sf_dir).select("query_id", "p1")


# Segments: an event is found for 0-9 seconds from its second of the day; the truth is shifted.
_SEG = """g AS (SELECT user_id % 20 AS query_id, user_id AS clip, (floor(epoch(ts))::BIGINT % 3600) AS s, event_id FROM events),
f AS (SELECT query_id, clip, s AS start, s + event_id % 10 AS stop FROM g), tr AS (SELECT query_id, clip, greatest(s + event_id % 4 - 1 - 1, 0) AS start, s + event_id % 4 + 5 + 1 AS stop FROM g),
fs AS (SELECT DISTINCT query_id, clip, unnest(range(start, stop + 1)) AS s FROM f), ts AS (SELECT DISTINCT query_id, clip, unnest(range(start, stop + 1)) AS s FROM tr),
b AS (SELECT coalesce(fs.query_id, ts.query_id) AS query_id, coalesce(fs.clip, ts.clip) AS clip, (fs.s IS NOT NULL AND ts.s IS NOT NULL)::INTEGER AS i, ts.s IS NOT NULL AS t FROM fs FULL JOIN ts ON fs.query_id = ts.query_id AND fs.clip = ts.clip AND fs.s = ts.s),
c AS (SELECT query_id, clip, sum(i) / count(*) AS j, bool_or(t) AS t FROM b GROUP BY ALL)"""


@query(f"WITH {_SEG} SELECT query_id, round(sum(j) / count(*), 6) AS jaccard FROM c WHERE t GROUP BY ALL")
def temporal_jaccard(spark, sf_dir):
    g = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("query_id"), F.col("user_id").alias("clip"), F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600)).alias("s"), "event_id")
    found = g.select("query_id", "clip", F.col("s").alias("start"), (F.col("s") + F.col("event_id") % 10).alias("stop"))
    truth = g.select("query_id", "clip", (F.col("s") + F.col("event_id") % 4 - 1).alias("start"), (F.col("s") + F.col("event_id") % 4 + 5).alias("stop"))
    return evaluate.temporal_jaccard(found, truth, 1).select("query_id", F.round("jaccard", R).alias("jaccard"))


@query(
    """WITH f AS (SELECT user_id AS clip, list(DISTINCT greatest(minute(ts) - 4, 0)) AS a FROM events GROUP BY ALL), t AS (SELECT user_id AS clip, list(DISTINCT minute(ts)::BIGINT) AS b FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT clip, len(list_intersect(a, b))::INTEGER AS common, len(list_distinct(list_concat(a, b)))::INTEGER AS either FROM f JOIN t USING (clip)"""
)
def frames_jaccard(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    f = e.groupBy(F.col("user_id").alias("clip")).agg(F.collect_set(F.greatest(F.minute("ts") - 4, F.lit(0))).alias("a"))
    t = e.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("clip")).agg(F.collect_set(F.minute("ts")).alias("b"))
    return f.join(t, "clip").select("clip", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"))


_SCORED = """s AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER w AS pos, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN label <= 0 THEN 1 ELSE 0 END) OVER w AS fp, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER () AS np, sum(CASE WHEN label <= 0 THEN 1 ELSE 0 END) OVER () AS nn FROM s WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / np AS r, tp / np AS tpr, fp / nn AS fpr FROM o),
l AS (SELECT *, coalesce(lag(p) OVER (ORDER BY pos), 1) AS lp, coalesce(lag(r) OVER (ORDER BY pos), 0) AS lr, coalesce(lag(fpr) OVER (ORDER BY pos), 0) AS lf FROM pr)"""


def _scored(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"), "score")


@query(f"WITH {_SCORED} SELECT id, pos::INTEGER AS pos, round(p, 6) AS precision, round(r, 6) AS recall FROM pr")
def pr_curve(spark, sf_dir):
    return evaluate.pr_curve(_scored(spark, sf_dir)).select("id", "pos", F.round("precision", R).alias("precision"), F.round("recall", R).alias("recall"))


@query(f"WITH {_SCORED}, b AS (SELECT t, coalesce((SELECT max(p) FROM pr WHERE r >= t / 10), 0) AS best FROM range(11) x(t)) SELECT round(sum(CASE WHEN label > 0 THEN p ELSE 0 END) / max(np), 6) AS ap, round(sum((p + lp) / 2 * (r - lr)), 6) AS auc, round((SELECT sum(best) / 11 FROM b), 6) AS ap11 FROM l")
def pr_summary(spark, sf_dir):
    out = evaluate.pr_summary(_scored(spark, sf_dir))
    return out.select(*[F.round(c, R).alias(c) for c in ("ap", "auc", "ap11")])


@query(f"WITH {_SCORED} SELECT id, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS tnr, round(1 - tpr, 6) AS fnr FROM pr")
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(_scored(spark, sf_dir)).select("id", *[F.round(c, R).alias(c) for c in ("tpr", "fpr", "tnr", "fnr")])


@query(f"WITH {_SCORED}, e AS (SELECT (1 - tpr + fpr) / 2 AS eer FROM l WHERE 1 - tpr <= fpr ORDER BY pos LIMIT 1) SELECT round(sum(tpr * (fpr - lf)), 6) AS auc, round((SELECT eer FROM e), 6) AS eer FROM l")
def roc_summary(spark, sf_dir):
    out = evaluate.roc_summary(_scored(spark, sf_dir))
    return out.select(F.round("auc", R).alias("auc"), F.round("eer", R).alias("eer"))


@query(f"WITH {_SCORED} SELECT id, round(CASE WHEN tp + fp > 0 THEN tp / np * 0.1 / (tp / np * 0.1 + fp / nn * 0.9) ELSE 0 END, 6) AS precision FROM pr")
def pr_prior(spark, sf_dir):
    return evaluate.reweighted(evaluate.pr_curve(_scored(spark, sf_dir)), 0.1).select("id", F.round("precision", R).alias("precision"))


def _deviate(p: str) -> str:
    x = f"(2 * ({p}) - 1)"
    log = f"ln(1 - {x} * {x})"
    t = f"(2 / (pi() * 0.147) + {log} / 2)"
    return f"round(CASE WHEN {p} <= 1e-6 THEN -4.753424308822899 WHEN {p} >= 1 - 1e-6 THEN 4.753424308822899 ELSE sign({x}) * sqrt(greatest(0, sqrt({t} * {t} - {log} / 0.147) - {t})) * sqrt(2) END, 4) + 0"


@query(f"WITH {_SCORED} SELECT id, round(1 - tpr, 6) AS miss, round(fpr, 6) AS alarm, {_deviate('1 - tpr')} AS miss_deviate, {_deviate('fpr')} AS alarm_deviate FROM pr")
def det_curve(spark, sf_dir):
    d = evaluate.det_curve(_scored(spark, sf_dir))
    return d.select("id", F.round("fnr", R).alias("miss"), F.round("fpr", R).alias("alarm"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("miss_deviate", "alarm_deviate")])


@query("SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '.siftb' AS swapped, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", paths.with_extension(u, ".siftb").alias("swapped"), paths.dirname(u).alias("dir"), paths.basename(u).alias("base"))


@query("WITH p AS (SELECT vec_id, 'kf/' || label || '/clip_' || (vec_id // 10) || '_' || lpad(vec_id::VARCHAR, 6, '0') || '.jpg' AS path FROM embeddings) SELECT vec_id, regexp_replace(path, '_[^_]*$', '') || '.mp4' AS clip, regexp_extract(path, '_([0-9]+)\\.[^.]*$', 1)::BIGINT AS frame FROM p")
def path_to_clip(spark, sf_dir):
    p = F.concat(F.lit("kf/"), "label", F.lit("/clip_"), F.expr("vec_id div 10"), F.lit("_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".jpg"))
    return embeddings(spark, sf_dir).select("vec_id", paths.keyframe_clip(p).alias("clip"), paths.keyframe_number(p).alias("frame"))


@query("WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 60)::VARCHAR WHEN 1 THEN (event_id % 7) || ':' || (event_id % 60) WHEN 2 THEN '1:' || (event_id % 60) || ':' || (event_id % 59) ELSE '1:2:3:4' END AS t FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 60 WHEN 1 THEN event_id % 7 * 60 + event_id % 60 WHEN 2 THEN 3600 + event_id % 60 * 60 + event_id % 59 ELSE -1 END::INTEGER AS seconds FROM t")
def time_parse(spark, sf_dir):
    i = F.col("event_id")
    m = lambda n: (i % n).cast("string")
    t = F.when(i % 4 == 0, m(60)).when(i % 4 == 1, F.concat_ws(":", m(7), m(60))).when(i % 4 == 2, F.concat_ws(":", F.lit("1"), m(60), m(59))).otherwise("1:2:3:4")
    return read(spark, sf_dir, "events").select("event_id", vec.seconds(t).alias("seconds"))


@query("WITH r AS (SELECT user_id AS query_id, event_type AS clip, min(event_id) AS seen FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS rank FROM r) SELECT query_id, clip, rank::INTEGER AS rank FROM o WHERE rank <= 3")
def results_to_clips(spark, sf_dir):
    ranked = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("clip"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    return scoring.first_per_clip(ranked, 3).select("query_id", "clip", "rank")
