"""Queries: norms, projection, Gaussian posteriors, Fisher vectors, VLAD, point index, shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import vec
from ocellus.operators import gmm, shots
from ocellus.plans.fixtures import DESC, EMB, GMM, POSTERIOR, descriptors, embeddings, read
from ocellus.plans.fixtures import gmm as closed_gmm
from ocellus.plans.registry import query

R, MOST_TYPES = 6, 1000


def _r(c, name=None):
    return F.round(c, R).alias(name or c)


def _words(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", F.posexplode(F.array(vec.word(F.col("e"), 0, 32), vec.word(F.col("e"), 1, 32))).alias("k", "w"))


_WORDS = EMB + ", words AS (SELECT vec_id, 0 AS k, e[1:32] AS w FROM emb UNION ALL SELECT vec_id, 1, e[33:64] FROM emb)"
_L = "list_sum(list_transform(w, lambda x: {}))"


@query(f"WITH {_WORDS} SELECT vec_id, k, round({_L.format('abs(x)')}, 6) AS l1 FROM words")
def word_l1(spark, sf_dir):
    return _words(spark, sf_dir).select("vec_id", "k", _r(vec.l1(F.col("w")), "l1"))


@query(f"WITH {_WORDS} SELECT vec_id, k, round({_L.format('x * x')}, 6) AS l2sq FROM words")
def word_l2sq(spark, sf_dir):
    return _words(spark, sf_dir).select("vec_id", "k", _r(vec.l2sq(F.col("w")), "l2sq"))


def _round_all(c):
    return F.transform(c, lambda x: F.round(x, R) + 0.0)


@query(f"WITH {_WORDS}, n AS (SELECT *, sqrt({_L.format('x * x')}) AS n FROM words) SELECT vec_id, k, list_transform(w, lambda x: round(x / n, 6) + 0) AS w FROM n")
def intra_norm(spark, sf_dir):
    return _words(spark, sf_dir).select("vec_id", "k", _round_all(vec.normalized(F.col("w"))).alias("w"))


@query(f"WITH {EMB}, s AS (SELECT vec_id, list_transform(e, lambda x: sign(x) * sqrt(abs(x))) AS w FROM emb), n AS (SELECT vec_id, w, sqrt({_L.format('x * x')}) AS n FROM s) SELECT vec_id, list_transform(w, lambda x: round(CASE WHEN n > 1e-5 THEN x / n ELSE x END, 6) + 0) AS w FROM n")
def ssr_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", _round_all(vec.normalized(vec.signed_power(F.col("e"), 0.5), 1e-5)).alias("w"))


@query(f"WITH {EMB} SELECT vec_id, list_transform(e, lambda x: round(sign(x) * pow(abs(x), 0.3), 6) + 0) AS w FROM emb")
def signed_power(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", _round_all(vec.signed_power(F.col("e"), 0.3)).alias("w"))


_AXES = [[((i * 7 + j * 3) % 5 - 2) for j in range(8)] for i in range(4)]
_MEAN = [0.01 * j for j in range(8)]
_PROJECT = ", ".join("round(" + " + ".join(f"{a} * (u[{j + 1}] / n - {m})" for j, (a, m) in enumerate(zip(ax, _MEAN))) + f", 6) + 0 AS p{i}" for i, ax in enumerate(_AXES))


@query(f"WITH {DESC}, s AS (SELECT vec_id, list_transform(d, lambda x: sign(x) * sqrt(abs(x))) AS u FROM descr), t AS (SELECT vec_id, u, sqrt(list_sum(list_transform(u, lambda x: x * x))) AS n FROM s) SELECT vec_id, {_PROJECT} FROM t")
def pca_project(spark, sf_dir):
    out = gmm.project(descriptors(spark, sf_dir), _MEAN, _AXES)
    return out.select("vec_id", *[(F.round(F.col("projected")[i], R) + 0.0).alias(f"p{i}") for i in range(4)])


@query(f"WITH {GMM} SELECT k, j, round(w, 6) AS w, round(mu, 6) + 0 AS mu, round(sigma, 6) AS sigma FROM gstat JOIN gw USING (k)")
def gmm_closed_form(spark, sf_dir):
    g = closed_gmm(spark, sf_dir).select("k", "w", F.posexplode(F.arrays_zip("mu", "sigma")).alias("j", "m"))
    return g.select("k", (F.col("j") + 1).cast("long").alias("j"), _r("w"), (F.round("m.mu", R) + 0.0).alias("mu"), _r("m.sigma", "sigma"))


def _post(spark, sf_dir):
    g = closed_gmm(spark, sf_dir)
    return gmm.posterior(descriptors(spark, sf_dir), g), g


@query(f"WITH {POSTERIOR} SELECT vec_id, k, round(p, 6) AS p FROM post")
def gmm_posterior(spark, sf_dir):
    return _post(spark, sf_dir)[0].select("vec_id", "k", _r("p"))


@query(f"WITH {POSTERIOR} SELECT clip, k, round(avg(p), 6) AS soft FROM post GROUP BY ALL")
def soft_assign_mean(spark, sf_dir):
    return gmm.soft_assignment(_post(spark, sf_dir)[0], "clip").select("clip", "k", _r("soft"))


_FV = f"""{POSTERIOR}, fv AS (SELECT p.clip, p.k, l.j, (sum(p * x) - sum(p) * any_value(mu)) / any_value(sigma) / sqrt(count(*) * any_value(w) / any_value(sigma)) AS v
FROM post p JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = p.k AND s.j = l.j JOIN gw ON gw.k = p.k GROUP BY p.clip, p.k, l.j)"""


@query(f"WITH {_FV} SELECT clip, k, j, round(v, 5) + 0 AS v FROM fv")
def fisher_mu(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return gmm.fisher_mu(post, g, "clip").select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {_FV} SELECT clip, k, j, round(v, 5) + 0 AS v FROM fv")
def fisher_mu_arrow(spark, sf_dir):
    out = gmm.fisher_arrow(descriptors(spark, sf_dir), closed_gmm(spark, sf_dir), "clip")
    return out.select("clip", F.col("k").cast("int").alias("k"), (F.col("j") + 1).cast("long").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


_Z = f"{POSTERIOR}, z AS (SELECT p.clip, p.k, l.j, p.p, (x - mu) * (x - mu) / sigma - 1 AS e, sigma, w FROM post p JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = p.k AND s.j = l.j JOIN gw ON gw.k = p.k)"


@query(f"WITH {_Z} SELECT clip, k, j, round(sum(p * e) / sqrt(2 * count(*) * any_value(w)), 5) + 0 AS v FROM z GROUP BY clip, k, j")
def fisher_sigma(spark, sf_dir):
    out = gmm.fisher_sigma(*_post(spark, sf_dir), "clip")
    return out.select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


@query(
    f"""WITH {_Z}, s AS (SELECT clip, k, j, sum(p * e / sqrt(sigma)) AS a, count(*) AS n, any_value(w) AS w, any_value(sigma) AS sigma FROM z GROUP BY clip, k, j)
SELECT clip, k, round(sum(a) / sqrt(2 * 8 * any_value(n) * any_value(w) / max(CASE WHEN j = 1 THEN sigma END)), 5) + 0 AS v FROM s GROUP BY clip, k"""
)
def fisher_one_sigma(spark, sf_dir):
    return gmm.fisher_one_sigma(*_post(spark, sf_dir), "clip").withColumn("v", F.round("v", 5) + 0.0)


@query(
    f"""WITH {POSTERIOR}, s AS (SELECT clip, k, sum(p) AS sp, count(*) AS n FROM post GROUP BY clip, k), t AS (SELECT * FROM s JOIN gw USING (k))
SELECT t.clip, t.k, round((t.sp / t.w - f.sp / f.w) / sqrt(t.n * (1 / t.w + 1 / f.w)), 5) + 0 AS v FROM t JOIN t f ON f.clip = t.clip AND f.k = (SELECT min(k) FROM gw) WHERE t.k <> f.k"""
)
def fisher_weight(spark, sf_dir):
    return gmm.fisher_weight(*_post(spark, sf_dir), "clip").withColumn("v", F.round("v", 5) + 0.0)


@query(
    f"""WITH {POSTERIOR}, z AS (SELECT p.clip, p.k, l.j, CASE WHEN p >= 1e-6 THEN p ELSE 0 END AS p, (x - mu) / sqrt(sigma) AS z, w FROM post p JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = p.k AND s.j = l.j JOIN gw ON gw.k = p.k)
SELECT clip, k, j, round(sum(p * z) / (count(*) * sqrt(any_value(w))), 5) + 0 AS u, round(sum(p * (z * z - 1)) / (count(*) * sqrt(2 * any_value(w))), 5) + 0 AS v FROM z GROUP BY clip, k, j"""
)
def fisher_mean_variance(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return gmm.fisher_full(post, g, "clip").select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 5) + 0.0).alias("v"))


@query(
    f"""WITH {_FV}, n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY clip, k)) AS n FROM fv), i AS (SELECT clip, k, j, CASE WHEN n > 0 THEN v / n ELSE v END AS v, v AS raw FROM n),
g AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY clip)) AS u FROM i),
s AS (SELECT clip, k, avg(p) AS soft FROM post GROUP BY ALL)
SELECT clip, k, round(sum(abs(raw)), 5) AS l1, round(any_value(soft), 6) AS soft, round(sum(u), 5) + 0 AS total, sum(CASE WHEN u > 0 THEN 1::BIGINT << (8 - j) ELSE 0 END)::BIGINT AS bits FROM g JOIN s USING (clip, k) GROUP BY clip, k"""
)
def global_descriptor(spark, sf_dir):
    out = gmm.global_descriptor(descriptors(spark, sf_dir), closed_gmm(spark, sf_dir), "clip")
    return out.select("clip", "k", F.round("l1", 5).alias("l1"), _r("soft"), (F.round(vec.total(F.col("fv")), 5) + 0.0).alias("total"), "bits")


_GLOBAL = """, n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY clip, k)) AS n FROM fv), i AS (SELECT clip, k, j, CASE WHEN n > 0 THEN v / n ELSE v END AS v, v AS raw FROM n),
g AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY clip)) AS u FROM i),
s AS (SELECT clip, k, avg(p) AS soft FROM post GROUP BY ALL)
SELECT clip AS {by}, k, round(sum(abs(raw)), 5) AS l1, round(any_value(soft), 6) AS soft, round(sum(u), 5) + 0 AS total FROM g JOIN s USING (clip, k) WHERE {where} GROUP BY clip, k"""


def _described(by, group, where):
    """Global descriptors of what ``group`` names, from all its descriptors pooled."""

    def run(spark, sf_dir):
        desc = descriptors(spark, sf_dir).withColumn(by, F.expr(group)).filter(where.replace("clip", by))
        out = gmm.global_descriptor(desc, closed_gmm(spark, sf_dir), by)
        return out.select(by, "k", F.round("l1", 5).alias("l1"), _r("soft"), (F.round(vec.total(F.col("fv")), 5) + 0.0).alias("total"))

    return run


def _described_sql(by, group, where):
    return f"WITH {_FV}{_GLOBAL.format(by=by, where=where)}".replace("vec_id // 10 AS clip", group)


@query(_described_sql("shot", "vec_id // 30 AS clip", "true"))
def shot_descriptor(spark, sf_dir):
    """Descriptors pooled over the frames of a shot."""
    return _described("shot", "clip div 3", "true")(spark, sf_dir)


@query(_described_sql("frame", "vec_id AS clip", "clip % 5 = 0"))
def keyframe_descriptor(spark, sf_dir):
    """Every fifth frame on its own."""
    return _described("frame", "vec_id div 8", "clip % 5 = 0")(spark, sf_dir)


_UV = f"""{POSTERIOR}, best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS b FROM post),
z AS (SELECT p.clip, p.k, l.j, {{p}} AS p, (x - mu) / sqrt(sigma) AS z, w FROM best p JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = p.k AND s.j = l.j JOIN gw ON gw.k = p.k),
uv AS (SELECT clip, k, j, sum(p * z) / (count(*) * sqrt(any_value(w))) AS u, sum(p * (z * z - 1)) / (count(*) * sqrt(2 * any_value(w))) AS v FROM z GROUP BY clip, k, j)"""


def _uv(out):
    return out.select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {_UV.format(p='CASE WHEN b = 1 THEN 1 ELSE 0 END')} SELECT clip, k, j, round(u, 5) + 0 AS u, round(v, 5) + 0 AS v FROM uv")
def fisher_fast(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return _uv(gmm.fisher_full(gmm.hard(post), g, "clip"))


@query(f"WITH {_UV.format(p='CASE WHEN p >= 1e-6 THEN p ELSE 0 END')}, r AS (SELECT clip, k, j, sign(u) * sqrt(abs(u)) AS u, sign(v) * sqrt(abs(v)) AS v FROM uv), n AS (SELECT *, sqrt(sum(u * u + v * v) OVER (PARTITION BY clip)) AS n FROM r) SELECT clip, k, j, round(u / n, 5) + 0 AS u, round(v / n, 5) + 0 AS v FROM n")
def fisher_improved(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return _uv(gmm.improved(gmm.fisher_full(post, g, "clip"), "clip"))


_NEAR = f"""{GMM}, dist AS (SELECT vec_id, clip, k, round(sum((x - mu) * (x - mu)), 12) AS dist FROM dlong JOIN gstat USING (j) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS n FROM dist) WHERE n = 1),
vl AS (SELECT a.clip, a.k, l.j, sum(x - mu) AS v, count(*) AS n FROM near a JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = a.k AND s.j = l.j GROUP BY a.clip, a.k, l.j)"""


def _near(spark, sf_dir):
    g = closed_gmm(spark, sf_dir)
    return gmm.nearest(descriptors(spark, sf_dir), g), g


@query(f"WITH {_NEAR} SELECT clip, k, count(*) AS n FROM near GROUP BY ALL")
def bof_counts(spark, sf_dir):
    return gmm.bag(_near(spark, sf_dir)[0], "clip")


def _vlad(name, sql, **kw):
    def run(spark, sf_dir):
        a, g = _near(spark, sf_dir)
        return gmm.vlad(a, g, "clip", **kw).select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("v", R) + 0.0).alias("v"))

    run.__name__ = name
    query(f"WITH {_NEAR} {sql}")(run)


_vlad("vlad", "SELECT clip, k, j, round(v, 6) + 0 AS v FROM vl")
_vlad("vlad_mass", "SELECT clip, k, j, round(v / n, 6) + 0 AS v FROM vl", mass=True)
_vlad("vlad_sqrt_global", ", r AS (SELECT clip, k, j, sign(v) * sqrt(abs(v)) AS v FROM vl) SELECT clip, k, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY clip)), 6) + 0 AS v FROM r", square_root=True, whole=True)
_vlad("vlad_weighted", ", wv AS (SELECT a.clip, a.k, l.j, sum((1 + a.vec_id % 3) * (x - mu)) AS v FROM near a JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = a.k AND s.j = l.j GROUP BY a.clip, a.k, l.j) SELECT clip, k, j, round(v, 6) + 0 AS v FROM wv", weight="cast(1 + vec_id % 3 AS double)")


@query(f"WITH {POSTERIOR} SELECT p.clip, p.k, l.j, round(sum(p * (x - mu)), 6) + 0 AS v FROM post p JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = p.k AND s.j = l.j GROUP BY p.clip, p.k, l.j")
def vlad_soft(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return gmm.vlad(post, g, "clip", weight=F.col("p")).select("clip", "k", (F.col("j") + 1).cast("long").alias("j"), (F.round("v", R) + 0.0).alias("v"))


_vlad("vlad_component", "SELECT clip, k, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY clip, k)), 6) + 0 AS v FROM vl", component=True)


@query(
    f"""WITH {POSTERIOR}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS n FROM post)
SELECT vec_id, b.k AS word, round(any_value(p) / sqrt(any_value(w)), 6) AS weight, sum(CASE WHEN x - mu > 0 THEN 1::BIGINT << (8 - l.j) ELSE 0 END)::BIGINT AS bits, round(sum(abs((x - mu) / sigma)), 4) AS l1
FROM b JOIN dlong l USING (vec_id) JOIN gstat s ON s.k = b.k AND s.j = l.j JOIN gw ON gw.k = b.k WHERE b.n = 1 GROUP BY vec_id, b.k"""
)
def point_index(spark, sf_dir):
    post, g = _post(spark, sf_dir)
    return gmm.point_index(post, g).select("vec_id", "word", _r("weight"), "bits", F.round(vec.l1(F.col("residual")), 4).alias("l1"))


# Shots: a frame is a user's day, its histogram the share of each event type.
_FRAMES = """fr AS (SELECT user_id AS clip, date_diff('day', DATE '1970-01-01', ts::DATE) AS frame, event_type, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
types AS (SELECT DISTINCT event_type FROM events), keys AS (SELECT DISTINCT clip, frame FROM fr),
hist AS (SELECT k.clip, k.frame, t.event_type, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY k.clip, k.frame) AS h FROM keys k CROSS JOIN types t LEFT JOIN fr USING (clip, frame, event_type)),
prev AS (SELECT clip, frame, lag(frame) OVER (PARTITION BY clip ORDER BY frame) AS pf FROM keys),
sim AS (SELECT p.clip, p.frame, round(sum(CASE WHEN b.h IS NOT NULL THEN least(a.h, b.h) END), 9) AS similarity FROM prev p LEFT JOIN hist a ON a.clip = p.clip AND a.frame = p.frame LEFT JOIN hist b ON b.clip = p.clip AND b.frame = p.pf AND b.event_type = a.event_type GROUP BY p.clip, p.frame),
starts AS (SELECT clip, frame::BIGINT AS first, similarity FROM sim WHERE similarity IS NULL OR similarity < 0.4),
ends AS (SELECT clip, max(frame)::BIGINT + 1 AS total FROM keys GROUP BY clip),
shots AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY first) - 1 AS shot, first, coalesce(lead(first) OVER (PARTITION BY clip ORDER BY first), total) - first AS n FROM starts JOIN ends USING (clip))"""


def _frames(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("frame"), "event_type")
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(MOST_TYPES + 1).collect()]
    if len(types) > MOST_TYPES:
        raise ValueError(f"histograms of more than {MOST_TYPES} event types")
    counts = e.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == t).alias(f"c{i}") for i, t in enumerate(types)])
    return counts.select("clip", "frame", F.array(*[F.col(f"c{i}") / F.col("n") for i in range(len(types))]).alias("hist"))


def _shots(spark, sf_dir):
    fr = _frames(spark, sf_dir)
    starts = shots.boundaries(fr, 0.4).select("clip", F.col("frame").alias("first"))
    return shots.lengths(starts, fr.groupBy("clip").agg((F.max("frame") + 1).alias("total")))


@query(f"WITH {_FRAMES} SELECT clip, first AS frame, round(similarity, 6) AS similarity FROM starts")
def shot_boundaries(spark, sf_dir):
    return shots.boundaries(_frames(spark, sf_dir), 0.4).select("clip", "frame", _r("similarity"))


@query(f"WITH {_FRAMES} SELECT clip, shot::INTEGER AS shot, first, n FROM shots")
def shot_lengths(spark, sf_dir):
    return _shots(spark, sf_dir)


@query(
    f"""WITH {_FRAMES}, m AS (SELECT *, least(n, 4) AS o FROM shots), s AS (SELECT *, ceil(n / o)::BIGINT AS c, n // o AS f, n % o = 0 OR (o - 1) * ceil(n / o) < n AS even FROM m),
e AS (SELECT *, range(0, n, CASE WHEN even THEN c ELSE f END) AS every FROM s),
x AS (SELECT *, CASE WHEN o = 1 THEN [n // 2] WHEN even THEN every ELSE every[(len(every) - o) // 2 + 1 : (len(every) - o) // 2 + o] END AS p FROM e)
SELECT clip, shot::INTEGER AS shot, first + unnest(p) AS frame FROM x"""
)
def frame_sampling(spark, sf_dir):
    return shots.sample_frames(_shots(spark, sf_dir), 4).select("clip", "shot", "frame")


@query(f"WITH {_FRAMES} SELECT k.clip, k.frame::BIGINT AS frame, max(s.first) AS first FROM keys k JOIN starts s ON s.clip = k.clip AND s.first <= k.frame GROUP BY ALL")
def frame_asof_shot(spark, sf_dir):
    fr = _frames(spark, sf_dir)
    return shots.shot_of_frame(fr.select("clip", "frame"), shots.boundaries(fr, 0.4).select("clip", F.col("frame").alias("first")))


@query("WITH t AS (SELECT user_id AS clip, count(*) AS total FROM events GROUP BY ALL) SELECT clip, total, (sum(total) OVER (ORDER BY clip) - total)::BIGINT AS start FROM t")
def clip_offsets(spark, sf_dir):
    return shots.clip_offsets(read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count(F.lit(1)).alias("total")))


@query(f"WITH {_FRAMES} SELECT s.clip, s.shot::INTEGER AS shot, count(*) AS frames, round(avg(h.h), 6) AS share FROM shots s JOIN hist h ON h.clip = s.clip AND h.frame >= s.first AND h.frame < s.first + s.n AND h.event_type = (SELECT min(event_type) FROM events) GROUP BY ALL")
def shot_aggregate(spark, sf_dir):
    fr, sh = _frames(spark, sf_dir), _shots(spark, sf_dir)
    own = shots.shot_of_frame(fr.select("clip", "frame"), sh.select("clip", "first"))
    return own.join(fr, ["clip", "frame"]).join(sh, ["clip", "first"]).groupBy("clip", "shot").agg(F.count(F.lit(1)).alias("frames"), _r(F.avg(F.col("hist")[0]), "share"))


@query(f"WITH {_FRAMES}, r AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame DESC) AS rank FROM keys), f AS (SELECT r.clip, r.rank, max(s.first) AS first FROM r JOIN starts s ON s.clip = r.clip AND s.first <= r.frame WHERE r.rank <= 2 GROUP BY r.clip, r.rank) SELECT clip, rank::INTEGER AS rank, 'clips/' || clip || '/' || lpad(first::VARCHAR, 6, '0') || '.jpg' AS path FROM f")
def lookup_shot_path(spark, sf_dir):
    from pyspark.sql import Window

    fr = _frames(spark, sf_dir)
    hit = fr.withColumn("rank", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("frame")))).filter("rank <= 2").select("clip", "frame", "rank")
    first = shots.shot_of_frame(fr.select("clip", "frame"), shots.boundaries(fr, 0.4).select("clip", F.col("frame").alias("first")))
    return hit.join(first, ["clip", "frame"]).select("clip", "rank", F.concat(F.lit("clips/"), "clip", F.lit("/"), F.lpad(F.col("first").cast("string"), 6, "0"), F.lit(".jpg")).alias("path"))
