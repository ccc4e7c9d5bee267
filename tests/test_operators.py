import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ocellus.functions import paths, vec
from ocellus.operators import bloom, cluster, evaluate, forest, gmm, index, learn, neighbours, scoring, shots, stats
from ocellus.operators.scoring import QueryParams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scored(spark, labels, scores):
    return frame(spark, [(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores))], "id int, label int, score double")


def test_pr_perfect_and_swapped(spark):
    for scores, precision, ap in (([5, 4, 3, 2, 1], [1, 1, 2 / 3, 2 / 4, 2 / 5], 1.0), ([5, 3, 4, 2, 1], [1, 1 / 2, 2 / 3, 2 / 4, 2 / 5], (1 + 2 / 3) / 2)):
        s = scored(spark, [1, 1, -1, -1, -1], scores)
        got = [r.precision for r in evaluate.pr_curve(s).orderBy("pos").collect()]
        assert got == pytest.approx(precision)
        assert evaluate.pr_summary(s).head().ap == pytest.approx(ap)


def test_pr_minus_infinity_is_not_retrieved(spark):
    s = scored(spark, [1, 1, -1, -1, -1, -1], [1, -math.inf, -1, -1, -1, -1])
    assert evaluate.pr_summary(s).head().ap == pytest.approx(0.5)


def test_binned_sum_and_cumulative_max(spark):
    rows = frame(spark, [(i, -1) for i in [1, 2, 2, 2, 2, 2, 2, 2]], "i int, v int")
    acc = frame(spark, [(1, 1), (2, 7)], "i int, total int")
    assert {r.i: r.total for r in stats.binned_sum(rows, "i", "v", acc).collect()} == {1: 0, 2: 0}
    seq = frame(spark, list(enumerate([1, 2, 3, 4, 3, 2, 1])), "o int, v int")
    assert [r.cmax for r in stats.cumulative(seq, "v", "o").orderBy("o").collect()] == [1, 2, 3, 4, 4, 4, 4]


@pytest.mark.parametrize("edges, xs, bins", [([-math.inf, 0.0], [-math.inf, -1, 0, 1, math.inf], [1, 1, 2, 2, 2]), ([1.0], [0.9, 1, math.inf], [0, 1, 1])])
def test_bin_search(spark, edges, xs, bins):
    df = frame(spark, [(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    assert [r.b for r in df.withColumn("b", stats.bin_search(F.col("x"), edges)).orderBy("i").collect()] == bins


def test_weighted_histogram_singleton_edge(spark):
    df = frame(spark, [(1.0, float(w)) for w in range(1, 11)] + [(float("nan"), 5.0), (2.0, 9.0)], "x double, w double")
    assert stats.weighted_histogram(df, "x", "w", [1.0]).collect() == [(1, 55.0)]


def test_natural_order(spark):
    df = frame(spark, [(s,) for s in ["B1", "B2", "B12", "A12", "A1", "A2", "A007"]], "s string")
    assert [r.s for r in df.orderBy(paths.natural_key(F.col("s")), "s").collect()] == ["A1", "A2", "A007", "A12", "B1", "B2", "B12"]


def test_integral_of_ones(spark):
    df = frame(spark, [(i, j, 1) for i in range(3) for j in range(3)], "i int, j int, v int")
    assert [r.area for r in stats.integral(df, "i", "j", "v").orderBy("i", "j").collect()] == [1, 2, 3, 2, 4, 6, 3, 6, 9]


def test_seconds_and_paths(spark):
    df = frame(spark, [("1:40",), ("0:56",), ("1:0:1",), ("1:2:3:4",)], "t string")
    assert [r.s for r in df.select(vec.seconds(F.col("t")).alias("s")).collect()] == [100, 56, 3601, -1]
    p = frame(spark, [("a/b.c/d.jpg",), ("a.b/c",), ("x",)], "p string")
    assert [tuple(r) for r in p.select(paths.with_extension(F.col("p"), ".s"), paths.dirname(F.col("p")), paths.basename(F.col("p"))).collect()] == [("a/b.c/d.s", "a/b.c", "d.jpg"), ("a.b/c.s", "a.b", "c"), ("x.s", "", "x")]


@pytest.mark.parametrize("n, n_out, want", [(10, 1, [5]), (10, 5, [0, 2, 4, 6, 8]), (10, 4, [0, 3, 6, 9]), (10, 3, [0, 4, 8]), (7, 5, [1, 2, 3, 4, 5]), (3, -1, [0, 1, 2])])
def test_frame_sampling(spark, n, n_out, want):
    df = frame(spark, [(0, 0, 100, n)], "clip int, shot int, first long, n long")
    assert [r.frame - 100 for r in shots.sample_frames(df, n_out).orderBy("frame").collect()] == want


def test_pack_signs_and_bit_sample(spark):
    df = frame(spark, [([1.0, -1.0, 0.0, 2.0],)], "v array<double>")
    r = df.select(vec.pack_signs(F.col("v")).alias("b"), vec.bit_sample(vec.pack_signs(F.col("v")), [3, 0]).alias("s"), vec.bit_sample(vec.pack_signs(F.col("v")), [1, 2]).alias("z")).head()
    assert tuple(r) == (0b1001, 0b11, 0)


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(0)
    q, d = rng.standard_normal(8), rng.standard_normal((30, 8))
    s = lambda v: np.abs(v.reshape(2, 4)).sum(1)
    queries = frame(spark, [(0, q.tolist(), s(q).tolist())], "query_id int, q_fv array<double>, q_strengths array<double>")
    items = frame(spark, [(i, v.tolist(), s(v).tolist()) for i, v in enumerate(d)], "item_id int, d_fv array<double>, d_strengths array<double>")
    t = 3.0
    for mode in ("off", "qags", "dags", "sgs"):
        p = QueryParams(mode=mode, threshold=t, power=0.4, word_dim=4, words=2, top_k=30)
        got = {r.item_id: r.score for r in scoring.search(queries, items, p).collect()}
        for i, v in enumerate(d):
            qs, ds = s(q) > t, s(v) > t
            all_ = np.ones(2, bool)
            used, qu, du = {"off": (all_, all_, all_), "qags": (qs, qs, qs), "dags": (ds, ds, ds), "sgs": (qs & ds, qs, ds)}[mode]
            dot, qe, de = (q * v).reshape(2, 4).sum(1), (q * q).reshape(2, 4).sum(1), (v * v).reshape(2, 4).sum(1)
            ip, qn, dn, ex = dot[used].sum(), qe[qu].sum(), de[du].sum(), de[ds].sum()
            if mode == "qags":
                want = -(ip / math.sqrt(qn * dn) * ex**0.1) if qn and dn and ex else scoring.FLT_MAX
            else:
                want = -(ip / (qn * dn) ** 0.4) if qn and dn else scoring.FLT_MAX
            assert got[i] == pytest.approx(want, rel=1e-9), (mode, i)


def test_hamming_weights():
    w = scoring.hamming_weights(tuple(float(k) for k in range(33)))
    assert w[0] == 32 / 2 * 32 and w[15] == 17 / 2 * 2 and w[16] == w[32] == 0


def test_rerank_with_all_scenes_is_second_stage(spark):
    first = frame(spark, [(0, g, g + 1) for g in range(3)], "query_id int, item_id int, rank int")
    groups = frame(spark, [(i // 2, i) for i in range(6)], "group_id int, member_id int")
    second = frame(spark, [(0, i, float(-i)) for i in range(6)], "query_id int, item_id int, score double")
    assert [r.item_id for r in scoring.rerank(first, groups, second, 3, 6).orderBy("rank").collect()] == [5, 4, 3, 2, 1, 0]
    assert [r.item_id for r in scoring.rerank(first, groups, second, 1, 6).orderBy("rank").collect()] == [1, 0]


def test_bloom_repeats(spark):
    points = frame(spark, [(0, 1, 1), (0, 1, 1), (0, 2, 2), (1, 3, 2)], "hasher int, bucket int, clip int")
    assert bloom.postings(points).count() == 3
    idx = bloom.BloomIndex.fit(points, 0.5, exact=True)
    one = {r.clip: r.score for r in idx.query(frame(spark, [(9, 0, 1)], "query_id int, hasher int, bucket int")).collect()}
    two = {r.clip: r.score for r in idx.query(frame(spark, [(9, 0, 1)] * 2, "query_id int, hasher int, bucket int")).collect()}
    assert one[2] == 0 and two[1] == pytest.approx(2 * one[1]) and one[1] == pytest.approx(-math.log(2))


def test_average_precision(spark):
    res = frame(spark, [(1, 1, "a"), (1, 2, "x"), (1, 3, "a"), (1, 4, "b"), (2, 1, "z")], "query_id int, rank int, clip string")
    truth = frame(spark, [(1, "a"), (1, "b"), (2, "q"), (3, "r")], "query_id int, clip string")
    got = {r.query_id: (r.ap, r.p1) for r in evaluate.average_precision(res, truth).collect()}
    assert got == {1: (pytest.approx((1 + 2 / 3) / 2), 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_temporal_jaccard(spark):
    s = "query_id int, clip string, start int, stop int"
    found, truth = frame(spark, [(1, "a", 0, 9), (1, "c", 0, 5)], s), frame(spark, [(1, "a", 5, 14), (1, "b", 0, 1)], s)
    assert evaluate.temporal_jaccard(found, truth).head().jaccard == pytest.approx((5 / 15) / 2)


def test_gmm_fisher_vlad_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, mu, sigma, w = rng.standard_normal((40, 3)), rng.standard_normal((2, 3)), rng.random((2, 3)) + 0.5, np.array([0.3, 0.7])
    d = frame(spark, [(i, i // 20, v.tolist()) for i, v in enumerate(x)], "vec_id long, clip long, d array<double>")
    g = frame(spark, [(k, float(w[k]), mu[k].tolist(), sigma[k].tolist()) for k in range(2)], "k int, w double, mu array<double>, sigma array<double>")
    log = np.log(w) - 0.5 * (3 * np.log(2 * np.pi) + np.log(sigma).sum(1) + ((x[:, None] - mu) ** 2 / sigma).sum(2))
    p = np.exp(log) / np.exp(log).sum(1, keepdims=True)
    post = gmm.posterior(d, g)
    assert {(r.vec_id, r.k): r.p for r in post.collect()} == {(i, k): pytest.approx(p[i, k]) for i in range(40) for k in range(2)}
    for f in (gmm.fisher_mu(post, g, "clip"), gmm.fisher_arrow(d, g, "clip")):
        for r in f.collect():
            own = slice(20 * r.clip, 20 * r.clip + 20)
            want = (p[own, r.k] * (x[own, r.j] - mu[r.k, r.j])).sum() / sigma[r.k, r.j] / math.sqrt(20 * w[r.k] / sigma[r.k, r.j])
            assert r.v == pytest.approx(want)
    near = ((x[:, None] - mu) ** 2).sum(2).argmin(1)
    for r in gmm.vlad(gmm.nearest(d, g), g, "clip").collect():
        own = (near == r.k) & (np.arange(40) // 20 == r.clip)
        assert r.v == pytest.approx((x[own, r.j] - mu[r.k, r.j]).sum())


def blobs(spark, k=3, n=60):
    rng = np.random.default_rng(2)
    c = np.array([[0, 0], [10, 0], [0, 10]])[:k]
    x = np.concatenate([c[i] + 0.1 * rng.standard_normal((n // k, 2)) for i in range(k)])
    return x, frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, d array<double>")


def test_kmeans_gmm_hkm_find_blobs(spark):
    x, d = blobs(spark)
    centers, error = cluster.kmeans(d, 3, redo=2)
    assert error == pytest.approx(min(((x[:, None] - centers) ** 2).sum(2).min(1).mean(), error)) and error < 0.1
    w, mu, sigma, _ = cluster.gmm_fit(d, 3)
    assert sorted(w.round(2)) == pytest.approx([1 / 3] * 3, abs=0.01) and sigma.max() < 0.1
    tree = cluster.hkm_fit(d, 2, 3)
    got = {r.vec_id: r.node for r in cluster.hkm_assign(d, tree, 3).collect()}
    assert got == {i: int(n) for i, n in enumerate(cluster.hkm_paths(tree, x, 3))} and len({n // 3 for n in got.values()}) == 3


def test_pca_against_numpy(spark):
    x, d = blobs(spark)
    mean, values, vectors = cluster.pca(d)
    assert mean == pytest.approx(x.mean(0)) and values == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    assert np.abs(vectors @ np.cov(x.T, bias=True) @ vectors.T - np.diag(values)).max() < 1e-9


def test_cell_neighbours_are_exact_within_cells(spark):
    x, d = blobs(spark)
    q, b = d.select(F.col("vec_id").alias("query_id"), F.col("d").alias("q")), d.select(F.col("vec_id").alias("base_id"), F.col("d").alias("b"))
    got = {(r.query_id, r.base_id) for r in cluster.cell_neighbours(q, b, 3, 2, 3).collect()}
    want = {(r.query_id, r.base_id) for r in neighbours.knn(q, b, 3).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_forest_bounds_hold_and_own_leaf_is_nearest(spark):
    x = np.random.default_rng(4).normal(size=(300, 6))
    tree = forest.build_forest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, d array<double>"), 1, 4)[0]
    own, bound = forest.leaves(tree, x), forest.leaf_bounds(tree, x)
    dist = ((x[:, None] - x) ** 2).sum(2)
    assert (bound[:, own] <= dist + 1e-12).all() and (bound[np.arange(300), own] == 0).all() and len(set(own)) == 16


@pytest.mark.parametrize("centers", [0, 30])
def test_forest_recall(spark, centers):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 8)) + (rng.normal(0, 4, (centers, 8))[rng.integers(0, centers, 4000)] if centers else 0)
    d = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id long, d array<double>")
    q, b = d.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("d").alias("q")), d.select(F.col("vec_id").alias("base_id"), F.col("d").alias("b"))
    built = forest.build_forest(d.filter("d IS NOT NULL"), 4, 6, median=centers == 0)
    near = {s: sorted(map(tuple, forest.forest_neighbours(q, b, 5, built, 48, salts=s).collect())) for s in (1, 3)}
    dist = ((x[::100, None] - x) ** 2).sum(2)
    want = {(100 * k, int(j)) for k, r in enumerate(dist.argsort(1)[:, :5]) for j in r}
    assert near[1] == near[3] and len({(r[0], r[1]) for r in near[1]} & want) >= 0.9 * len(want)


def test_forest_of_few_or_equal_rows(spark):
    for rows, n in (([], 0), ([(1, [1.0, 2.0])] * 1, 1), ([(i, [1.0, 2.0]) for i in range(7)], 3)):
        d = frame(spark, rows, "vec_id long, d array<double>")
        got = forest.forest_neighbours(d.selectExpr("vec_id query_id", "d q"), d.selectExpr("vec_id base_id", "d b"), 3, forest.build_forest(d, 2, 3), 4)
        assert [(r.base_id, r.dist) for r in got.filter("query_id = 1").orderBy("rank").collect()] == [(r[0], 0.0) for r in rows[:n]]


def test_spectral_parts_blobs():
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.1, (20, 2)) for c in (0, 5)])
    own = cluster.spectral(np.exp(-((x[:, None] - x) ** 2).sum(2)), 2)
    assert len(set(own[:20])) == len(set(own[20:])) == 1 and own[0] != own[20]


def test_aib_costs_fall_and_merge_equal_rows_first():
    joint = np.array([[4, 0], [0, 4], [4, 0], [1, 3]], float)
    parents, costs = learn.aib(joint)
    assert parents[0] == parents[2] == 4 and costs[1] == pytest.approx(costs[0]) and (np.diff(costs) <= 1e-12).all() and costs[-1] == pytest.approx(0)
    cut = learn.aib_cut(parents, 2)
    assert cut[0] == cut[2] != cut[1]


def test_kernel_map_approximates_chi2(spark):
    xs = [0.05, 0.2, 0.5, 1.0]
    df = frame(spark, [(i, x) for i, x in enumerate(xs)], "i int, x double")
    for kernel, exact in (("chi2", lambda a, b: 2 * a * b / (a + b)), ("js", lambda a, b: (a * math.log2((a + b) / a) + b * math.log2((a + b) / b)) / 2), ("intersection", min)):
        m = [np.array(r.m) for r in df.select("i", learn.kernel_map(F.col("x"), kernel, 200 if kernel == "intersection" else 6, 0.15 if kernel == "intersection" else 0.4).alias("m")).orderBy("i").collect()]
        for i, a in enumerate(xs):
            for j, b in enumerate(xs):
                assert m[i] @ m[j] == pytest.approx(exact(a, b), abs=0.03)


def test_linear_fit_separates(spark):
    x, d = blobs(spark, 2)
    rows = d.coalesce(1).withColumn("label", F.when(F.col("vec_id") < 30, -1).otherwise(1))
    for loss in learn.LOSSES:
        w, b, objective = learn.linear_fit(rows, loss, 1e-3)
        assert (((x @ w + b) > 0) == (np.arange(60) >= 30)).all() and objective < 0.2


def _objective(loss, x, y, r, lam, w, b):
    z = x @ w + b
    value = {"hinge": np.maximum(0, 1 - y * z), "hinge2": np.maximum(0, 1 - y * z) ** 2, "logistic": np.log1p(np.exp(-y * z)), "l1": np.abs(z - y), "l2": (z - y) ** 2 / 2}[loss]
    return (r * value).sum() / r.sum() + lam / 2 * w @ w


@pytest.mark.parametrize("loss", list(learn.LOSSES))
def test_linear_fit_is_least_and_weights_are_copies(spark, loss):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3))
    y, r = np.where(x @ [1, -2, 0.5] + rng.normal(0, 1.5, 120) > 0.3, 1, -1), rng.integers(1, 4, 120)
    schema = "d array<double>, label int, n int"
    rows = frame(spark, [(v.tolist(), int(a), int(c)) for v, a, c in zip(x, y, r)], schema).coalesce(1)
    copies = frame(spark, [(v.tolist(), int(a), 1) for v, a, c in zip(x, y, r) for _ in range(c)], schema).coalesce(1)
    w, b, objective = learn.linear_fit(rows, loss, 0.05, weight="n")
    assert objective == pytest.approx(_objective(loss, x, y, r, 0.05, w, b), rel=1e-9)
    assert objective == pytest.approx(learn.linear_fit(copies, loss, 0.05)[2], rel=1e-3)
    for scale in (0.3, 0.03):
        for step in rng.normal(0, scale, (200, 4)):
            assert _objective(loss, x, y, r, 0.05, w + step[:3], b + step[3]) >= objective - 2e-4


def test_reweighted_fit_objective_falls(spark):
    x, d = blobs(spark, 2)
    rows = d.select(F.col("d").alias("v"), F.when(F.col("vec_id") < 30, -1.0).otherwise(1.0).alias("y"), F.lit(1.0).alias("r"))
    for loss in ("hinge2", "l1"):
        history = learn.reweighted_fit(rows, loss, 1e-2, rounds=6)[2]
        assert len(history) > 1 and (np.diff(history) <= 0).all()


def test_index_concat_save_load(spark, tmp_path):
    a, b = frame(spark, [(5, 1.0, 2.0), (3, 1.0, 2.0)], "item_id long, l1 double, soft double"), frame(spark, [(4, 1.0, 2.0)], "item_id long, l1 double, soft double")
    assert [(r.item_id, r.ordinal) for r in index.concatenated([a, b]).orderBy("ordinal").collect()] == [(3, 0), (5, 1), (4, 2)]
    index.save(a, str(tmp_path / "i"))
    index.save(b, str(tmp_path / "i"))
    assert index.load(spark, str(tmp_path / "i")).columns == ["item_id", "l1"] and index.load(spark, str(tmp_path / "i"), both=True).count() == 3
    assert index.unfinished(a, b, "item_id").count() == 2


def test_min_max_ranks(spark):
    df = frame(spark, [(5,), (3,), (5,), (1,)], "v int")
    assert sorted((r.v, r.min_rank, r.max_rank) for r in stats.min_max_ranks(df, "v").collect()) == [(1, 3, 4), (3, 2, 3), (5, 0, 2), (5, 0, 2)]


def test_arrays(spark):
    from ocellus.functions import arrays

    df = frame(spark, [([3.0, -1.0, float("nan"), 2.0], [2, 0, 1], 5)], "v array<double>, p array<int>, k int")
    r = df.select(arrays.purged(F.col("v")).alias("a"), arrays.replaced(F.col("v"), 0.0).alias("b"), arrays.inverse_permutation(F.col("p")).alias("c"), arrays.sort_order(arrays.purged(F.col("v")), True).alias("d"), arrays.first_index(F.col("p"), F.col("k")).alias("e"), arrays.mapped(F.col("v"), F.col("p")).alias("f")).head()
    assert (r.a, r.b, r.c, r.d, r.e, r.f[1:]) == ([3.0, -1.0, 2.0], [3.0, -1.0, 0.0, 2.0], [1, 2, 0], [0, 2, 1], -1, [3.0, -1.0])


def test_sampling_is_stable_and_sized(spark):
    from ocellus.operators import sampling

    rows = spark.range(1000)
    a = {r.id for r in sampling.subset(rows.repartition(7), "id", 50, 1).collect()}
    assert len(a) == 50 and a == {r.id for r in sampling.subset(rows.coalesce(1), "id", 50, 1).collect()} != {r.id for r in sampling.subset(rows, "id", 50, 2).collect()}
    assert 60 < sampling.share(rows, "id", 0.1, 1).count() < 140
    assert sampling.per_group(rows.withColumn("g", F.col("id") % 3), "g", "id", 4).count() == 12
    assert sorted(r.id for r in sampling.shuffled(rows, "id").collect()) == list(range(1000))


def test_tree_histogram(spark):
    from ocellus.operators import trees

    above = trees.ancestors(spark, trees.parents_frame(spark, np.array([4, 3, 3, 4, 0])))
    got = {r.node: r.n for r in trees.histogram(frame(spark, [(0,), (0,), (1,), (2,)], "node int"), above).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 2, 4: 4}


def test_images(spark):
    import colorsys

    from ocellus.operators import images

    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (50, 3))
    assert images.hsv(rgb) == pytest.approx(np.array([colorsys.rgb_to_hsv(*(p / 255)) for p in rgb]))
    frames = frame(spark, [(1, 0, bytearray(rgb.astype(np.uint8).tobytes()))], "clip long, frame long, rgb binary")
    assert images.frame_histograms(frames, 4).head().hist == pytest.approx(images.hsv_histogram(rgb, 4).tolist())
    flat = np.full((9, 9), 5.0)
    assert images.smooth(flat, 1.0) == pytest.approx(flat) and images.gradient(flat)[0].max() == 0 and (images.lbp(flat) == 0).all()
    cost = np.full((5, 5), 1e6)
    cost[2, 2] = 0
    assert images.distance_transform(cost)[0, 4] == 8
    ramp = np.tile(np.arange(16.0), (16, 1))
    assert images.hog(ramp).argmax(2).max() == 0


def test_cli(spark, tmp_path, capsys):
    from ocellus import cli

    (tmp_path / "gt").write_text("0 a.mp4 0:10 0:20\n")
    (tmp_path / "res").write_text("Query 0\nb_1.jpg\na_5.jpg\n")
    cli.main(["evaluate-results", "--results", str(tmp_path / "res"), "--ground-truth", str(tmp_path / "gt"), "--keyframes"])
    assert capsys.readouterr().out == "mAP 0.500000\nmP@1 0.000000\n"
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist(), np.abs(v.reshape(2, 4)).sum(1).tolist()) for i, v in enumerate(rng.standard_normal((9, 8)))]
    frame(spark, rows, "item_id int, d_fv array<double>, d_strengths array<double>").write.parquet(str(tmp_path / "d"))
    frame(spark, rows[:2], "query_id int, q_fv array<double>, q_strengths array<double>").write.parquet(str(tmp_path / "q"))
    cli.main(["retrieve", "--queries", str(tmp_path / "q"), "--database", str(tmp_path / "d"), "--output", str(tmp_path / "o"), "--mode", "off", "--word-dim", "4", "--words", "2", "--output-results", "1"])
    assert sorted((r.query_id, r.item_id) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(0, 0), (1, 1)]


def test_linear(spark):
    from ocellus.operators import linear

    rng = np.random.default_rng(0)
    for v in (np.array([0.3, -1.0, 0.4]), np.array([0, 0, math.pi]), np.zeros(3)):
        r = linear.rotation(v)
        assert r @ r.T == pytest.approx(np.eye(3)) and linear.rotation(linear.rotation_vector(r)) == pytest.approx(r, abs=1e-6)
    assert linear.hat(np.array([1, 2, 3])) @ [4, 5, 6] == pytest.approx(np.cross([1, 2, 3], [4, 5, 6]))
    h = linear.hadamard(8)
    assert h @ h.T == pytest.approx(8 * np.eye(8)) and linear.orthogonal(5) @ linear.orthogonal(5).T == pytest.approx(np.eye(5))
    a, b = rng.standard_normal((4, 4)), rng.standard_normal((4, 4))
    a, b = a + a.T, b @ b.T + np.eye(4)
    values, vectors = linear.eigen(a, b)
    assert a @ vectors == pytest.approx(b @ vectors * values) and linear.solve(np.zeros((2, 2)), np.ones(2)) is None
    x = rng.standard_normal((30, 3))
    d = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i int, d array<double>")
    s, v = linear.partial_svd(d, "d", 2)
    assert s == pytest.approx(np.linalg.svd(x)[1][:2])
    m = rng.standard_normal((3, 2))
    assert np.array([r["product"] for r in linear.multiplied(d, "d", m).orderBy("i").collect()]) == pytest.approx(x @ m)


def test_det_deviates(spark):
    from statistics import NormalDist

    s = scored(spark, [1, -1] * 20, range(40))
    for r in evaluate.det_curve(s).collect():
        if 1e-3 < r.fnr < 1 - 1e-3:
            assert r.miss_deviate == pytest.approx(NormalDist().inv_cdf(r.fnr), abs=0.01)


def test_features(spark):
    from ocellus.operators import features

    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (40, 48)).astype(np.uint8)
    rows = frame(spark, [("a", 48, 40, bytearray(img.tobytes())), ("b", 8, 8, bytearray(64))], "path string, width int, height int, pixels binary")
    got = features.per_image(rows, features.dense_descriptors).collect()
    assert len(got) == 7 * 9 and {r.path for r in got} == {"a"} and all(len(r.desc) == 128 and sum(x * x for x in r.desc) == pytest.approx(1) for r in got)
    two = np.zeros((20, 20))
    two[:, 10:] = 100
    labels = features.superpixels(two, 10, 1.0)
    assert not set(labels[:, :9].ravel()) & set(labels[:, 11:].ravel())
    x = np.concatenate([rng.normal(c, 0.1, (15, 2)) for c in (0, 5)])
    parents, _ = features.mode_seeking(x, 0.3, 2.0)
    roots = np.arange(30)
    for _ in range(30):
        roots = parents[roots]
    assert len(set(roots[:15])) == len(set(roots[15:])) == 1 and roots[0] != roots[20]
    box = np.zeros((21, 21))
    box[10:, 10:] = 1
    assert np.abs(np.array(np.unravel_index(features.corners(box).argmax(), box.shape)) - 10).max() <= 2


def test_kmeans_by_medians_and_chi2(spark):
    import numpy as np

    from ocellus.operators import cluster

    rng = np.random.default_rng(0)
    x = np.abs(np.concatenate([rng.normal(1, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[100.0, 100.0]]]))
    d = spark.createDataFrame([(v.tolist(),) for v in x], "d array<double>")
    first = np.array([[1.0, 1.0], [5.0, 5.0]])
    centers, error = cluster.kmeans(d, 2, metric="l1", initial=first, rounds=4)
    assert np.allclose(centers[1], np.median(x[30:], axis=0)) and error > 0  # the outlier moves a mean, not a median
    centers, _ = cluster.kmeans(d, 2, metric="chi2", initial=first, rounds=1)
    assert np.allclose(centers[0], x[:30].mean(0))


def test_descriptors_must_match_queries(spark):
    import pytest

    from ocellus.operators import scoring

    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert scoring.with_descriptors(q, spark.createDataFrame([(1, 0.5), (2, 0.1)], "query_id long, x double")).count() == 2
    for rows in ([(1, 0.5)], [(1, 0.5), (1, 0.5)], [(1, 0.5), (3, 0.5)]):
        with pytest.raises(ValueError):
            scoring.with_descriptors(q, spark.createDataFrame(rows, "query_id long, x double"))


def test_queries_are_broadcast_in_blocks_of_bytes(spark):
    from ocellus.operators import scoring

    q = spark.createDataFrame([(k, [float(k)] * 10) for k in range(20)], "query_id long, q array<double>")
    d = spark.createDataFrame([(k,) for k in range(5)], "item_id long")
    assert scoring.compared(q, d, most_bytes=400).select("query_id", "item_id").distinct().count() == 100


def test_moments_of_loads_give_the_whole_pca(spark):
    from ocellus.operators import cluster

    v = np.random.default_rng(4).standard_normal((300, 5)) * [1, 2, 3, 4, 5]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, d array<double>")
    m = cluster.merged(cluster.moments(d.filter("id < 100")), cluster.moments(d.filter("id >= 100")), cluster.moments(d.filter("id < 0")))
    for got, want in zip(cluster.pca_of(m), cluster.pca(d)):
        assert np.allclose(got, want, atol=1e-9)


def test_integer_trees(spark):
    from ocellus.operators import cluster

    v = np.random.default_rng(4).integers(0, 256, (200, 3))
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, d array<double>")
    tree = cluster.hkm_fit(d, 2, 3, integer=True)
    assert [len(t) for t in tree] == [3, 9] and all((t == np.floor(t)).all() for t in tree)
    centers = cluster.ikmeans(d, 4, rounds=100)
    own = ((v[:, None] - centers) ** 2).sum(2).argmin(1)
    assert centers.dtype == np.int64 and all((centers[c] == v[own == c].sum(0) // (own == c).sum()).all() for c in range(4))


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_forest_search_makes_no_row_for_a_pair(spark):
    """Pairs of queries and rows of leaves were joined, and ranked as rows."""
    d = frame(spark, [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(500, 4)))], "vec_id long, d array<double>")
    q, b = d.selectExpr("vec_id query_id", "d q"), d.selectExpr("vec_id base_id", "d b")
    for probes in (3, 16):
        assert _joins(forest.forest_neighbours(q, b, 3, forest.build_forest(d, 2, 3), probes)) == 0


def test_forest_visits_of_all_leaves_are_of_one_tree():
    tree = forest.Tree(np.zeros(3, np.int64), np.array([0.0, -1.0, 1.0]), 2)
    at, table, leaf, bound = forest.visits([tree, tree], np.array([[-0.5], [2.0]]), 8)
    assert (at.tolist(), table.tolist(), leaf.tolist()) == ([0] * 4 + [1] * 4, [0] * 8, [1, 0, 2, 3, 3, 2, 1, 0]) and bound.tolist() == [0, 0.25, 0.25, 2.25, 0, 1, 4, 9]
    assert len(forest.visits([tree, tree], np.array([[-0.5]]), 7)[0]) == 7


def test_neighbours_in_cells_with_copies_ties_and_repeated_ids(monkeypatch):
    """Against brute force, with few pairs and rows held at once."""
    for name, value in (("HELD", 50), ("PAIRS", 64), ("BASE_ROWS", 40)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    for case in range(6):
        x = rng.integers(0, 3, (300, 2)).astype(float) + (rng.integers(0, 2, (300, 1)) * 2e-10 if case % 2 else 0)
        x[rng.integers(0, 300, 60)] = x[0]
        ids = rng.permutation(300) % (300 if case < 4 else 40)
        if case == 3:
            x[7] = np.nan
        q, cells = rng.integers(0, 3, (9, 2)).astype(float), rng.integers(0, 4, (300, 2))
        asked = rng.integers(0, 2, (9, 2, 4)).astype(bool)
        place = iter([cells[k : k + 60] for k in range(0, 300, 60)])  # a block for each batch
        visits = np.nonzero(asked)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 60]), pa.array(x[k : k + 60].tolist())], ["base_id", "b"]) for k in range(0, 300, 60)]
        run = neighbours._searcher(pa.array(range(9)), q, 4, lambda v, place=place: next(place), lambda v, visits=visits: (*visits, np.zeros(len(visits[0]))))
        got = [r for b in run(batches) for r in b.to_pylist()]
        for n in range(9):
            best = {}
            for k in range(300):
                if any(asked[n, t, cells[k, t]] for t in range(2)):
                    best[int(ids[k])] = min(best.get(int(ids[k]), np.inf), float("inf") if np.isnan(x[k]).any() else round(float(((q[n] - x[k]) ** 2).sum()), 9))
            want = sorted((d, i) for i, d in best.items())[:4]
            assert sorted((round(r["dist"], 9), r["base_id"]) for r in got if r["query_id"] == n)[:4] == want


def test_cell_search_makes_no_row_for_a_pair(spark):
    """Pairs within cells were joined, and shuffled to drop those met in several tables."""
    x, d = blobs(spark)
    found = cluster.cell_neighbours(d.selectExpr("vec_id query_id", "d q"), d.selectExpr("vec_id base_id", "d b"), 3, 2, 3)
    assert _joins(found) == 0


def test_nearest_center_rounds_before_it_compares():
    c = np.array([[1.0], [-1.0 - 1e-13], [5.0]])
    assert cluster.nearest_center(np.array([[-1e-14], [-0.5], [4.0]]), c).tolist() == [0, 1, 2]


@pytest.mark.parametrize("scale", [1, 1e6])
def test_pairwise_in_numpy_equals_columns(spark, scale):
    """Every pair's metrics were interpreted element by element in the JVM, and pairs made by a join."""
    rng = np.random.default_rng(6)
    x = rng.random((40, 9)) * (rng.random((40, 9)) > 0.3) * scale
    x[5], x[6] = 0, x[7]
    d = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    q, b, names = d.filter("i % 4 < 3").selectExpr("i query_id", "v q"), d.selectExpr("i base_id", "v b"), list(vec.DISTANCES)
    got = neighbours.pairwise(q, b, names)
    assert _joins(got) == 0 and set(names) == set(neighbours.DENSE)
    want = {(r.query_id, r.base_id): r for r in q.join(b).select("query_id", "base_id", *[vec.distance(m, F.col("q"), F.col("b")).alias(m) for m in names]).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 1200
    for r in rows:
        w = want[r.query_id, r.base_id]
        for m in names:
            same = w[m] if w[m] is not None else 0.0
            assert r[m] == same if m not in ("js", "kjs") else r[m] == pytest.approx(same, rel=1e-12, abs=1e-12 * scale), m


def test_pairwise_of_odd_rows(spark):
    d = frame(spark, [(1, [1.0, -2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0])], "i long, v array<double>")
    rows = neighbours.pairwise(d.selectExpr("i query_id", "v q"), d.selectExpr("i base_id", "v b"), ["l1"], 6).collect()
    got = {(r.query_id, r.base_id): r.l1 for r in rows}
    assert len(got) == 25 and got[1, 1] == 0 and got[1, 2] is None and got[1, 3] is None and got[1, 4] is None and math.isnan(got[1, 5])
    empty = d.filter("i > 9")
    for q, b in ((empty, d), (d, empty), (empty, empty)):
        assert neighbours.pairwise(q.selectExpr("i query_id", "v q"), b.selectExpr("i base_id", "v b"), ["l1"]).count() == 0


def test_rounding_is_half_away_from_zero():
    assert neighbours.rounded(np.array([0.0078125, -0.0078125, 1e305, math.inf, -1e-9]), 6).tolist() == [0.007813, -0.007813, 1e305, math.inf, 0.0]


def test_visits_are_found_once_and_not_in_each_task():
    """Every task found the visits of all queries anew, which cost as much as its search where tasks are many."""
    calls, x = [], np.random.default_rng(1).normal(size=(40, 2))

    def visits_of(v):
        calls.append(len(v))
        return np.arange(len(v)), np.zeros(len(v), int), np.zeros(len(v), int), np.zeros(len(v))

    run = neighbours._searcher(pa.array(range(4)), x[:4], 2, lambda v: np.zeros((len(v), 1), int), visits_of)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(x.tolist())], ["base_id", "b"])
    for _ in range(3):
        got = {(r["query_id"], r["base_id"]) for b in run(iter([batch])) for r in b.to_pylist()}
        assert all({(k, int(j)) for j in ((x - x[k]) ** 2).sum(1).argsort()[:2]} <= got for k in range(4))
    assert calls == [4]


def test_cells_are_searched_in_few_large_tasks(spark, monkeypatch):
    """Each partition handed on k rows of every query, so rows grew as queries times partitions."""
    monkeypatch.setattr(neighbours, "TASK_ROWS", 60)
    d = spark.range(0, 600, 1, 40).selectExpr("id AS vec_id", "array(double(id % 37), double(id % 11)) AS d")
    q, b = d.filter("vec_id < 5").selectExpr("vec_id query_id", "d q"), d.selectExpr("vec_id base_id", "d b")
    found = forest.forest_neighbours(q, b, 3, forest.build_forest(d, 2, 3), 5)
    assert f"Repartition {max(10, spark.sparkContext.defaultParallelism)}, false" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("trees,levels,probes", [(4, 3, 3), (3, 2, 6), (2, 5, 64)])
def test_forest_search_by_boxes_equals_search_of_visited_leaves(monkeypatch, trees, levels, probes):
    """Small boxes; elements about 0, far from it for singles, beyond singles, and not all finite."""
    for name, value in (("HELD", 300), ("PAIRS", 100), ("BASE_ROWS", 400), ("BOX", 8)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(probes)
    for offset in (0.0, 5e3, 1e7, None):
        x = rng.normal(size=(1000, 3)) * rng.choice([0.01, 1, 20], (1000, 1)) + (offset or 0)
        x[rng.integers(0, 1000, 50)] = x[1]
        monkeypatch.setattr(forest, "_sample", lambda rows, *a: rows)
        built = forest.build_forest(x, trees, levels)
        if offset is None:
            x[5], x[6], x[7, 1] = np.nan, np.inf, -np.inf
        q = x[np.r_[0:40:3, 100:120]]
        cells_of, visits_of = (lambda v, f=built: np.stack([forest.leaves(t, v) for t in f], 1)), lambda v, f=built: forest.visits(f, v, probes)
        batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array(x[k : k + 100].tolist())], ["base_id", "b"]) for k in range(0, 1000, 100)]
        with np.errstate(invalid="ignore"):
            got = [r for b in neighbours._searcher(pa.array(range(len(q))), q, 5, cells_of, visits_of)(batches) for r in b.to_pylist()]
            dist, own, visits = neighbours.exact_distances(q[:, None], x), cells_of(x), set(zip(*(a.tolist() for a in visits_of(q)[:3])))
        for n in range(len(q)):
            seen = [j for j in range(1000) if any((n, t, int(own[j, t])) in visits for t in range(trees))]
            key = lambda d, j: (math.isnan(d), 0.0 if math.isnan(d) else round(d, 9), j)
            assert sorted(key(r["dist"], r["base_id"]) for r in got if r["query_id"] == n)[:5] == sorted(key(float(dist[n, j]), j) for j in seen)[:5]
