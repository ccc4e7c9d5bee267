"""Mixing sources to target weights: raking of token weights to marginals, then calibrated sampling.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.llm.common import broadcast_if_small, ensure_checkpoint_dir, read_table

AXES = ["source", "lang", "topic"]
TEMPERATURE, SWEEPS, TOLERANCE, MOST_ROUNDS = 0.7, 5, 1e-9, 80
BOUND, STEP, SCALES = 0.01, 0.95, 256
ONE_TASK_CELLS, SALTS = 50_000, 64
TOPIC_ROUNDS, DIGITS = 5, 6

#: What texts are grouped by: the share of characters that match, and of words.
FORMS = {"digits": "[0-9]", "capitals": "[A-Z]", "marks": "[!-/:-@\\[-`{-~]", "lines": "\n"}
WORD = r"[^ \t-\r]+"
#: A topic begins at texts like all others, or at two standard deviations above the mean of one feature.
TOPICS = ["plain", *FORMS, "short words"]


def words(text_col: str = "text") -> Column:
    """Number of words, as tokens."""
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("double")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with weight, in words, and _x0, _x1 ...: shares of the characters that match each of FORMS, and words a character.

    Null and empty texts: 0. Each step is a projection of its own, so nothing is computed twice.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double")
    counts = [lines if p == "\n" else F.regexp_count(t, F.lit(p)).cast("double") for p in FORMS.values()]
    found = docs.withColumns({"weight": words(text_col), "_n": F.greatest(F.length(t), F.lit(1)).cast("double")} | dict(zip(_X, counts)))
    return found.withColumns({x: F.col(c) / F.col("_n") for x, c in zip(_X, [*_X[:-1], "weight"])}).drop("_n")


_X = [f"_x{i}" for i in range(len(FORMS) + 1)]
Model = tuple[list[tuple[float, float]], list[list[float]]]


def _nearest(x: DataFrame, model: Model) -> DataFrame:
    """x with its features scaled, and _k, the number of the nearest center, ties to the first.

    Each step is a projection of its own, so no feature is computed twice.
    """
    scale, centers = model
    x = x.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in zip(_X, scale)})
    x = x.withColumns({f"_d{k}": reduce(lambda a, b: a + b, [(F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m)) for c, m in zip(_X, center)]) for k, center in enumerate(centers)})
    d = [F.col(f"_d{k}") for k in range(len(centers))]
    x = x.withColumn("_d", F.least(*d))
    return x.withColumn("_k", F.coalesce(*[F.when(v == F.col("_d"), k) for k, v in enumerate(d)])).drop("_d", *[f"_d{k}" for k in range(len(centers))])


def fit_topics(x: DataFrame, rounds: int = TOPIC_ROUNDS) -> Model:
    """(mean and deviation of each feature, centers of the topics): k-means of all texts' standardised features.

    ``x``: the features, checkpointed; every round is one aggregation over them, combined map-side, and six
    centers come to the driver. All numbers are rounded to DIGITS digits, so that sums in another order
    give the same model. A topic without texts keeps its center; an empty table keeps all of them.
    """
    row = x.agg(*[F.round(F.avg(c), DIGITS) for c in _X], *[F.round(F.stddev_pop(c), DIGITS) for c in _X]).head()
    scale = [(m or 0.0, s or 1.0) for m, s in zip(row[: len(_X)], row[len(_X) :])]
    centers = [[2.0 if k == j + 1 else 0.0 for j in range(len(_X))] for k in range(len(TOPICS))]
    for _ in range(rounds):
        for r in _nearest(x, (scale, centers)).groupBy("_k").agg(*[F.round(F.avg(c), DIGITS) for c in _X]).collect():
            centers[r["_k"]] = list(r[1:])
    return scale, centers


def with_topic(x: DataFrame, model: Model) -> DataFrame:
    """x with topic, the name of the topic that its features are nearest to; null texts (``gone``) have ``none``."""
    name = F.element_at(F.array(*map(F.lit, TOPICS)), F.col("_k") + 1)
    return _nearest(x, model).withColumn("topic", F.when(F.col("gone"), "none").otherwise(name)).drop("_k", *_X)


def _label(c: str) -> Column:
    """A value as text: null is ``?``, and a value that begins with ``?`` gets one more."""
    t = F.col(c).cast("string")
    return F.when(t.isNull(), "?").when(t.startswith("?"), F.concat(F.lit("?"), t)).otherwise(t)


def labelled(docs: DataFrame, topics: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(row (all columns as a struct), id, source, lang, topic, weight in words; the same but row and id, checkpointed)."""
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _label("source").alias("source"), _label("lang").alias("lang"), F.col("text").alias("_text"), F.col("text").isNull().alias("gone"), *([] if topics is None else [F.coalesce(topics.cast("string"), F.lit("none")).alias("topic")]))
    if topics is not None:
        rows = named.select("row", "id", *AXES, words("_text").alias("weight"))
        return rows, rows.select(*AXES, "weight").checkpoint()
    seen = features(named.select("source", "lang", "gone", "_text"), "_text").drop("_text").checkpoint()
    model = fit_topics(seen)
    return with_topic(features(named, "_text").drop("_text"), model).select("row", "id", *AXES, "weight"), with_topic(seen, model)


def tempered(cells: DataFrame, axis: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(axis, target): each value's share of words to the power ``temperature``, in sum 1. 1 keeps shares, 0 levels them."""
    shares = cells.groupBy(axis).agg(F.pow(F.sum("weight"), F.lit(temperature)).alias("t"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("t").alias("all")))).select(axis, (F.col("t") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """Iterative proportional fitting: (cells with ``fitted``, in sum 1, whose marginals are the targets; what these are off by at most).

    ``cells``: the axes and ``weight`` > 0. ``targets``: for each axis a table (axis, target); values that
    it lacks have target 0, and targets are scaled to the values that have cells. One sweep scales each
    cell by target / marginal along each axis in turn; sweeps end when no marginal is off by more than
    ``tolerance``. Targets that contradict each other, as cells are missing, end at ``rounds`` times
    SWEEPS sweeps, and the second result says by how much.

    Up to ONE_TASK_CELLS cells lie in one partition, where sums along any axis need no exchange; more are
    dealt by each axis. After SWEEPS sweeps the cells are checkpointed: the lineage is cut, and a lost executor costs
    no more than that.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    axes = list(targets)
    fitted = cells.withColumn("fitted", F.col("weight"))
    for a in axes:
        fitted = fitted.join(targets[a].select(a, F.col("target").cast("double").alias(f"_{a}")), a, "left").withColumn(f"_{a}", F.coalesce(f"_{a}", F.lit(0.0)))
    fitted = fitted.checkpoint()
    one = fitted.count() <= ONE_TASK_CELLS
    for a in axes:
        total = fitted.groupBy(a).agg(F.first(f"_{a}").alias("t")).agg(F.sum("t")).head()[0] or 1.0
        fitted = fitted.withColumn(f"_{a}", F.col(f"_{a}") / total)
    every = ", ".join([*axes, *(f"_{a}" for a in axes), "weight"])
    sweep = "{cells}"
    for a in axes * SWEEPS:  # one text is analysed once
        sweep = f"(SELECT {every}, coalesce(fitted * _{a} / nullif(sum(fitted) OVER (PARTITION BY {a}), 0), 0D) AS fitted FROM {sweep})"
    gap = "SELECT max(greatest(" + ", ".join(f"abs(m_{a} - _{a})" for a in axes) + ")) FROM (SELECT *, " + ", ".join(f"sum(fitted) OVER (PARTITION BY {a}) AS m_{a}" for a in axes) + " FROM {cells})"
    spark, off = cells.sparkSession, 0.0
    for _ in range(rounds):
        fitted = spark.sql(f"SELECT * FROM {sweep}", cells=fitted.coalesce(1) if one else fitted).checkpoint()
        off = spark.sql(gap, cells=fitted.coalesce(1) if one else fitted).head()[0] or 0.0
        if off <= tolerance:
            break
    return fitted.select(*axes, "weight", "fitted"), off


def keep_probabilities(fitted: DataFrame, axes: list[str], bound: float = BOUND) -> DataFrame:
    """(axes, probability): min(1, scale * fitted / weight) for the largest scale that keeps the marginals.

    A cell with fewer words than scale * fitted is kept whole and falls short, so a larger scale keeps more
    words and moves the kept shares away from the fitted ones. The scale is the largest among SCALES steps down
    from the one that keeps all, each STEP times the one before, at which no value's expected share of
    kept words is off by more than ``bound`` along any axis (the last step, if none is). All steps are
    compared in one job over cells x SCALES rows. Cells with fitted 0 go.
    """
    top = fitted.filter("fitted > 0").agg(F.max(F.col("weight") / F.col("fitted"))).head()[0]
    if top is None:
        return fitted.select(*axes, F.lit(0.0).alias("probability"))
    steps = fitted.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SCALES - 1)))).withColumn("given", F.least("weight", F.lit(top) * F.pow(F.lit(STEP), F.col("step")) * F.col("fitted")))
    off = []
    for a in axes:
        shares = steps.groupBy("step", a).agg(F.sum("given").alias("given"), F.sum("fitted").alias("fitted"))
        total = Window.partitionBy("step")
        off.append(shares.select("step", F.abs(F.col("given") / F.sum("given").over(total) - F.col("fitted") / F.sum("fitted").over(total)).alias("off")))
    fine = reduce(DataFrame.union, off).groupBy("step").agg(F.max("off").alias("off")).filter(F.round("off", 9) <= bound).agg(F.min("step")).head()[0]
    scale = top * STEP ** (SCALES - 1 if fine is None else fine)
    return fitted.select(*axes, F.least(F.lit(1.0), F.lit(scale) * F.col("fitted") / F.col("weight")).alias("probability"))


def chance(id_col: str = "id", seed: int = 0) -> Column:
    """A number in [0, 1) from the id alone: 13 hexadecimal digits of an MD5, so any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, bound: float = BOUND, seed: int = 0, topics: Column | None = None) -> DataFrame:
    """All documents with their cell, probability and decision: row, id, source, lang, topic, weight, probability, kept.

    ``targets``: for each axis a table (axis, target); default: shares of words tempered. ``topics``: a
    column of topics, if the documents have one; default: clusters of the texts' form (``fit_topics``).

    Words are summed by (source, lang, topic), map-side first, so that a hot source is one partial sum
    for each task; raking runs over cells only. Expected shares of kept words are within ``bound`` of the
    targets along each axis, but for targets that no weights of the cells meet. The cells go to the
    documents by broadcast if their bytes are few, else by a join on source, lang, topic and a salt over
    SALTS copies of the cells. Sampling is a comparison in each row: rows that repeat an id are kept or
    dropped together. Documents without words have weight 0: their cell's probability decides, or 1 if the
    cell has no words. A null source or lang is a value of its own (``?``).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows, seen = labelled(docs, topics)
    cells = seen.groupBy(*AXES).agg(F.sum("weight").alias("weight")).filter("weight > 0").checkpoint()
    targets = targets or {a: tempered(cells, a, temperature) for a in AXES}
    p = keep_probabilities(rake(cells, targets)[0].checkpoint(), AXES, bound).checkpoint()
    small = broadcast_if_small(p)
    if small is not p:
        found = rows.join(small, AXES, "left")
    else:
        salted = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*AXES, "salt"], "left").drop("salt")
    return found.withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("kept", chance("id", seed) < F.col("probability"))


def marginals(mixed: DataFrame) -> DataFrame:
    """(axis, value, before, expected, kept): each value's share of words in the input, of expected and of sampled words."""
    by = mixed.select("weight", (F.col("weight") * F.col("probability")).alias("e"), F.when(F.col("kept"), F.col("weight")).otherwise(0.0).alias("k"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES])).alias("v"))
    sums = by.groupBy("v.axis", "v.value").agg(F.sum("weight").alias("before"), F.sum("e").alias("expected"), F.sum("k").alias("kept"))
    every = Window.partitionBy("axis")
    return sums.select("axis", "value", *[(F.col(c) / F.sum(c).over(every)).alias(c) for c in ("before", "expected", "kept")])


def op5_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "source", "lang", "topic", F.col("weight").cast("long").alias("n_words"), F.round("probability", 6).alias("probability"), "kept")


def _sweep(k: int) -> str:
    out, before = [], f"s{k}_2" if k else "c0"
    for i, a in enumerate(AXES):
        name = f"s{k + 1}_{i}"
        out.append(f"{name} AS (SELECT * EXCLUDE (fitted), fitted * t_{a} / sum(fitted) OVER (PARTITION BY {a}) AS fitted FROM {before})")
        before = name
    return ",\n".join(out)


def sql(sweeps: int = 40) -> str:
    """The same in SQL, with a fixed number of sweeps that is past convergence."""
    n, axis_names = len(FORMS) + 1, range(1, len(FORMS) + 2)
    shares = ",\n".join(f"t{i} AS (SELECT {a}, sum(weight) ** {TEMPERATURE} AS t FROM cells GROUP BY {a}), u{i} AS (SELECT {a}, t / sum(t) OVER () AS t_{a} FROM t{i})" for i, a in enumerate(AXES))
    patterns = [*FORMS.values(), r"[^\x20\x09-\x0D]+"]
    quoted = ["'" + p.replace("\n", r"\n") + "'" for p in patterns]
    raw = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), {p}))::DOUBLE / greatest(length(coalesce(text, '')), 1)" for p in quoted)
    scaled = ", ".join(f"(x[{i}] - m[{i}]) / s[{i}]" for i in axis_names)
    start = ", ".join("[" + ", ".join("2.0" if k == j + 1 else "0.0" for j in range(n)) + "]" for k in range(len(TOPICS)))
    near = "(SELECT z.*, list_transform(c, lambda m: {}) AS ds FROM z, k{{}})".format(" + ".join(f"(x[{i}] - m[{i}]) * (x[{i}] - m[{i}])" for i in axis_names))
    mean = ", ".join(f"round(avg(x[{i}]), {DIGITS})" for i in axis_names)
    rounds = ",\n".join(
        f"a{r} AS MATERIALIZED (SELECT list_position(ds, list_min(ds)) AS k, x FROM {near.format(r)}), m{r} AS (SELECT k, [{mean}] AS c FROM a{r} GROUP BY k),\n"
        f"k{r + 1} AS MATERIALIZED (SELECT list_transform(range(1, {len(TOPICS) + 1}), lambda j: coalesce(own[j], c[j])) AS c FROM k{r}, (SELECT map(list(k), list(c)) AS own FROM m{r}))"
        for r in range(TOPIC_ROUNDS)
    )
    stats = f"[{', '.join(f'round(avg(x[{i}]), {DIGITS})' for i in axis_names)}] AS m, [{', '.join(f'coalesce(nullif(round(stddev_pop(x[{i}]), {DIGITS}), 0), 1)' for i in axis_names)}] AS s"
    label = "CASE WHEN {0} IS NULL THEN '?' WHEN starts_with({0}, '?') THEN '?' || {0} ELSE {0} END AS {0}"
    off = " UNION ALL ".join(f"SELECT step, abs(g / sum(g) OVER (PARTITION BY step) - f / sum(f) OVER (PARTITION BY step)) AS off FROM (SELECT step, sum(given) AS g, sum(fitted) AS f FROM steps GROUP BY step, {a})" for a in AXES)
    return f"""
WITH r AS (SELECT doc_id, text IS NULL AS gone, {label.format("source")}, {label.format("lang")},
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words, [{raw}] AS x FROM documents),
st AS (SELECT {stats} FROM r),
z AS MATERIALIZED (SELECT r.* EXCLUDE (x), [{scaled}] AS x FROM r, st),
k0 AS (SELECT [{start}] AS c),
{rounds},
d AS MATERIALIZED (SELECT doc_id, source, lang, n_words, CASE WHEN gone THEN 'none' ELSE {TOPICS!r}[list_position(ds, list_min(ds))] END AS topic FROM {near.format(TOPIC_ROUNDS)}),
cells AS (SELECT source, lang, topic, sum(n_words)::DOUBLE AS weight FROM d GROUP BY ALL HAVING sum(n_words) > 0),
{shares},
c0 AS (SELECT *, weight AS fitted FROM cells JOIN u0 USING (source) JOIN u1 USING (lang) JOIN u2 USING (topic)),
{",".join(_sweep(k) for k in range(sweeps))},
f AS MATERIALIZED (SELECT source, lang, topic, weight, fitted FROM s{sweeps}_2),
top AS (SELECT max(weight / fitted) AS top FROM f),
steps AS (SELECT f.*, step, least(weight, top * {STEP} ** step * fitted) AS given FROM f, top, range({SCALES}) q(step)),
scale AS (SELECT (SELECT top FROM top) * {STEP} ** coalesce(min(step), {SCALES - 1}) AS scale FROM (SELECT step, max(off) AS off FROM ({off}) GROUP BY step) WHERE round(off, 9) <= {BOUND}),
p AS (SELECT source, lang, topic, least(1.0, (SELECT scale FROM scale) * fitted / weight) AS probability FROM f)
SELECT doc_id, source, lang, topic, n_words, round(coalesce(probability, 1.0), 6) AS probability,
  ('0x' || substr(md5(doc_id || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(probability, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
"""
