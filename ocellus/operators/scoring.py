"""Scores of database items for queries: weighted Hamming or inner products under asymmetric word selection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import vec

FLT_MAX = 3.4028234663852886e38
OFF, QAGS, DAGS, SGS = "off", "qags", "dags", "sgs"


@dataclass(frozen=True)
class QueryParams:
    """mode: which words count. threshold: a word counts if its strength exceeds it. power: of the norm.

    min_words: items with at most so many selected words rank last. corr_weights: for binarized words,
    33 weights by agreeing bits. top_k: results a query.
    """

    mode: str = QAGS
    threshold: float = 0.0
    power: float = 0.5
    min_words: int = 0
    word_dim: int = 32
    words: int = 2
    top_k: int = 5
    corr_weights: tuple[float, ...] = field(default=tuple(k / 32 for k in range(33)))


def hamming_weights(corr_weights: tuple[float, ...], dim: int = 32) -> list[float]:
    """Product of two binarized words by Hamming distance: positive below half the bits, else 0."""
    return [corr_weights[dim - h] / 2 * (dim - 2 * h) if 2 * h < dim else 0.0 for h in range(dim + 1)]


def words_selected(strengths: Column, params: QueryParams) -> Column:
    """All words for modes OFF and QAGS, else the number of strengths above the threshold."""
    if params.mode in (OFF, QAGS):
        return F.lit(params.words)
    return F.size(F.filter(strengths, lambda s: s > params.threshold))


def score(params: QueryParams, q_strengths: Column, d_strengths: Column, q_fv: Column | None = None, d_fv: Column | None = None, q_bits: Column | None = None, d_bits: Column | None = None, q_energy: Column | None = None, d_energy: Column | None = None) -> Column:
    """Score of an item, smaller is better; FLT_MAX where a norm or the product is 0, or too few words are selected.

    Give the vectors for inner products, or the packed words for weighted Hamming similarity. With
    vectors give the words' squared lengths too where they are at hand (see ``energies``), else they
    are computed for each pair.
    """
    zero, t, dim = F.lit(0.0), params.threshold, params.word_dim
    product, qn, dn, extra = [], [], [], []
    weights = F.array(*[F.lit(w) for w in hamming_weights(params.corr_weights, dim)])
    for k in range(params.words):
        qs, ds = q_strengths[k] > t, d_strengths[k] > t
        if q_fv is not None:
            a, b = vec.word(q_fv, k, dim), vec.word(d_fv, k, dim)
            like = vec.dot(a, b)
            qe = vec.l2sq(a) if q_energy is None else q_energy[k]
            de = vec.l2sq(b) if d_energy is None else d_energy[k]
        else:
            like = weights[vec.hamming(q_bits[k], d_bits[k])]
            qe = de = F.lit(float(dim))
        used, qu, du = {OFF: (F.lit(True),) * 3, QAGS: (qs, qs, qs), DAGS: (ds, ds, ds), SGS: (qs & ds, qs, ds)}[params.mode]
        product.append(F.when(used, like).otherwise(zero))
        qn.append(F.when(qu, qe).otherwise(zero))
        dn.append(F.when(du, de).otherwise(zero))
        extra.append(F.when(ds, de).otherwise(zero))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    ip, qn, dn, extra = add(product), add(qn), add(dn), add(extra)
    if params.mode == QAGS:
        value = F.when((qn != 0) & (dn != 0) & (extra != 0), ip / F.sqrt(qn * dn) * F.pow(extra, F.lit(0.5 - params.power)))
    else:
        value = F.when((qn != 0) & (dn != 0), ip / F.pow(qn * dn, F.lit(params.power)))
    value = F.coalesce(-value, F.lit(FLT_MAX))
    return F.when(words_selected(d_strengths, params) <= params.min_words, F.lit(FLT_MAX)).otherwise(value)


def ranked(scored: DataFrame, k: int | None, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """Rank from 1 by ascending score, ties by item; the first k of each query, if k is given."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score, item)))
    return out if k is None else out.filter(F.col("rank") <= k)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes, from the lengths of its arrays and strings."""
    width = {"array": lambda c: 16 + 8 * F.size(c), "string": lambda c: 16 + F.octet_length(c), "binary": lambda c: 16 + F.octet_length(c)}
    kinds = [(f.name, f.dataType.typeName()) for f in df.schema]
    return reduce(lambda a, b: a + b, [F.coalesce(width[k](F.col(c)).cast("long"), F.lit(16)) if k in width else F.lit(8).cast("long") for c, k in kinds])


def compared(queries: DataFrame, items: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Every query with every item: queries are broadcast in blocks of at most about ``most_bytes``, items stay where they are."""
    size = queries.agg(F.sum(row_bytes(queries))).head()[0] or 0
    if size <= most_bytes:
        return items.join(F.broadcast(queries))
    blocks = -(-size * 5 // (4 * most_bytes))  # hashing deals them unevenly
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = [items.join(F.broadcast(numbered.filter(F.col("_b") == b).drop("_b"))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def energies(fv: Column, params: QueryParams) -> Column:
    """Squared length of each word of a vector."""
    return F.array(*[vec.l2sq(vec.word(fv, k, params.word_dim)) for k in range(params.words)])


def prepared(queries: DataFrame, items: DataFrame, params: QueryParams) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with what depends on one side alone, and the score of a joined row."""
    if "q_fv" in queries.columns:
        queries, items = queries.withColumn("q_energy", energies(F.col("q_fv"), params)), items.withColumn("d_energy", energies(F.col("d_fv"), params))
        names = ("q_fv", "d_fv", "q_energy", "d_energy")
    else:
        names = ("q_bits", "d_bits")
    given = {n: F.col(n) for n in names}
    return queries, items, score(params, F.col("q_strengths"), F.col("d_strengths"), **given)


def scored_pairs(queries: DataFrame, items: DataFrame, params: QueryParams) -> DataFrame:
    """query_id, item_id, score of every query with every item."""
    queries, items, value = prepared(queries, items, params)
    return compared(queries, items).select("query_id", "item_id", value.alias("score"))


def with_descriptors(queries: DataFrame, descriptors: DataFrame) -> DataFrame:
    """queries with their precomputed descriptors (query_id and further columns). ValueError unless there is exactly one for each."""
    joined = queries.select("query_id").join(descriptors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "full")
    asked, given = queries.count(), descriptors.count()
    if asked != given or joined.filter("n IS NULL OR n <> 1").limit(1).count() or queries.join(descriptors, "query_id", "left_semi").count() != asked:
        raise ValueError(f"{asked} queries and {given} descriptors don't match")
    return queries.join(descriptors, "query_id")


def search(queries: DataFrame, items: DataFrame, params: QueryParams) -> DataFrame:
    """query_id, item_id, score, rank: the best items of each query.

    queries: query_id, q_strengths, and q_fv or q_bits. items: item_id, d_strengths, and d_fv or d_bits.
    """
    return ranked(scored_pairs(queries, items, params), params.top_k)


def first_per_clip(results: DataFrame, k: int) -> DataFrame:
    """The best result of each (query, clip), ranked anew; the first k clips."""
    best = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "clip").orderBy("rank"))).filter("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def best_per_clip(scored: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, clip, score, rank: the best item of each (query, clip), the best k clips.

    One aggregation, combined map-side, leaves a row for each clip before anything is ranked.
    """
    best = scored.groupBy("query_id", "clip").agg(F.min(F.struct("score", "item_id")).alias("b")).select("query_id", "b.item_id", "clip", "b.score")
    return ranked(best, k)


def rescore(first: DataFrame, groups: DataFrame, queries: DataFrame, items: DataFrame, value: Column, shortlist: int, k: int) -> DataFrame:
    """Second stage: only members of a query's best ``shortlist`` groups meet the query, and are ranked by ``value``.

    first: query_id, item_id (a group), rank. groups: group_id, member_id. value: the score of a joined row of
    queries (query_id ...) and items (item_id ...).
    """
    best = first.filter(F.col("rank") <= shortlist).select("query_id", F.col("item_id").alias("group_id"))
    members = best.join(groups, "group_id").select("query_id", F.col("member_id").alias("item_id")).distinct()
    pairs = members.join(queries, "query_id").join(items, "item_id")
    return ranked(pairs.select("query_id", "item_id", value.alias("score")), k)


def rerank(first: DataFrame, groups: DataFrame, rescored: DataFrame, shortlist: int, k: int) -> DataFrame:
    """Second stage: members of a query's best ``shortlist`` groups, by their own second score alone.

    first: query_id, item_id (a group), rank. groups: group_id, member_id. rescored: query_id, item_id
    (a member), score.
    """
    best = first.filter(F.col("rank") <= shortlist).select("query_id", F.col("item_id").alias("group_id"))
    members = best.join(groups, "group_id").select("query_id", F.col("member_id").alias("item_id")).distinct()
    return ranked(rescored.join(members, ["query_id", "item_id"]), k)
