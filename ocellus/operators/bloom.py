"""Inverted Bloom index: sparse postings of (hasher, bucket, clip), IDF weights, scores by an equi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(points: DataFrame) -> DataFrame:
    """Distinct (hasher, bucket, clip): a clip's repeated features count once."""
    return points.select("hasher", "bucket", "clip").distinct()


def idf(post: DataFrame, n_clips: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """hasher, bucket, cnt, idf: log of clips over clips with the bucket; an integer quotient unless ``exact``."""
    n = (n_clips if n_clips is not None else post.select("clip")).agg(F.count_distinct("clip").alias("n"))
    counts = post.groupBy("hasher", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    quotient = F.col("n") / F.col("cnt") if exact else F.expr("n div cnt").cast("double")
    return counts.join(F.broadcast(n)).select("hasher", "bucket", "cnt", F.log(quotient).alias("idf"))


def norms(post: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """clip, norm: (sum of squared idf) ** alpha."""
    return post.join(weights, ["hasher", "bucket"]).groupBy("clip").agg(F.pow(F.sum(F.col("idf") * F.col("idf")), F.lit(alpha)).alias("norm"))


@dataclass
class BloomIndex:
    """postings, idf and norms of a collection."""

    postings: DataFrame
    weights: DataFrame
    norms: DataFrame

    @classmethod
    def fit(cls, points: DataFrame, alpha: float = 0.5, exact: bool = False) -> BloomIndex:
        post = postings(points)
        weights = idf(post, exact=exact)
        return cls(post, weights, norms(post, weights, alpha))

    def query(self, features: DataFrame) -> DataFrame:
        """query_id, clip, score: minus the idf**2 of hits over the clip's norm, 0 without hits; smaller is better.

        features: query_id, hasher, bucket, a row for each feature; repeated features count each time.
        A clip with norm 0 scores 0. The query's features are summed by bucket before the join.
        """
        asked = features.groupBy("query_id", "hasher", "bucket").agg(F.count(F.lit(1)).alias("times"))
        hits = asked.join(self.weights, ["hasher", "bucket"]).join(self.postings, ["hasher", "bucket"])
        sums = hits.groupBy("query_id", "clip").agg(F.sum(F.col("times") * F.col("idf") * F.col("idf")).alias("hit"))
        every = features.select("query_id").distinct().join(F.broadcast(self.norms)) if self.norms.count() <= 1_000_000 else features.select("query_id").distinct().join(self.norms)
        found = every.join(sums, ["query_id", "clip"], "left")
        return found.select("query_id", "clip", F.when(F.col("norm") > 0, -F.coalesce("hit", F.lit(0.0)) / F.col("norm")).otherwise(F.lit(0.0)).alias("score"))
