"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import stored


def _hung(sym: DataFrame, only_larger: bool) -> DataFrame:
    """Each vertex's neighbours hung below the smallest of them and itself. sym: links (u, v) as each step sees them."""
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = sym.join(least, "u")
    if only_larger:
        return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root) of every vertex that a link names; root is the smallest id that it reaches.

    Links may repeat, run either way or be loops; ids are longs, links with a null are left out. Each
    step is an aggregation (combined map-side) and a join with its result, so a vertex with very many
    links is split like any other; the number of rounds grows as the logarithm of the longest path.
    Every round is a stored table, so a lost executor costs no more than one round.
    """
    vertices = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges, seen = stored(vertices.distinct(), "links"), None
    every = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    edges = edges.filter("a <> b")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = _hung(both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), True)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
        edges = stored(_hung(down, False).filter("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return every.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
