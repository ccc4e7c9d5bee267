"""Random subsets, shuffles and permutations, repeatable by seed and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(key: str | list[str], seed: int) -> Column:
    """A number in [0, 1) from the key and the seed: 13 hexadecimal digits of an MD5, so any engine can repeat it."""
    keys = [key] if isinstance(key, str) else key
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def share(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with chance ``fraction``: no shuffle, rows in place."""
    return rows.filter(chance(key, seed) < fraction)


def subset(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement (all, if there are fewer): those with the least chances, a distributed top-k."""
    return rows.withColumn("_c", chance(key, seed)).orderBy("_c", key).limit(n).drop("_c")


def per_group(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group."""
    w = Window.partitionBy(by).orderBy(chance(key, seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in a random order."""
    return rows.orderBy(chance(key, seed), key)
