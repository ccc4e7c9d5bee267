"""Index tables: concatenation with global ordinals, saved and loaded with the columns a mode needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def concatenated(parts: list[DataFrame], item: str = "item_id", ranges: int = 64) -> DataFrame:
    """All rows with ``ordinal``: parts follow each other, each in the order of ``item`` (a number).

    Ordinals are row numbers within ranges between approximate quantiles of the items plus the sizes of
    all ranges before, a table of ``ranges`` rows for each part, so no task numbers a whole part.
    """
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    cuts = rows.groupBy("_part").agg(F.percentile_approx(item, [k / ranges for k in range(1, ranges)], 10_000).alias("_q"))
    rows = rows.join(F.broadcast(cuts), "_part").withColumn("_r", F.size(F.filter("_q", lambda q: q <= F.col(item)))).drop("_q")
    sizes = rows.groupBy("_part", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_part", "_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part", "_r").orderBy(item)) - 1
    return rows.withColumn("_o", own).join(F.broadcast(before), ["_part", "_r"]).withColumn("ordinal", F.col("_o") + F.col("_b")).drop("_part", "_r", "_o", "_b")


def save(index: DataFrame, path: str, collection: str | None = None) -> None:
    """Append to an index, partitioned by collection if the column is named."""
    writer = index.write.mode("append")
    (writer.partitionBy(collection) if collection else writer).parquet(path)


def load(spark: SparkSession, path: str, selection: str = "l1", both: bool = False) -> DataFrame:
    """An index with one strength column (``l1`` or ``soft``), or both; the other is never read."""
    index = spark.read.parquet(path)
    drop = [] if both else [c for c in ("l1", "soft") if c != selection]
    return index.drop(*drop)


def unfinished(wanted: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Work whose output isn't there yet."""
    return wanted.join(done.select(key), key, "left_anti")
