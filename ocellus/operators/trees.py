"""Trees as parent tables: pushing leaves to a cut, histograms over nodes, words of quantizer trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parents_frame(spark: SparkSession, parents: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, int(p)) for k, p in enumerate(parents)], "node int, parent int")


def ancestors(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """node, ancestor, depth: every node with itself and all above it; a root's parent is not above it."""
    tree.createOrReplaceTempView("_tree")
    return spark.sql("""
        WITH RECURSIVE up(node, ancestor, depth) AS (
          SELECT node, node, 0 FROM _tree WHERE parent >= 0
          UNION ALL
          SELECT up.node, t.parent, up.depth + 1 FROM up JOIN _tree t ON t.node = up.ancestor WHERE t.parent > t.node)
        SELECT node, ancestor, depth FROM up""")


def histogram(rows: DataFrame, above: DataFrame, node: str = "node") -> DataFrame:
    """node, n for every node of the tree: rows at it or below it. Leaves are counted before the join."""
    leaves = rows.groupBy(node).agg(F.count(F.lit(1)).alias("_n"))
    return leaves.join(F.broadcast(above), node).groupBy(F.col("ancestor").alias("node")).agg(F.sum("_n").alias("n"))


def levels(rows: DataFrame, branch: int, depth: int, node: str = "node") -> DataFrame:
    """level, node, n: histograms of quantizer words at every level; a word's parent is word div branch."""
    leaves = rows.groupBy(F.col(node).cast("long").alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    each = leaves.select(F.posexplode(F.array(*[F.expr(f"_w div {branch**k}") for k in range(depth)])).alias("level", "node"), "_n")
    return each.groupBy("level", "node").agg(F.sum("_n").alias("n"))
