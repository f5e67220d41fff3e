"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_since, materialise, most_files, written


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(spark: SparkSession, edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v long): root is the smallest node that it is connected with. ``files``: of each work table, at most.

    Both steps replace a node's edges by as many edges to its smallest neighbour, so the
    table never grows past one row an edge, and hub nodes are aggregated before the shuffle.
    """
    mark, files = written(), files or most_files(spark)
    now = materialise(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", files)
    seen = _print(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        now = materialise(spark, small, "edges", files)
        drop_since(spark, mark, (now,))
        if (then := _print(now)) == seen:
            break
        seen = then
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
