"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm._store import fresh_path, remove, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    around = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link to another.

    Loops and repeated links change nothing; without links the result is empty.
    Hot nodes are met by partial aggregates and by joins that AQE can split, and every
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    x, y = F.col(a), F.col(b)
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "links")
    now = store(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links", path)
    while not _stars(now):
        last, path = path, fresh_path(spark, "links")
        now = store(_small_star(_large_star(now)), "links", path)
        remove(spark, last)
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one link down or is what others link to: then the links are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return seen.where("down > 1 or (down = 1 and least = 0)").isEmpty()
