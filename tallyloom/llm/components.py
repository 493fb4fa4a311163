"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours of the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def one_round(links: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, with the same components and shorter ways to their smallest nodes."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    return _small_star(_large_star(edges))


def components(links: DataFrame, root: str) -> DataFrame:
    """node and component (its smallest node) of every node of links (u, v) that isn't its component's smallest.

    Each step is written to the folder `root`, so lineage stays short; steps stop when the edges are stars that no step changes.
    """
    spark = links.sparkSession
    edges = links
    mark = None
    step = 0
    while True:
        step += 1
        after = save(one_round(edges) if step == 1 else _small_star(_large_star(edges)), f"{root}/edges{step}")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if step > 1:
            drop(spark, f"{root}/edges{step - 1}")
        edges = after
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
