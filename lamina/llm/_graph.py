"""Connected components by alternating large-star and small-star steps.

Each step takes minima per node with partial sums and joins them back, so a node with very many
links is no hot group; each step's links are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import released


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    over = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return over.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _is_star(e: DataFrame) -> bool:
    """Whether each node has one link, to a smaller node that has none."""
    ends = e.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("c")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("c")))
    return ends.groupBy("a").agg(F.sum("n").alias("n"), F.max("c").alias("c")).filter("n > 1 or (n > 0 and c > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that is not itself the smallest. links: a, b with a != b."""
    e = released(_small_star(links.filter("a != b")), "links")
    while not _is_star(e):
        e = released(_small_star(released(_large_star(e), "links")), "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
