"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), component the least node of each.

    Alternates large-star and small-star steps: every node hands its larger, then its smaller neighbours to the least one it sees, which
    ends after a logarithmic number of rounds with every node at its least. Minima are aggregated before each join, so a node with very
    many neighbours is one row of one side.
    """
    now = checkpoint(spark, edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "k")
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = checkpoint(spark, large)
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "k")
        small = large.join(least, F.col("b") == F.col("k")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        now = checkpoint(spark, small.filter("a <> b").distinct())
