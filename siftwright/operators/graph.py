"""Bounded walks over edges and searches among ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_walk(edges: DataFrame, starts: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(query_id, depth, src, dst) of the edges (src, dst) within `depth` steps of starts (query_id, node).

    Every edge out of a frontier is listed at its depth, each once a depth, so cycles end with the depth. limit: edges per query, in order
    of depth, src and dst. One join per step; the frontier is distinct, so a step costs no more than the edges.
    """
    frontier, found = starts.select("query_id", "node").distinct(), None
    for step in range(1, depth + 1):
        reached = frontier.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select("query_id", F.lit(step).alias("depth"), "src", "dst")
        found = reached if found is None else found.unionByName(reached)
        frontier = reached.select("query_id", F.col("dst").alias("node")).distinct()
    if limit is not None:
        found = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "src", "dst"))).filter(F.col("k") <= limit).drop("k")
    return found


def build_root(paths: DataFrame, builds: DataFrame) -> DataFrame:
    """(path, root) of the directory whose build file governs each path.

    The nearest settings.gradle, else the topmost Maven aggregator or else the topmost pom.xml, else the nearest build.gradle; builds are
    (dir, name, aggregator).
    """
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))).alias("a")).select("path", "a.*")
    found = above.join(builds, "dir")
    name, deep = F.col("name"), F.col("depth")
    best = found.groupBy("path").agg(
        F.max(F.when(name.startswith("settings.gradle"), deep)).alias("s"), F.min(F.when((name == "pom.xml") & F.col("aggregator"), deep)).alias("m"),
        F.min(F.when(name == "pom.xml", deep)).alias("p"), F.max(F.when(name.startswith("build.gradle"), deep)).alias("g"),
    )
    depth = F.coalesce("s", "m", "p", "g")
    return best.filter(depth.isNotNull()).select("path", F.array_join(F.slice(F.split("path", "/"), F.lit(1), depth), "/").alias("root"))


def deepest_root(probes: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, alias) of the deepest root (alias, root) that holds each path; ancestors meet roots in an equi-join."""
    parts = F.split("path", "/")
    above = probes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    return above.join(roots, "root").groupBy("path").agg(F.max_by("alias", F.char_length("root")).alias("alias"))
