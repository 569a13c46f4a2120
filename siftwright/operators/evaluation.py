"""Retrieval quality: set measures, percentiles, attribution, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.text import half_up


def golden_entries(scenarios: DataFrame) -> DataFrame:
    """(id, kind, path) of must, should and side files of scenarios."""
    kinds = {"must": "mustHit", "should": "shouldHit", "side": "side"}

    def listed(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(f"golden.{column}"), F.array().cast("array<string>")), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("path")))

    rows = F.flatten(F.array(*[listed(k, c) for k, c in kinds.items()]))
    return scenarios.select("id", F.explode(rows).alias("g")).select("id", "g.kind", "g.path")


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def retrieval_metrics(candidates: DataFrame, golden: DataFrame, by: list[str], key: str = "path") -> DataFrame:
    """Precision, recall, precision at 5 and 10, and the shares of planned and must-read items.

    candidates are (by, key, rank, planned), golden (by, key, must). Without candidates precision is 0; without golden items recall is 1.
    """
    both = candidates.join(golden.withColumn("golden", F.lit(True)), [*by, key], "full")
    is_candidate, is_golden, planned = F.col("rank").isNotNull(), F.coalesce(F.col("golden"), F.lit(False)), F.coalesce(F.col("planned"), F.lit(False))
    must = is_golden & F.coalesce(F.col("must"), F.lit(False))
    n = lambda c: F.count_if(c)
    out = both.groupBy(*by).agg(
        n(is_candidate).alias("returned"), n(is_golden).alias("wanted"), n(is_candidate & is_golden).alias("hits"),
        *[n(F.col("rank") <= k).alias(f"top{k}") for k in (5, 10)], *[n((F.col("rank") <= k) & is_golden).alias(f"hits{k}") for k in (5, 10)],
        n(planned).alias("planned"), n(planned & is_golden).alias("planned_hits"), n(must).alias("must"), n(must & planned).alias("must_planned"),
    )
    c = F.col
    return out.select(
        *by, "returned", "hits", share(c("hits"), c("returned"), 0.0).alias("precision"), share(c("hits"), c("wanted"), 1.0).alias("recall"),
        share(c("hits5"), c("top5"), 0.0).alias("p_at_5"), share(c("hits10"), c("top10"), 0.0).alias("p_at_10"),
        share(c("planned_hits"), c("planned"), 1.0).alias("p_read"), share(c("must_planned"), c("must"), 1.0).alias("r_read_must"),
    )


# Sources of a golden hit, the first that verified it counts.
SOURCES = ["reference", "typeHierarchy", "typeReference", "seed", "typeGraph", "rg"]


def golden_source(verified_by: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(verified_by, s), F.lit(s)) for s in SOURCES], F.lit("unknown"))


def attribution(golden: DataFrame, candidates: DataFrame, by: list[str], key: str = "path") -> DataFrame:
    """golden with in_files, in_plan, source and what blocked it."""
    joined = golden.join(candidates.select(*by, key, "planned", "verified_by"), [*by, key], "left")
    in_files, in_plan = F.col("planned").isNotNull(), F.coalesce("planned", F.lit(False))
    return joined.select(
        *golden.columns, in_files.alias("in_files"), in_plan.alias("in_plan"), F.when(in_files, golden_source(F.col("verified_by"))).otherwise("unknown").alias("source"),
        F.when(in_plan, "hit").when(in_files, "readplan-full").otherwise("absent").alias("blocked_by"),
    )


def mean_missing_as_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)) / F.count("*")


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def upper_median(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, samples, the least, greatest and upper middle value; by ranks, so no group is gathered."""
    some = rows.filter(F.col(column).isNotNull())
    ranked = some.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(column))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.count("*").alias("samples"), F.min(column).alias("least"), F.max(column).alias("most"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col(column))).alias("median"))


def adjacent_change(runs: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """runs with the value before, the difference and its percentage (0 if there was nothing)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    before = F.lag(column).over(w)
    percent = F.when(before > 0, half_up((F.col(column) - before) * 10000 / before) / 100).otherwise(F.lit(0.0))
    return runs.withColumns({"before": before, "delta": F.col(column) - before, "delta_pct": percent}).filter(F.col("before").isNotNull())


def payload_tokens(size: Column) -> Column:
    """Tokens that so many bytes are estimated at."""
    return half_up(size / 4)


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part / whole * 10000) / 10000).otherwise(F.lit(0.0))
