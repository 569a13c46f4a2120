"""Ranking under constraints: priorities, protected top-k, truncation at score cliffs. All windows are per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.operators.scoring import PROTECTED

# What a mode reads, how many candidates a mode or profile keeps.
READ_PLAN_MAX = {"minimal": 4, "precision": 8, "recall": 12}
MODE_LIMIT = {"minimal": 18, "precision": 45, "recall": 70}
PROFILE_LIMIT = {"port": 20, "parser": 18, "controller": 16, "dto": 24}
SMALLEST, STRONG, BUDGET, FLOOR, CLIFF = 10, 6, 4, 8, 0.5


def read_plan_max(mode: str, wanted: int | None = None) -> int:
    return wanted if wanted is not None else READ_PLAN_MAX.get(mode, 6)


def candidate_limit(mode: str, profile: str | None = None) -> int:
    return MODE_LIMIT.get(mode) or PROFILE_LIMIT.get(profile or "", 26)


def priority(test_read_mode: str = "defer") -> Column:
    """0 to 2 of a candidate (source_set, categories, reasons); the first case that holds counts."""
    has = lambda column, x: F.coalesce(F.array_contains(F.col(column), x), F.lit(False))
    main = F.col("source_set").eqNullSafe("main")
    return (
        F.when(F.col("source_set").eqNullSafe("test"), 1 if test_read_mode == "priority" else 2)
        .when(has("categories", "config") | has("categories", "nonJava"), 2)
        .when(has("reasons", "target") | (has("reasons", "implementation") & main), 0)
        .when(main, 1)
        .otherwise(2)
    )


def read_reason(p: Column) -> Column:
    """Why a candidate is in the read plan. The texts."""
    has = lambda column, x: F.coalesce(F.array_contains(F.col(column), x), F.lit(False))
    return (
        F.when(has("reasons", "target"), "anchor symbol and local behavior")
        .when(has("reasons", "implementation"), "main implementation candidate")
        .when(has("categories", "persistence"), "persistence or migration evidence")
        .when(F.col("source_set").eqNullSafe("test") & (p == 1), "priority verification candidate")
        .when(F.col("source_set").eqNullSafe("test"), "deferred verification candidate")
        .otherwise("ranked candidate from source index, rg summary, and optional LSP")
    )


def exclude_modules(candidates: DataFrame, modules: list[str]) -> DataFrame:
    return candidates.filter(F.col("module").isNull() | ~F.col("module").isin(modules)) if modules else candidates


def suppression_counts(candidates: DataFrame, scored: DataFrame, modules: list[str], by: list[str]) -> DataFrame:
    """by, deferred_tests, cross_module_consumers, excluded_modules: candidates in modules, and of the scored rest those that a ledger's entry holds back."""
    noted = lambda i: F.count_if(F.exists("ledger", lambda e: e["id"] == i))
    held = scored.groupBy(*by).agg(noted("finalize.defer-test").alias("deferred_tests"), noted("finalize.cross-module").alias("cross_module_consumers"))
    out = candidates.groupBy(*by).agg(F.count_if(F.coalesce(F.col("module").isin(modules), F.lit(False)) if modules else F.lit(False)).alias("excluded_modules"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(held, by, "left").select(*by, zero("deferred_tests"), zero("cross_module_consumers"), "excluded_modules")


def rank(scored: DataFrame, by: list[str], key: str = "path", collation: str | None = None) -> DataFrame:
    """scored with rank: by score, then key; collation: e.g. UNICODE for the order of a reader rather than of bytes."""
    k = F.collate(F.col(key), collation) if collation else F.col(key)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), k)))


def priority_top(scored: DataFrame, by: list[str], k: int, key: str = "path") -> DataFrame:
    """The first k by priority, score and key."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("priority", F.desc("score"), key))).filter(F.col("place") <= k)


def protected_top(scored: DataFrame, by: list[str], k: int, protected: str = "protected", key: str = "path") -> DataFrame:
    """k rows, protected ones first; place is their order by priority, score and key."""
    chosen = scored.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(protected), "priority", F.desc("score"), key))).filter(F.col("turn") <= k)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("priority", F.desc("score"), key))).drop("turn")


def is_strong(ledger: Column) -> Column:
    return F.exists(ledger, lambda e: (e["delta"] > 0) & e["id"].isin(PROTECTED))


def truncate_tail(ranked: DataFrame, by: list[str], limit: Column | int, key: str = "path") -> DataFrame:
    """ranked (score, strong, covered) without the tail that the evidence makes dispensable.

    Up to ten rows all stay. With fewer than six strong rows the limit alone cuts, covered rows first. Otherwise strong and covered rows
    stay, and of the others those before the first that scores under half of its predecessor, half as many as there are strong ones and
    four at most, but filled up to eight rows or the covered ones; last the limit applies to the others.
    """
    whole, limit = Window.partitionBy(*by), F.lit(limit) if isinstance(limit, int) else limit
    order = (F.desc("score"), F.asc(key))
    t = ranked.withColumn("kept", F.col("strong") | F.col("covered"))
    t = t.withColumns(
        {
            "n": F.count("*").over(whole), "n_strong": F.count_if("strong").over(whole), "n_covered": F.count_if("covered").over(whole), "n_kept": F.count_if("kept").over(whole),
            "idx": F.row_number().over(Window.partitionBy(*by, "kept").orderBy(*order)) - 1,
            "open_idx": F.row_number().over(Window.partitionBy(*by, "covered").orderBy(*order)) - 1,
            "before": F.lag("score").over(Window.partitionBy(*by, "kept").orderBy(*order)),
        }
    )
    drop = ~F.col("kept") & (F.col("score") < F.col("before") * CLIFF)
    t = t.withColumn("cliff", F.coalesce(F.min(F.when(drop, F.col("idx"))).over(whole), F.col("n") - F.col("n_kept")))
    others = F.col("n") - F.col("n_kept")
    keep = F.least(F.floor(F.col("n_strong") / 2), F.lit(BUDGET), F.col("cliff"))
    floor = F.greatest(F.col("n_covered"), F.lit(FLOOR))
    filled = F.least(others, keep + F.greatest(F.lit(0), floor - (F.col("n_kept") + F.least(keep, others))))
    final = F.when(F.col("n_kept") + filled <= limit, filled).otherwise(F.greatest(limit - F.col("n_kept"), F.lit(0)))
    stays = (
        F.when(F.col("n") <= SMALLEST, True)
        .when(F.col("n_strong") < STRONG, (F.col("n") <= limit) | F.col("covered") | (F.col("open_idx") < limit - F.col("n_covered")))
        .otherwise(F.col("kept") | (F.col("idx") < final))
    )
    return t.filter(stays).select(*ranked.columns)


def truncated(rows: DataFrame, limit: int, *order) -> tuple[DataFrame, bool]:
    """The first rows and whether there are more."""
    some = rows.orderBy(*order).limit(limit + 1)
    return some.limit(limit), some.count() > limit
