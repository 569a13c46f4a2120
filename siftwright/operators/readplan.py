"""Read windows: innermost intervals around positions, and the lines to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines before and after by priority; padding of a method that fits.
RADIUS = {0: (24, 44), 1: (16, 32), 2: (10, 22)}
PADDING = {0: (12, 8), 1: (8, 8)}


def innermost(probes: DataFrame, spans: DataFrame, keys: list[str], point: str = "line") -> DataFrame:
    """probes with name, start and end of the innermost span (keys, name, start, end) that holds point; null without one.

    Equal probes are one group while spans are compared and as many rows as before in the result.
    """
    alike = probes.groupBy(*probes.columns).agg(F.count("*").alias("_times"))
    found = (
        alike.alias("p")
        .join(spans.alias("s"), [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col(f"p.{point}").between(F.col("s.start"), F.col("s.end"))], "left")
        .groupBy(*[F.col(f"p.{c}").alias(c) for c in alike.columns])
        .agg(F.max_by(F.struct("s.name", "s.start", "s.end"), F.struct(F.col("s.start"), -F.col("s.end"), F.col("s.name"))).alias("span"))
    )
    return found.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*probes.columns, "span.*")


def latest_before(probes: DataFrame, events: DataFrame, keys: list[str], at: str, time: str, value: str) -> DataFrame:
    """probes with the value of the last event at or before them: a backward as-of join.

    Probes and events of a key run through one sorted window, so a probe never meets more than its predecessor; ties by value.
    """
    from pyspark.sql import Window

    left = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(events.schema[value].dataType).alias("_v"))
    right = events.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return both.filter("_side = 1").select("_row.*", F.col("_last").alias(value))


def fixed_window(p: Column, line: Column) -> tuple[Column, Column]:
    before = F.coalesce(*[F.when(p == k, b) for k, (b, _) in RADIUS.items()])
    after = F.coalesce(*[F.when(p == k, a) for k, (_, a) in RADIUS.items()])
    return F.greatest(F.lit(1), line - before), line + after


def read_window(p: Column, line: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Lines to read around line: the method's with padding if it lies within the fixed window, else that."""
    first, last = fixed_window(p, line)
    before, after = F.when(p == 0, PADDING[0][0]).otherwise(PADDING[1][0]), F.lit(PADDING[0][1])
    low, high = F.greatest(F.lit(1), start - before), end + after
    fits = F.coalesce((p != 2) & (low >= first) & (high <= last), F.lit(False))
    return F.when(fits, low).otherwise(first), F.when(fits, high).otherwise(last)


def preview(items: DataFrame, probes: DataFrame, keys: list[str], text: str = "text", radius: int = 2) -> DataFrame:
    """keys, at and preview: the numbered lines around each probe (keys, line) of items (keys, text) as one text; none beyond the text."""
    met = items.select(*keys, text).join(probes.select(*keys, F.col("line").alias("at")), keys).withColumn("_lines", F.split(text, "\r?\n")).filter(F.col("at") - radius <= F.size("_lines"))
    first = F.greatest(F.lit(1), F.col("at") - radius)
    near = F.slice("_lines", first, F.col("at") + radius - first + 1)
    numbered = F.transform(near, lambda value, k: F.concat(F.lpad((first + k).cast("string"), 5, " "), F.lit(": "), value))
    return met.select(*keys, "at", F.array_join(numbered, "\n").alias("preview"))
