"""Reference lookups: filters, a limit before grouping, two-level groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(items: DataFrame, limit: int, order: list[str], **wanted: str | None) -> DataFrame:
    """The first `limit` items for which every given column has the wanted value."""
    for column, value in wanted.items():
        if value is not None:
            items = items.filter(F.col(column) == value)
    return items.orderBy(*order).limit(limit)


def grouped(items: DataFrame, outer: list[str], inner: str, order: list[str], first: int = 3) -> DataFrame:
    """outer, inner, count and the first positions of each inner group, with its order of appearance in the outer group."""
    numbered = items.withColumn("_k", F.row_number().over(Window.partitionBy(*outer, inner).orderBy(*order)))
    per = numbered.groupBy(*outer, inner).agg(
        F.count("*").alias("n"), F.min(F.struct(*order)).alias("_seen"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= first, F.struct(*order)))), lambda x: x[order[0]]).alias("positions"),
    )
    return per.withColumn("place", F.row_number().over(Window.partitionBy(*outer).orderBy("_seen", inner))).drop("_seen")
