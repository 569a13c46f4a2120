"""Retrieval: lines, pattern sections in one pass, and the merge of evidence per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = ["low", "medium", "high"]


def scan_lines(items: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line (from 1) and value of every line; carriage returns before line feeds don't count."""
    return items.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("k", "value")).select(*keys, (F.col("k") + 1).alias("line"), "value")


def fused(terms: list[str]) -> str:
    """One pattern of the distinct terms that aren't empty."""
    return "|".join(dict.fromkeys(t for t in terms if t))


def prune_sections(sections: list[dict]) -> list[dict]:
    """Sections that have a pattern and somewhere to look."""
    return [s for s in sections if s.get("pattern") and s.get("paths", True)]


def section_matches(lines: DataFrame, sections: list[dict], keys: list[str]) -> DataFrame:
    """keys, line, section and category of every line that a section's pattern is found in; lines are read once for all sections."""
    tests = [F.when(F.col("value").rlike(s["pattern"]), F.struct(F.lit(k).alias("section"), F.lit(s["category"]).alias("category"))) for k, s in enumerate(sections)]
    found = lines.withColumn("hit", F.explode(F.array_compact(F.array(*tests))))
    return found.select(*keys, "line", "hit.section", "hit.category")


def per_item(matches: DataFrame, keys: list[str], first: int = 4) -> DataFrame:
    """match_count and the first line positions of each section and item; at most `first` of them are ever gathered."""
    by = ["section", "category", *keys]
    ranked = matches.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("line")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= first, F.col("line"))))
    return ranked.groupBy(*by).agg(F.count("*").alias("match_count"), top.alias("lines"))


def merge_evidence(evidence: DataFrame, positions: int = 8) -> DataFrame:
    """One row per query and path from rows of EVIDENCE: sums, unions in order of (stage, ord), the best confidence, the first context."""
    place = F.struct("stage", "ord")

    def ordered(column: str):
        rows = F.array_sort(F.collect_list(F.struct(F.col("stage"), F.col("ord"), F.col(column).alias("v"))))
        return F.array_distinct(F.flatten(F.transform(rows, lambda x: x["v"])))

    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    merged = evidence.groupBy("query_id", "path").agg(
        F.sum("score").alias("score"),
        F.sum("match_count").alias("match_count"),
        F.slice(ordered("positions"), 1, positions).alias("positions"),
        ordered("categories").alias("categories"),
        ordered("reasons").alias("reasons"),
        ordered("verified_by").alias("verified_by"),
        F.max(rank).alias("confidence_rank"),
        *[F.min_by(c, place).alias(c) for c in ("module", "layer", "source_set")],
    )
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    return merged.withColumn("confidence", F.coalesce(F.try_element_at(names, F.col("confidence_rank").cast("int")), F.lit("medium"))).drop("confidence_rank")


def section_summary(items: DataFrame, keys: list[str], top: int = 6) -> DataFrame:
    """matched items, total matches and the `top` items by score of each section (section, category, keys, match_count, score)."""
    totals = items.groupBy("section", "category").agg(F.count("*").alias("matched_items"), F.sum("match_count").alias("total_matches"))
    best = items.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), *keys))).filter(F.col("rank") <= top)
    listed = best.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("rank", *keys))).alias("top"))
    return totals.join(listed, "section")


def type_relations(facts: DataFrame, anchors: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, path, rank) of facts whose parents include the anchor's type (query_id, path, type_name), not that type itself.

    The first `limit` by path of each query.
    """
    from siftwright.functions.text import simple_name

    none = F.array().cast("array<string>")
    parents = F.concat(F.coalesce("implements_types", none), F.when(F.col("extends_type").isNotNull(), F.array("extends_type")).otherwise(none))
    own = F.col("type_name") if "type_name" in facts.columns else F.lit(None).cast("string")
    edges = facts.select("path", own.alias("own"), F.explode(F.array_distinct(F.transform(parents, simple_name))).alias("parent"))
    wanted = anchors.select("query_id", F.col("path").alias("anchor_path"), simple_name(F.col("type_name")).alias("parent"))
    found = edges.join(wanted, "parent").filter("path <> anchor_path AND NOT own <=> parent").select("query_id", "path").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).filter(F.col("rank") <= limit)


def first_seen(matches: DataFrame, keys: list[str], order: list[str], limit: int = 6) -> DataFrame:
    """The first distinct items in scan order: the baseline that reads what a plain search shows first."""
    return matches.groupBy(*keys).agg(F.min(F.struct(*order)).alias("seen")).orderBy("seen", *keys).limit(limit)
