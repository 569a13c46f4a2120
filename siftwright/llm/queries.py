"""Queries of the training-data operators over the whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwright.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f under its own name."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op6_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.packing import pack_documents

    return pack_documents(spark, documents(spark, sf_dir))


@query
def op1_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.langid import identify

    return identify(spark, documents(spark, sf_dir))


@query
def op2_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.lzprint import fingerprints

    return fingerprints(spark, documents(spark, sf_dir))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.decontam import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document after repeated passages go, as a digest, with the spans that went."""
    from pyspark.sql import functions as F

    from siftwright.llm.linededup import dedup_units

    out = dedup_units(documents(spark, sf_dir))
    return out.select("doc_id", "n_units", "n_removed", "spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op3_benchmark_decontamination"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM benchmark),
     g AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest([array_to_string(words[p : p + 9], ' ') FOR p IN range(1, greatest(1, len(words) - 9) + 1)]) AS gram FROM i WHERE len(words) > 0),
     lengths AS (SELECT DISTINCT n FROM g),
     places AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS p, words FROM w, lengths WHERE len(words) >= n),
     hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS gram FROM places) JOIN g USING (n, gram)),
     per_word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
     per_item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

ORACLE_SQL["op9_line_dedup"] = r"""
WITH cut AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]|[^.!?\n]+')) AS piece, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]|[^.!?\n]+'), 1) AS k FROM documents),
     units AS (
       SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start,
              trim(regexp_replace(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?\n]$', ''), '[\t\x0B\f\r ]+', ' ', 'g')) AS unit FROM cut),
     judged AS (SELECT *, unit <> '' AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, k) > 1 AS again FROM units),
     parted AS (SELECT *, sum(CASE WHEN unit <> '' AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM judged),
     runs AS (SELECT doc_id, part, min(k) AS a, max(k) AS b FROM parted WHERE again GROUP BY doc_id, part HAVING sum(length(unit)) >= 100),
     marked AS (SELECT p.*, r.a IS NOT NULL AS gone, r.a FROM parted p LEFT JOIN runs r ON r.doc_id = p.doc_id AND p.k BETWEEN r.a AND r.b),
     spans AS (SELECT doc_id, string_agg(span, ',' ORDER BY a) AS spans FROM (SELECT doc_id, a, CAST(min(start) AS BIGINT) || ':' || CAST(max(start + length(piece)) AS BIGINT) AS span FROM marked WHERE gone GROUP BY doc_id, a) GROUP BY doc_id),
     totals AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN totals USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


@query
def op4_nested_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.secretscan import find_secrets

    return find_secrets(documents(spark, sf_dir))


@query
def op7_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.pii import find_pii

    return find_pii(documents(spark, sf_dir))


@query
def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.toxicity import score_toxicity

    return score_toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.jaccardjoin import linked_groups

    return linked_groups(spark, documents(spark, sf_dir))


@query
def op8_suffix_array_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.suffixfamily import dedup_substrings

    return dedup_substrings(spark, documents(spark, sf_dir))
