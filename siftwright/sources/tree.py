"""Source trees and logs as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import build, paths
from siftwright.schemas import SCENARIO


def read_tree(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(path, size, mtime, content) of the files below root, each whole."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    where = paths.uri_to_path(F.col("_metadata.file_path"))
    return files.select(where.alias("absolute"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content")).withColumn(
        "path", paths.relative(F.col("absolute"), paths_root(root))
    ).filter(F.col("path").isNotNull() & ~paths.is_ignored(F.col("path"))).select("path", "size", "mtime", "content")


def paths_root(root: str) -> str:
    """root without scheme and host, as file paths are compared."""
    return re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root).rstrip("/")


def changed_files(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) the snapshot doesn't hold: what an incremental parse reads."""
    return listing.join(snapshot.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def source_roots(tree: DataFrame) -> DataFrame:
    """(relative_path, module, source_set) of the Java source roots, in order: of the root, its folders, and those under modules and apps."""
    root = F.regexp_extract("path", rf"^({build.MODULE}src/(?:main|test)/java)/", 1)
    rows = tree.select(root.alias("relative_path")).filter("relative_path <> ''").distinct()
    inner = "src/(main|test)/java"
    return rows.select("relative_path", build.module_of(F.col("relative_path"), inner).alias("module"), F.regexp_extract("relative_path", f"{inner}$", 1).alias("source_set")).orderBy("relative_path")


def resource_roots(tree: DataFrame) -> DataFrame:
    return tree.select(F.regexp_extract("path", rf"^({build.MODULE}src/main/resources|docs/sql)/", 1).alias("relative_path")).filter("relative_path <> ''").distinct().orderBy("relative_path")


def parse_matches(output: DataFrame, column: str = "value") -> DataFrame:
    """(path, line, text) of the lines `path:line:text` that a search program prints; other lines are left out."""
    part = lambda k: F.regexp_extract(column, r"^(.+?):(\d+):(.*)$", k)
    return output.filter(F.col(column).rlike(r"^.+?:\d+:")).select(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).alias("text"))


ALIASES = "array<struct<id: string, root: string, lspEnabled: boolean, layoutProfile: string>>"
# The layouts that an alias may name.
LAYOUT_PROFILES = ["ddd-gradle", "maven-reactor", "generic-java"]


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, root, enabled, layout_profile) of a registry {aliases: [{id, root, lspEnabled, layoutProfile}]}; an entry that isn't right raises."""
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", f"aliases {ALIASES}")["aliases"]))
    root, named = F.col("root"), F.col("layoutProfile")
    right = (F.coalesce("id", F.lit("")) != "") & F.coalesce(root.startswith("/"), F.lit(False)) & (named.isNull() | named.isin(LAYOUT_PROFILES))
    alias = F.when(right, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("alias without id, absolute root or known layout: "), F.coalesce("id", "root", F.lit("?")))))
    return rows.select(alias.alias("alias"), F.regexp_replace(root, "(?<=.)/+$", "").alias("root"), F.coalesce("lspEnabled", F.lit(False)).alias("enabled"), named.alias("layout_profile"))


def build_text(tree: DataFrame, names: list[str]) -> DataFrame:
    """The build files of these names as one text, in that order."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    return tree.filter(F.col("path").isin(names)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "content"))), lambda x: x["content"]), "\n").alias("content"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario lines with their numbers; blank lines don't count, a line that isn't JSON raises with its place."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line")).filter(F.trim("line") != "")
    parsed = text.withColumn("row", F.from_json("line", SCENARIO + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.col("file"), F.lit(":"), (F.col("k") + 1).cast("string")))
    checked = parsed.withColumn("id", F.when(F.col("row._bad").isNull(), F.col("row.id")).otherwise(bad))
    return checked.select("id", *[F.col(f"row.{c.split()[0]}") for c in ("name", "projectId", "anchor", "golden", "goldenMeta", "groundTruth")])


def explode_attempts(spark: SparkSession, path: str) -> DataFrame:
    """One row per attempt of benchmark result files {rows: [{attempts: [...]}]}."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("rows").alias("r"))
    return rows.select(F.col("r.id").alias("id"), F.explode("r.attempts").alias("a")).select("id", "a.*")


def to_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts without nulls."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def compact_log(log: DataFrame, target: str, keys: list[str], order: str) -> None:
    """Writes the last record of each key to target, a new folder that the caller swaps in."""
    last = log.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_k = 1").drop("_k")
    last.write.mode("errorifexists").parquet(target)
