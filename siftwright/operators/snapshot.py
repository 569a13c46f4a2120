"""Snapshot logs: last write wins, compaction, staleness, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATES, SPARE = 0.30, 10
DELETED = 3  # as in streaming.changes


def last_writes(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; an aggregate with partial combination, no sort."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def load(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The last record of each path with those of its symbols that its own batch wrote."""
    now = last_writes(files, ["path"], ["seq"])
    own = symbols.groupBy("path", "batch_id").agg(F.array_sort(F.collect_list(F.struct("line", "end_line", "name"))).alias("methods"))
    return now.join(own, ["path", "batch_id"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<struct<line:int,end_line:int,name:string>>")))


def read_logs(files: DataFrame, symbols: DataFrame, file_schema: str, symbol_schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of two JSON-line logs (value); if a line of either isn't JSON, both are empty, as all of the snapshot is discarded."""
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

    def parsed(log: DataFrame, schema: str) -> DataFrame:
        return log.filter(F.col("value") != "").select(F.from_json("value", f"{schema}, _bad string", mode).alias("r"))

    both = [parsed(files, file_schema), parsed(symbols, symbol_schema)]
    broken = both[0].select("r._bad").unionByName(both[1].select("r._bad")).filter("_bad is not null").limit(1).count() > 0
    return tuple((rows.limit(0) if broken else rows).select("r.*").drop("_bad") for rows in both)


def appended(facts: DataFrame, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The records that writing facts (path, ..., methods) adds to the logs of files and of symbols; those of a file share a batch.

    A batch is a file's content at a time, so a task that is run again writes the same records.
    """
    stamp = F.lit(batch) if batch else F.sha1(F.to_json(F.struct(*facts.columns)))
    marked = facts.withColumn("batch_id", stamp)
    return marked.drop("methods"), marked.select("path", "batch_id", F.inline("methods"))


def statistics(log: DataFrame, keys: list[str]) -> DataFrame:
    """records, distinct, duplicate_ratio and whether compaction is due."""
    per = log.groupBy(*keys).agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("distinct_keys"))
    ratio = F.when(F.col("records") > 0, 1 - F.col("distinct_keys") / F.col("records")).otherwise(F.lit(0.0))
    return total.withColumn("duplicate_ratio", ratio).withColumn("compact", (F.col("duplicate_ratio") > DUPLICATES) & (F.col("records") > F.col("distinct_keys") + SPARE))


def dirty(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Paths of listing (path, mtime_ms, size) that the snapshot lacks or has with another time or size."""
    old = snapshot.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"))
    return listing.join(old, "path", "left").filter(~(F.col("_m").eqNullSafe(F.col("mtime_ms")) & F.col("_s").eqNullSafe(F.col("size")))).select("path")


def status(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("entries"), F.count_if(F.col("fact_source") == "regex").alias("regex_facts"), F.count_if(F.col("fact_source") == "documentSymbol").alias("symbol_facts"))


def stale(meta: DataFrame, now: Column, days: int) -> DataFrame:
    """Cache entries of worktrees that are past their time and that no live process holds (live: boolean)."""
    return meta.filter(F.col("is_git_worktree") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days))) & ~F.coalesce("live", F.lit(False)))


def sync_documents(opened: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action, version, text) of what a server must be told of opened documents (path, version, text) that changed.

    changed is (path, change_type), as classified; files (path, text) is what is on disk. A deleted document is closed, another text is the
    next version, and nothing is said of documents that aren't open, are gone without notice, or read the same.
    """
    held = last_writes(opened, ["path"], ["version"]).select("path", F.col("version").alias("_version"), F.col("text").alias("_text"))
    met = held.join(changed.select("path", "change_type"), "path").join(files.select("path", "text"), "path", "left")
    action = F.when(F.col("change_type") == DELETED, "close").when(F.col("text") != F.col("_text"), "change")
    told = met.withColumn("action", action).filter("action is not null")
    closed = F.col("action") == "close"
    return told.select("path", "action", F.when(~closed, F.col("_version") + 1).alias("version"), F.when(~closed, F.col("text")).alias("text"))
