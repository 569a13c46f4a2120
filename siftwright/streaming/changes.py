"""Change feeds: classification, debouncing, invalidation and TTL caches, as streams and as batch twins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftwright.functions import paths
from siftwright.functions.build import MODULE

CREATED, CHANGED, DELETED = 1, 2, 3
GAP = "250 milliseconds"


def change_type(exists, known):
    return F.when(exists & known, CHANGED).when(exists, CREATED).when(known, DELETED)


def classify(events: DataFrame, key: str = "uri", exists: str = "exists", order: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """events with change_type; what never existed and doesn't now is no change. Nothing is known at first."""
    known = F.coalesce(F.lag(exists).over(Window.partitionBy(key).orderBy(*order)), F.lit(False))
    return events.withColumn("change_type", change_type(F.col(exists), known)).filter(F.col("change_type").isNotNull())


class Classifier(StatefulProcessor):
    """The same for a stream: one boolean per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, out = bool(self.known.get()[0]) if self.known.exists() else False, []
        frame = pd.concat(list(rows)).sort_values("event_time")
        for exists, at in zip(frame["exists"], frame["event_time"], strict=True):
            kind = CHANGED if exists and known else CREATED if exists else DELETED if known else None
            if kind:
                out.append((key[0], kind, at))
            known = bool(exists)
        self.known.update((known,))
        yield pd.DataFrame(out, columns=["uri", "change_type", "event_time"])

    def close(self) -> None:
        pass


def classify_stream(events: DataFrame) -> DataFrame:
    """A stream (uri, exists, event_time) classified; needs the RocksDB state store."""
    return events.groupBy("uri").transformWithStateInPandas(Classifier(), "uri string, change_type int, event_time timestamp", "append", "none")


# What is watched besides Java sources, at the root, in its folders, and in those under modules and apps.
CONFIG_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "gradle.properties"]
ROOT_FILES = [*CONFIG_FILES, "settings.gradle", "settings.gradle.kts", "gradle/libs.versions.toml"]


def watched(path):
    """Whether changes of path are followed: Java sources under a source root, and build files."""
    name = "|".join(re.escape(n) for n in CONFIG_FILES)
    root = "|".join(re.escape(n) for n in ROOT_FILES)
    return path.rlike(rf"^{MODULE}src/(main|test)/java/.*\.java$|^{MODULE}({name})$|^({root})$") & ~paths.is_ignored(path)


def listing_events(before: DataFrame, after: DataFrame, at) -> DataFrame:
    """(uri, exists, event_time) of watched files that differ between two listings (path, mtime, size): one scan of a poller."""
    old = before.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_old"))
    both = after.withColumn("_new", F.lit(True)).join(old, "path", "full_outer").filter(watched(F.col("path")))
    same = F.col("_new") & F.col("_old") & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    return both.filter(~F.coalesce(same, F.lit(False))).select(paths.path_to_uri(F.col("path")).alias("uri"), F.coalesce("_new", F.lit(False)).alias("exists"), at.alias("event_time"))


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream (uri, exists, event_time) of the JSON-line files that watchers drop into folder: {path, exists, at}."""
    rows = spark.readStream.schema("path string, exists boolean, at timestamp").json(folder)
    return rows.filter(watched(F.col("path"))).select(paths.path_to_uri(F.col("path")).alias("uri"), "exists", F.col("at").alias("event_time"))


def debounce(changes: DataFrame, group: str, key: str, value: str, time: str = "event_time", gap: str = GAP) -> DataFrame:
    """The last value of each key in every burst of a group: (group, burst_end, key, value).

    A burst ends after a gap without events of the group. Works on streams with a watermark in append mode.
    """
    bursts = changes.groupBy(group, F.session_window(F.col(time), gap).alias("burst")).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("k"), F.col(value).alias("v"))).alias("events"))
    exploded = bursts.select(group, F.col("burst.end").alias("burst_end"), "events", F.explode(F.array_distinct(F.transform("events", lambda e: e["k"]))).alias(key))
    last = F.array_max(F.filter("events", lambda e: e["k"].eqNullSafe(F.col(key))))
    return exploded.select(group, "burst_end", key, last["v"].alias(value))


def debounce_batch(changes: DataFrame, group: str, key: str, value: str, order: list[str], time: str = "event_time", gap: str = GAP) -> DataFrame:
    """The batch twin of debounce, without gathering a burst: runs by lag, then the last value per key."""
    w = Window.partitionBy(group).orderBy(time, *order)
    fresh = (F.col(time) > F.lag(time).over(w) + F.expr(f"interval {gap}")).cast("int")
    runs = changes.withColumn("_fresh", F.coalesce(fresh, F.lit(0))).withColumn("burst", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "burst", key).agg(F.max_by(value, F.struct(time, *order)).alias(value), F.count("*").alias("n"))


def invalidated(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """entries (entry, depends_on: array) to drop: those that depend on a changed key, and those that depend on nothing known."""
    keys = entries.select("entry", F.explode_outer("depends_on").alias("key"))
    return keys.join(changed.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left").filter(F.col("_hit") | F.col("key").isNull()).select("entry").distinct()


def generations(drops: DataFrame, order: list[str]) -> DataFrame:
    """drops (batch order, dropped) with generation, the running number of drops."""
    return drops.withColumn("generation", F.sum("dropped").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def ttl_hits(reads: DataFrame, key: str, time: str, order: str, ttl_seconds: int) -> DataFrame:
    """reads with hit: whether the entry written at the last miss is still fresh.

    Time counts from the write, so it is sequential per key; the reads of a key stream past in order and none is held back.
    """
    schema = reads.schema.simpleString()[len("struct<") : -1] + ",hit:boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, written = None, None
        for frame in frames:
            hits = []
            for k, at in zip(frame[key], frame[time], strict=True):
                if k != own:
                    own, written = k, None
                hit = written is not None and (at - written).total_seconds() < ttl_seconds
                hits.append(hit)
                written = written if hit else at
            yield frame.assign(hit=hits)

    return reads.repartition(key).sortWithinPartitions(key, time, order).mapInPandas(run, schema)


def search_cache_hits(reads: DataFrame, drops: DataFrame, keys: list[str], time: str, order: str, ttl_seconds: int) -> DataFrame:
    """reads with generation, the invalidations (drops: time) up to them, and hit: a cache whose keys hold the generation.

    Invalidations are numbered within each hour, and hours among themselves.
    """
    hour = F.date_trunc("hour", "_t")
    row = F.struct(*reads.columns)
    rows = reads.select(F.col(time).alias("_t"), row.alias("_row"), F.lit(0).alias("_drop"))
    union = rows.unionByName(drops.select(F.col(time).alias("_t"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(1).alias("_drop"))).withColumn("_hour", hour)
    earlier = union.groupBy("_hour").agg(F.sum("_drop").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    within = F.sum("_drop").over(Window.partitionBy("_hour").orderBy("_t", F.desc("_drop")).rowsBetween(Window.unboundedPreceding, 0))
    numbered = union.withColumn("_within", within).filter("_row is not null").join(earlier.select("_hour", "_before"), "_hour")
    named = numbered.select("_row.*", (F.col("_before") + F.col("_within")).alias("generation")).withColumn("_key", F.to_json(F.struct("generation", *keys)))
    return ttl_hits(named, "_key", time, order, ttl_seconds).drop("_key")


def open_intervals(progress: DataFrame, key: str = "token", order: str = "event_time") -> DataFrame:
    """Tokens whose last event isn't an end."""
    return progress.groupBy(key).agg(F.max_by("kind", order).alias("kind"), F.max(order).alias(order)).filter("kind <> 'end'")


def idle_since(progress: DataFrame, by: list[str], key: str = "token", order: str = "event_time") -> DataFrame:
    """by, active and idle_since: how many tokens of each group are open, and when the last one ended if none is."""
    last = progress.groupBy(*by, key).agg(F.max_by("kind", order).alias("kind"), F.max(order).alias("_at"))
    return last.groupBy(*by).agg(F.count_if(F.col("kind") != "end").alias("active"), F.max("_at").alias("_at")).select(*by, "active", F.when(F.col("active") == 0, F.col("_at")).alias("idle_since"))


def latest_diagnostics(published: DataFrame, key: str = "uri", order: str = "event_time") -> DataFrame:
    """The last published diagnostics of each key; an empty list clears."""
    return published.groupBy(key).agg(F.max_by("diagnostics", order).alias("diagnostics")).filter(F.size("diagnostics") > 0)
