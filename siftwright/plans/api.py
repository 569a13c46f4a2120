"""The public lookups beside impact: references, symbols, diagnostics, status, and how much of a result is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import paths
from siftwright.functions.text import clamp, half_up, symbol_kind
from siftwright.operators import references as refs
from siftwright.operators import snapshot

# What a result may lack, with the short forms that are shown.
GAPS = {
    "Run Gradle compile/test before claiming behavior.": "Run compile/test before claims.",
    "Use rg/runtime evidence for Spring wiring, SQL/XML/YAML, logs, Nacos, and DB state.": "Check rg/runtime evidence for wiring and DB/config.",
    "LSP semantic enrichment was skipped by policy; raise semanticPolicy or mode if exact symbol binding is required.": "Semantic skipped; raise semanticPolicy for exact binding.",
    "LSP semantic enrichment hit the configured timeout and fell back to source-index plus rg evidence.": "Semantic timed out; using source-index plus rg.",
    "Source facts are regex-derived and not yet JDT LS documentSymbol confirmed.": "Source facts are regex-derived.",
    "Review persistence/config evidence from rgSummary before changing behavior.": "Review persistence/config evidence.",
    "Tests are returned as lower-priority candidates; use testReadMode=priority when verification planning is the main task.": "Tests are lower-priority; use testReadMode=priority for verification.",
}
SHOWN = {"compact": 2, "standard": 3}


def limit_of(limit: int | None, default: int = 80, most: int = 300) -> int:
    return default if limit is None or limit < 1 else min(int(limit), most)


def describe_location(edges: DataFrame) -> DataFrame:
    """edges (uri, target_uri, line, character, ...) with path and 1-based line and column; a link's target goes before its source."""
    uri = F.coalesce("target_uri", "uri") if "target_uri" in edges.columns else F.col("uri")
    return edges.withColumns({"path": paths.uri_to_path(uri), "line": F.col("line") + 1, "column": F.col("character") + 1}).drop("character")


def references(edges: DataFrame, path: str, line: int, limit: int | None = None, first: int = 3, **wanted: str | None) -> DataFrame:
    """References from a place, grouped by module and layer, then file: (module, layer, path, n, positions, place).

    Filters apply before the limit and the limit before grouping, so counts are of what is shown.
    """
    found = edges.filter((F.col("kind") == "reference") & (F.col("src_file") == path) & (F.col("src_line") == line)).select(F.col("dst_file").alias("path"), F.col("dst_line").alias("line"), F.col("dst_col").alias("column"))
    some = refs.filtered(paths.classified(found), limit_of(limit), ["path", "line", "column"], **wanted)
    named = some.withColumns({"module": F.coalesce("module", F.lit("unknown")), "layer": F.coalesce("layer", F.lit("unknown")), "at": F.struct("line", "column")})
    return refs.grouped(named.select("module", "layer", "path", "at"), ["module", "layer"], "path", ["at"], first)


def symbols(table: DataFrame, query: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Symbols whose name holds query, and whether there are more; what is shown is found once."""
    n = limit_of(limit)
    found = table.filter(F.contains("name", F.lit(query))).withColumn("kind_name", symbol_kind(F.col("kind"))).orderBy("name", "file", "line").limit(n + 1)
    rows = found.collect()  # one more than the limit, 301 at most
    return table.sparkSession.createDataFrame(rows[:n], found.schema), len(rows) > n


def diagnostics(latest: DataFrame, files: list[str]) -> DataFrame:
    """(file, diagnostics) of the files asked for; empty where nothing was published."""
    asked = latest.sparkSession.createDataFrame([(f,) for f in files], "file string")
    kind = latest.schema["diagnostics"].dataType
    return asked.join(latest, "file", "left").select("file", F.coalesce("diagnostics", F.array().cast(kind)).alias("diagnostics"))


def status(facts: DataFrame, listing: DataFrame, runtimes: DataFrame) -> DataFrame:
    """One row: entries and their sources, files to read again, and started runtimes (repo, pid, started)."""
    started = runtimes.agg(F.count_if("started").alias("started"), F.array_sort(F.collect_list(F.when(F.col("started"), F.col("pid")))).alias("pids"))
    changed = snapshot.dirty(listing, facts).agg(F.count("*").alias("dirty"))
    return snapshot.status(facts).withColumn("k", F.lit(1)).join(changed.withColumn("k", F.lit(1)), "k").join(started.withColumn("k", F.lit(1)), "k").drop("k")


def evidence_gaps(skipped: Column, timeout: Column, regex_facts: Column, profiles: Column, test_read_mode: Column) -> Column:
    """What a result lacks, in a fixed order; profiles are those of its anchors."""
    holds = [F.lit(True), F.lit(True), skipped, timeout, regex_facts, F.arrays_overlap(profiles, F.array(F.lit("repository"), F.lit("port"))), test_read_mode == "defer"]
    return F.array_compact(F.array(*[F.when(h, gap) for h, gap in zip(holds, GAPS, strict=True)]))


def short_gaps(gaps: Column, verbosity: str) -> Column:
    """The gaps that a verbosity shows; only diagnostic shows them all, in full."""
    table = F.create_map(*[F.lit(x) for pair in GAPS.items() for x in pair])
    short = F.transform(F.array_distinct(gaps), lambda g: F.coalesce(F.try_element_at(table, g), g))
    return F.slice(short, 1, SHOWN[verbosity]) if verbosity in SHOWN else F.array_distinct(gaps)


def shown(ranked: DataFrame, verbosity: str = "standard") -> DataFrame:
    """The columns of ranked that a verbosity shows; diagnostic adds how sure the evidence is and the ledger."""
    columns = ["file_id", "path", "module", "layer", "source_set", "score", "match_count", "categories", "reasons", F.slice("positions", 1, 3).alias("positions")]
    return ranked.select(*columns, *(["confidence", "verified_by", "ledger"] if verbosity == "diagnostic" else []))


def shown_sections(summary: DataFrame, verbosity: str = "standard") -> DataFrame:
    """Section summaries, whose files only diagnostic shows."""
    return summary if verbosity == "diagnostic" else summary.withColumn("top", F.slice("top", 1, 0))


def hover_text(contents: Column) -> Column:
    """The text of hover contents (JSON: a text, {value}, or a list of either), parts two lines apart."""
    parsed = F.try_parse_json(contents)
    parts = F.try_variant_get(parsed, "$", "array<string>")
    values = F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.value"), p, F.lit("")))
    one = F.coalesce(F.try_variant_get(parsed, "$.value", "string"), F.try_variant_get(parsed, "$", "string"), contents)
    return F.when(parts.isNotNull(), F.array_join(values, "\n\n")).otherwise(one)


def phase_totals(timings: DataFrame, by: list[str]) -> DataFrame:
    """Milliseconds of each phase (by, name, ms)."""
    return timings.groupBy(*by, "name").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))


def with_output_bytes(results: DataFrame, column: str = "json", rounds: int = 3) -> DataFrame:
    """results (json: an object) with output_bytes, the size of the object once that number is in it; a few rounds reach it."""
    size = F.octet_length(column)
    bytes_ = size
    for _ in range(rounds):
        bytes_ = size + F.octet_length(F.lit(',"outputBytes":')) + F.char_length(bytes_.cast("string"))
    return results.withColumn("output_bytes", bytes_)


def pick(settings: Column, dotted: str) -> Column:
    """The value under a dotted path of a JSON text."""
    return F.get_json_object(settings, "$." + dotted)


def resolve_alias(probes: DataFrame, aliases: DataFrame, families: DataFrame) -> DataFrame:
    """(path, alias, how) for probes (path, family): the deepest enabled root (alias, root) above it, else the one alias of its git family.

    families are (alias, family); several aliases of a family are a conflict.
    """
    from siftwright.operators.graph import deepest_root

    inside = deepest_root(probes.select("path"), aliases.select("alias", "root"))
    kin = families.groupBy("family").agg(F.count("*").alias("n"), F.min("alias").alias("kin"))
    joined = probes.join(inside, "path", "left").join(kin, "family", "left")
    how = F.when(F.col("alias").isNotNull(), "root").when(F.col("n") == 1, "family").when(F.col("n") > 1, "conflict").otherwise("none")
    return joined.select("path", F.coalesce("alias", F.when(F.col("n") == 1, F.col("kin"))).alias("alias"), how.alias("how"))


# Words of a request that is about Java semantics.
SEMANTIC_WORDS = r"(?i)(\bjava\b|controller|service|repository|mapper|entity|dto|调用链|影响面|方法|类|实现|修复|排查)"


def looks_semantic(prompt: Column) -> Column:
    """Whether a request is about Java semantics."""
    return F.coalesce(prompt.rlike(SEMANTIC_WORDS), F.lit(False))


def use_semantic(policy: str, mode: str, profiles: list[str]) -> bool:
    """Whether a plan asks the semantic tables: never if fast, always if required or the mode is precise or wide, else for services."""
    return policy != "fast" and (policy == "required" or mode in {"precision", "recall"} or "service" in profiles)


def verify_semantic(policy: str, mode: str, used: bool, ready: bool = False) -> bool:
    """Whether references are asked for too: as use_semantic, but when nothing requires it only of a server that is ready."""
    if policy == "fast":
        return False
    return policy == "required" or mode in {"precision", "recall"} or ((used or policy != "auto") and ready)


def payload_attribution(results: DataFrame, by: list[str], column: str = "json") -> DataFrame:
    """Average bytes, to hundredths, of the parts of result payloads (by, JSON)."""
    size = lambda path, empty: F.octet_length(F.coalesce(F.get_json_object(column, path), F.lit(empty)))
    sections = F.coalesce(F.from_json(F.get_json_object(column, "$.rgSummary.sections"), "array<struct<files: string>>"), F.array().cast("array<struct<files: string>>"))
    listed = F.aggregate(sections, F.lit(0), lambda n, s: n + F.octet_length(F.coalesce(s["files"], F.lit("[]")))) + 2 + F.greatest(F.lit(0), F.size(sections) - 1)
    parts = {
        "total_bytes": F.octet_length(column), "files_bytes": size("$.files", "[]"), "read_plan_bytes": size("$.readPlan", "[]"), "summary_bytes": size("$.rgSummary", "{}"),
        "section_files_bytes": listed, "gaps_bytes": size("$.evidenceGaps", "[]"), "metrics_bytes": size("$.metrics", "{}"),
        "output_bytes": F.coalesce(F.get_json_object(column, "$.metrics.outputBytes").cast("long"), F.lit(0)),
    }
    return results.groupBy(*by).agg(F.count("*").alias("n"), *[(half_up(F.avg(c) * 100) / 100).alias(k) for k, c in parts.items()])


# Up to how many GB of memory a tier goes, and what it runs: repositories, idle milliseconds, heap, imports at a time.
TIERS = [(24, 1, 900_000, "1536m", 1), (48, 3, 2_700_000, "2g", 2), (None, 4, 2_700_000, "3g", 2)]


def resource_defaults(memory_gb: Column) -> Column:
    """(memory_gb, max_active_repos, idle_ttl_ms, heap, import_concurrency) of a machine."""
    names = ("max_active_repos", "idle_ttl_ms", "heap", "import_concurrency")
    out = None
    for most, *values in reversed(TIERS):
        tier = F.struct(half_up(memory_gb).alias("memory_gb"), *[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
        out = tier if out is None else F.when(memory_gb <= most, tier).otherwise(out)
    return out


def positive_integer(value: Column, fallback: int) -> Column:
    """The whole part of a text that is a number above 0, else the fallback."""
    number = value.try_cast("double")
    usable = (number > 0) & (number < float("inf"))
    return F.when(F.coalesce(usable, F.lit(False)), F.floor(number)).otherwise(F.lit(fallback))


def envelope(results: DataFrame, column: str = "json", error: str = "error") -> DataFrame:
    """results with is_error and text: the payload's JSON, or the message of what failed."""
    failed = F.col(error).isNotNull()
    return results.withColumns({"is_error": failed, "text": F.when(failed, F.col(error)).otherwise(F.col(column))})


def limits(column: Column) -> Column:
    return clamp(column, 1, 300, 80)
