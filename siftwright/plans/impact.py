"""The flagship query: files that a change at some anchors may touch, ranked, with what to read of them."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import build, paths
from siftwright.functions.facts import header_facts, with_methods
from siftwright.functions.text import simple_name, token_at
from siftwright.operators import evidence as ev
from siftwright.operators import ranking, readplan, scoring
from siftwright.plans import api
from siftwright.plans.profiles import infer_profiles, search_plan

#: Anchors of a query, at most.
MOST_ANCHORS = 5
#: Edges of a kind that each anchor contributes.
EDGES = 40
# What an edge adds to the score of its kind; profiles that usually have implementations.
EDGE_GAIN = {"definition": 80, "implementation": 120, "reference": 80, "typeHierarchy": 110}
OPEN_PROFILES = {"port", "repository", "service"}
TYPE_GRAPH_GAIN = 70


@dataclass
class Impact:
    """What an impact query finds."""

    files: DataFrame
    read_plan: DataFrame
    #: One row: deferred_tests, cross_module_consumers, excluded_modules.
    suppressed: DataFrame
    #: Section, category, reason, matched_items, total_matches and the best files of each.
    sections: DataFrame
    anchors: list[scoring.Anchor]
    #: What the result lacks, in full.
    gaps: list[str] = field(default_factory=list)


def no_strings():
    return F.array().cast("array<string>")


def facts_of(files: DataFrame) -> DataFrame:
    """files (path, content) with header facts, methods and path context."""
    return paths.classified(with_methods(header_facts(files.select("path", "content"))))


def resolve_anchors(facts: DataFrame, places: list[tuple[str, int, int]], role: str | None = None) -> list[scoring.Anchor]:
    """The anchors of places (path, line, column), in order; it raises if there are none or too many, or a file isn't there."""
    if not 1 <= len(places) <= MOST_ANCHORS:
        raise ValueError(f"an impact query has 1 to {MOST_ANCHORS} anchors, not {len(places)}")
    own = facts.filter(F.col("path").isin([p for p, *_ in places]))
    rows = {r["path"]: r for r in own.join(infer_profiles(own, role), "path").collect()}  # MOST_ANCHORS at most
    out = []
    for path, line, column in places:
        if path not in rows:
            raise ValueError(f"no such file: {path}")
        row = rows[path]
        method = max((m for m in row["methods"] if m["line"] <= line <= m["end_line"]), key=lambda m: m["line"], default=None)
        symbol = own.filter(F.col("path") == path).select(token_at(F.element_at(F.split("content", "\r?\n"), line), F.lit(column))).first()[0] if method is None else None
        simple = lambda n: n.split("<")[0].split(".")[-1]
        parents = [simple(p) for p in [*(row["implements_types"] or []), row["extends_type"] or ""] if p]
        name = method["name"] if method else None
        out.append(scoring.Anchor(path, row["profile"], row["module"], row["type_name"], name or symbol or "", row["package_name"], row["kind"], row["annotations"] or [], parents, name, line, column))
    return out


def implementable(anchor: scoring.Anchor) -> bool:
    return (anchor.kind == "interface" and anchor.method is None) or anchor.profile in OPEN_PROFILES


def module_roots(modules: list[str], source_set: str, kind: str = "java") -> list[str]:
    return [f"{above}{m}/src/{source_set}/{kind}" for m in modules for above in ("", "modules/", "apps/")]


@dataclass
class Roots:
    """What a tree has to search: of the roots that sections ask for those that are there, and where broad searches look."""

    there: set[str]
    broad: list[str]

    def of(self, section, anchor: scoring.Anchor, options: scoring.Options) -> list[str]:
        if section.roots in ("main", "test"):
            modules = list(dict.fromkeys(m for m in [anchor.module, *options.focus_modules] if m))
            found = [r for r in module_roots(modules, section.roots) if r in self.there] if options.cross_module != "all" else []
            return found or self.broad
        if section.roots == "persistence":
            mine = [anchor.module] if anchor.module else []
            return [*module_roots(mine, "main", "resources"), *module_roots(mine, "main"), "docs/sql"]
        if section.roots.startswith("module:"):
            return [r for r in module_roots([section.roots.removeprefix("module:")], "main") if r in self.there] or self.broad
        return self.broad


def roots_of(files: DataFrame, wanted: list[str]) -> Roots:
    """Roots of files (path, content), looked up once: as many as sections name, and the folders at the top of the tree."""
    root = F.regexp_extract("path", r"^((?:[^/]+/)*src/(?:main|test)/java)/", 1)
    there = {r[0] for r in files.select(root).filter(root.isin(wanted)).distinct().collect()} if wanted else set()
    row = build.layout(files.select(F.lit("").alias("repo"), "path", "content")).first()
    return Roots(there, row["broad_roots"] if row else ["."])


def below(roots: list[str]) -> Column:
    out = F.lit("." in roots)
    for r in roots:
        out = out | F.col("path").startswith(f"{r}/")
    return out


def section_filter(section, roots: list[str]) -> Column:
    """Where a section looks: its globs below its roots."""
    pattern = "|".join(f"(?:{fnmatch.translate(g).removesuffix(chr(92) + 'Z').removesuffix(chr(92) + 'z')})" for g in section.globs)
    return F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})$") & below(roots)


def evidence_rows(found: DataFrame, context: DataFrame, stage: int, score: Column, reason: Column, verified: Column, confidence: str) -> DataFrame:
    """Rows of evidence from found (path, ord, category, match_count, positions)."""
    row = found.join(context, "path") if "module" not in found.columns else found
    scored = row.withColumns({"score": score.cast("bigint"), "reason": reason})
    return scored.select(
        F.lit("q").alias("query_id"), "path", F.lit(stage).alias("stage"), F.col("ord").cast("int").alias("ord"), "score", F.col("match_count").cast("bigint").alias("match_count"), "positions",
        F.array("category").alias("categories"), F.array("reason").alias("reasons"), F.array(verified).alias("verified_by"), F.lit(confidence).alias("confidence"), "module", "layer", "source_set",
    )


def places_of(anchors: list[scoring.Anchor], spark) -> DataFrame:
    return spark.createDataFrame([(k, a.path, a.line, a.column) for k, a in enumerate(anchors)], "ord int, path string, line int, column int")


def at(line: Column, column: Column) -> Column:
    return F.array(F.struct(line.cast("int").alias("line"), column.cast("int").alias("column")))


def own_evidence(facts: DataFrame, context: DataFrame, anchors: list[scoring.Anchor], options: scoring.Options) -> DataFrame:
    """The anchors themselves, and types that implement or extend theirs."""
    spark = facts.sparkSession
    own = places_of(anchors, spark).select("path", "ord", F.lit("target").alias("category"), F.lit(0).alias("match_count"), at(F.col("line"), F.col("column")).alias("positions"))
    out = evidence_rows(own, context, 0, F.lit(1000), F.lit("target"), F.lit("anchor"), "high")
    for k, anchor in enumerate(anchors):
        if implementable(anchor):
            named = spark.createDataFrame([("q", anchor.path, anchor.class_name or anchor.path.rpartition("/")[2].removesuffix(".java"))], "query_id string, path string, type_name string")
            related = ev.type_relations(facts, named).select("path", (F.col("rank") + 100 * k).alias("ord"), F.lit("semantic").alias("category"), F.lit(0).alias("match_count"), at(F.lit(1), F.lit(1)).alias("positions"))
            base = scoring.base_score(anchor, options) + TYPE_GRAPH_GAIN
            out = out.unionByName(evidence_rows(related, context, 1, base, F.lit("typeGraph"), F.lit("typeGraph"), "medium"))
    return out


def pattern_evidence(files: DataFrame, context: DataFrame, anchors: list[scoring.Anchor], options: scoring.Options) -> tuple[DataFrame, DataFrame]:
    """Evidence of the pattern sections of all anchors, which are found in one pass over the lines, and the matches of each section."""
    plans = [(a, s) for a in anchors for s in search_plan(a.profile, a.class_name or a.path.rpartition("/")[2].removesuffix(".java"), a.symbol, options.task_keywords, options.mode)]
    modules = {m for a in anchors for m in [a.module, *options.focus_modules] if m} | {s.roots.removeprefix("module:") for _, s in plans if s.roots.startswith("module:")}
    roots = roots_of(files, [r for x in ("main", "test") for r in module_roots(sorted(modules), x)])
    tests = [F.when(section_filter(s, roots.of(s, a, options)), F.lit(k)) for k, (a, s) in enumerate(plans)]
    opened = files.select("path", "content").join(context, "path").withColumn("open", F.array_compact(F.array(*tests))).filter(F.size("open") > 0)
    lines = ev.scan_lines(opened, ["path", "open"], "content")
    matches = ev.section_matches(lines, [vars(s) for _, s in plans], ["path", "open"]).filter(F.array_contains("open", F.col("section"))).drop("open")
    per = ev.per_item(matches, ["path"]).withColumn("positions", F.transform("lines", lambda n: F.struct(n.cast("int").alias("line"), F.lit(1).alias("column")))).withColumn("ord", F.col("section")).drop("lines")
    per = per.join(context, "path").withColumn("score", scoring.base_score(anchors[0], options))
    why = F.create_map(*[F.lit(x) for k, (_, s) in enumerate(plans) for x in (k, s.reason)])
    sections = ev.section_summary(per, ["path"]).withColumn("reason", why[F.col("section")])
    return evidence_rows(per, context, 2, F.col("score"), F.concat(F.lit("rg:"), "category"), F.lit("rg"), "medium"), sections


def edge_evidence(edges: DataFrame, context: DataFrame, anchors: list[scoring.Anchor], options: scoring.Options) -> DataFrame | None:
    """Evidence of semantic edges from the anchors' places, as far as the policy asks for them."""
    out = None
    used = api.use_semantic(options.semantic_policy, options.mode, [a.profile for a in anchors])
    verify = api.verify_semantic(options.semantic_policy, options.mode, used, options.semantic_ready)
    for k, anchor in enumerate(anchors):
        kinds = [*(["definition"] if used else []), *(["implementation"] if used and implementable(anchor) else []), *(["reference"] if verify else [])]
        if verify and options.semantic_policy == "required" and implementable(anchor):
            kinds.append("subtype")
        if not kinds:
            continue
        own = edges.filter((F.col("src_file") == anchor.path) & (F.col("src_line") == anchor.line) & F.col("kind").isin(kinds)).withColumn("kind", F.when(F.col("kind") == "subtype", "typeHierarchy").otherwise(F.col("kind")))
        place = F.row_number().over(ranking.Window.partitionBy("kind").orderBy("dst_file", "dst_line", "dst_col"))
        some = own.withColumn("n", place).filter((F.col("n") <= EDGES) | F.col("kind").isin("definition", "implementation"))
        order = F.array_position(F.array(*[F.lit(x) for x in EDGE_GAIN]), F.col("kind"))
        found = some.select(F.col("dst_file").alias("path"), (F.col("n") + 10_000 * (order + 10 * k)).alias("ord"), "kind", F.lit("semantic").alias("category"), F.lit(0).alias("match_count"), at(F.col("dst_line"), F.col("dst_col")).alias("positions"))
        gain = F.coalesce(*[F.when(F.col("kind") == x, v) for x, v in EDGE_GAIN.items()])
        verified = F.when(F.col("kind").isin("reference", "typeHierarchy"), F.col("kind")).otherwise(F.concat(F.lit("semantic-"), "kind"))
        rows = evidence_rows(found, context, 3, scoring.base_score(anchor, options) + gain, F.col("kind"), verified, "high")
        out = rows if out is None else out.unionByName(rows)
    return out


def scored_candidates(merged: DataFrame, facts: DataFrame, anchor: scoring.Anchor, options: scoring.Options) -> DataFrame:
    """Merged evidence with final scores, priorities, and whether a candidate is strong or covered by the read plan."""
    parents = F.transform(F.concat("implements_types", F.when(F.col("extends_type").isNotNull(), F.array("extends_type")).otherwise(no_strings())), simple_name)
    known = facts.select("path", "type_name", "kind", "package_name", "annotations", parents.alias("parents"), "methods")
    candidates = merged.join(known, "path", "left").withColumn("ledger", F.array(scoring.entry("evidence", "merge", F.col("score"), "merged evidence")))
    scored = scoring.final_scores(candidates, anchor, options).withColumns({"priority": ranking.priority(options.test_read_mode), "strong": ranking.is_strong(F.col("ledger"))})
    covered = planned(scored, options).select("query_id", "path", F.lit(True).alias("covered"))
    return scored.join(covered, ["query_id", "path"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def planned(scored: DataFrame, options: scoring.Options) -> DataFrame:
    return ranking.priority_top(scored, ["query_id"], ranking.read_plan_max(options.mode, options.read_plan_max))


def read_plan(kept: DataFrame, options: scoring.Options) -> DataFrame:
    """What to read of the ranked files: those that need no semantic edges to be in the plan go first."""
    plan = ranking.protected_top(kept, ["query_id"], ranking.read_plan_max(options.mode, options.read_plan_max), "protected")
    holds = lambda p: F.exists("methods", lambda m: p["line"].between(m["line"], m["end_line"]))
    first = F.col("positions")[0]["line"]
    inside = F.try_element_at(F.filter("positions", holds), F.lit(1))["line"]
    plan = plan.withColumn("at", F.when(F.array_contains("categories", "target"), first).otherwise(F.coalesce(inside, first)))
    method = F.array_max(F.transform(F.filter("methods", lambda m: F.col("at").between(m["line"], m["end_line"])), lambda m: F.struct(m["line"], m["end_line"])))
    start, end = readplan.read_window(F.col("priority"), first, method["line"], method["end_line"])
    return plan.select("place", F.concat(F.lit("P"), "priority").alias("priority"), "file_id", "path", start.alias("start_line"), end.alias("end_line"), ranking.read_reason(F.col("priority")).alias("reason")).orderBy("place")


def impact_of(files: DataFrame, places: list[tuple[str, int, int]], options: scoring.Options | None = None, role: str | None = None, edges: DataFrame | None = None) -> Impact:
    """What changes at places (path, line, column), 1 to 5 of them, may touch in files (path, content).

    Evidence of all anchors is merged; scores are those of the first. Semantic edges count as far as the options' policy goes, and what
    the read plan would be without them stays in it. Facts are made once and kept while the result is in use.
    """
    options = options or scoring.Options()
    facts = facts_of(files).persist(StorageLevel.MEMORY_AND_DISK)
    anchors = resolve_anchors(facts, places, role)
    context = facts.select("path", "module", "layer", "source_set")
    found, sections = pattern_evidence(files, paths.classified(files.select("path")).select("path", "module", "layer", "source_set"), anchors, options)
    evidence = own_evidence(facts, context, anchors, options).unionByName(found)
    more = edge_evidence(edges, context, anchors, options) if edges is not None else None
    merged = ev.merge_evidence(evidence if more is None else evidence.unionByName(more))
    ranked = scored_candidates(ranking.exclude_modules(merged, options.exclude_modules), facts, anchors[0], options)
    if more is None:
        ranked = ranked.withColumn("protected", F.lit(False))
    else:
        before = scored_candidates(ranking.exclude_modules(ev.merge_evidence(evidence), options.exclude_modules), facts, anchors[0], options)
        mine = planned(before, options).select("query_id", "path", F.lit(True).alias("protected"))
        ranked = ranked.join(mine, ["query_id", "path"], "left").withColumn("protected", F.coalesce("protected", F.lit(False))).withColumn("covered", F.col("covered") | F.col("protected"))
    limit = ranking.candidate_limit(options.mode, anchors[0].profile)
    kept = ranking.rank(ranking.truncate_tail(ranked, ["query_id"], limit), ["query_id"]).withColumn("file_id", F.concat(F.lit("F"), "rank"))
    shown = kept.select("file_id", "path", "module", "layer", "source_set", "score", "match_count", "categories", "reasons", "positions", "confidence", "verified_by", "ledger")
    suppressed = ranking.suppression_counts(merged, ranked, options.exclude_modules, ["query_id"]).drop("query_id")
    used = edges is not None and api.use_semantic(options.semantic_policy, options.mode, [a.profile for a in anchors])
    gaps = facts.sparkSession.range(1).select(api.evidence_gaps(F.lit(not used), F.lit(False), F.lit(True), F.array(*[F.lit(a.profile) for a in anchors]), F.lit(options.test_read_mode))).first()[0]
    return Impact(shown, read_plan(kept, options), suppressed, sections, anchors, gaps)


def impact(files: DataFrame, path: str, line: int, column: int, options: scoring.Options | None = None, role: str | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked files, read plan) for one anchor in files (path, content)."""
    found = impact_of(files, [(path, line, column)], options, role, edges)
    return found.files, found.read_plan
