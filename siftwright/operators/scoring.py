"""Additive rule scoring with a ledger of every delta.

Rules are data; each compiles to one column, so a policy is a single projection without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import action_tail, class_stem, keyword_stems, matches_any, simple_annotation, simple_name

# What evidence of a category is worth, and the rules.
CATEGORY_BASE = {"persistence": 70, "protocol": 64, "java": 56, "semantic": 80, "tests": 24, "config": 18, "nonJava": 18}
OTHER_BASE = 18
RULES = [
    {"id": "structure.same-file", "same_file": True, "delta": 180, "reason": "same file as anchor"},
    {"id": "structure.same-module", "same_module": True, "delta": 28, "reason": "same module as anchor"},
    {"id": "structure.main-source", "source_set": "main", "delta": 14, "reason": "main source set"},
    {"id": "structure.interface-application-layer", "layer": ["interfaces", "application"], "delta": 12, "reason": "interfaces/application layer"},
    {"id": "profile.controller.interfaces", "profile": "controller", "layer": ["interfaces"], "delta": 35, "reason": "controller interface layer"},
    {"id": "profile.repository.infrastructure", "profile": "repository", "path": r"(/infrastructure/|/db/migration/)", "delta": 35, "reason": "repository infrastructure evidence"},
    {"id": "profile.entity.family", "profile": "entity", "path": r"(/entity/|Entity|DO|Mapper|Repository|db/migration)", "delta": 34, "reason": "entity family evidence"},
    {"id": "profile.mapper.family", "profile": "mapper", "path": r"(/mapper/|Mapper|Entity|DO|Repository|\.xml$|db/migration)", "delta": 36, "reason": "mapper family evidence"},
    {"id": "profile.job.family", "profile": "job", "path": "(Job|Scheduler|Schedule|Task|Config|AppService|Service|Repository)", "delta": 32, "reason": "job family evidence"},
    {"id": "profile.listener.family", "profile": "listener", "path": "(Listener|Event|Publisher|Handler|Consumer|AppService|Service|Repository)", "delta": 32, "reason": "listener family evidence"},
    {"id": "profile.parser.family", "profile": "parser", "path": "Parser|ParsedTemplate|DiffBuilder|Draft|PreviewItem", "delta": 38, "reason": "parser family evidence"},
    {"id": "profile.parser.persistence-penalty", "profile": "parser", "path": "/persistence/|Repository|Mapper|DO|Task(File|Status|Repository|Mapper|DO)?", "delta": -70, "reason": "parser persistence penalty"},
    {"id": "profile.parser.tests", "profile": "parser", "source_set": "test", "path": "ExcelParserTest|DiffBuilderTest", "delta": 90, "reason": "parser targeted tests"},
    {"id": "profile.port.family", "profile": "port", "path": "Gateway|Config|SignedUrl|AppService|Report", "delta": 30, "reason": "port family evidence"},
    {"id": "profile.dto.family", "profile": "dto", "path": "Assembler|Controller|QueryAppService|ProductView|ParentBenefit|ItemView", "delta": 32, "reason": "dto family evidence"},
    {"id": "profile.vo.family", "profile": "vo", "path": "VO|Vo|View|Assembler|Controller|AppService|Service", "delta": 30, "reason": "vo family evidence"},
    {"id": "profile.dto.tests", "profile": "dto", "source_set": "test", "path": "ParentBenefitQueryAppServiceTest|BenefitEntitlementAssemblerTest", "delta": 90, "reason": "dto targeted tests"},
    {"id": "options.focus-module", "focus_module": True, "delta": 18, "reason": "focus module"},
    {"id": "options.task-keyword", "task_keyword": True, "delta": 20, "reason": "task keyword"},
    {"id": "structure.common-penalty", "module": "common", "delta": -20, "reason": "common module penalty"},
]
# Stereotypes and who works with whom, what names a collaborator.
STEREOTYPES = ["Controller", "RestController", "Service", "AppService", "QueryAppService", "Repository", "Mapper", "Component", "Configuration", "Entity", "Table"]
COLLABORATION = {
    "Controller": ["Service", "AppService", "QueryAppService"],
    "RestController": ["Service", "AppService", "QueryAppService"],
    "Service": ["Repository", "Mapper", "Component", "Service", "Configuration"],
    "AppService": ["Repository", "Mapper", "Service"],
    "QueryAppService": ["Repository", "Mapper", "Service"],
    "Repository": ["Mapper", "Entity", "Table"],
    "Mapper": ["Entity", "Table"],
    "Component": ["Service", "Repository", "Component"],
}
DIRECT_SUFFIXES = [
    "Controller", "AppService", "Service", "Assembler", "Command", "Request", "Response", "RequestAssembler", "ResponseAssembler", "Result",
    "DTO", "View", "Executor", "Engine", "Repository", "RepositoryImpl", "Mapper", "Entity", "DO", "Gateway", "Port", "Client", "Config",
    "Properties", "Parser", "ExcelParser", "ParsedTemplate", "DiffBuilder",
]
PROTECTED = ["finalize.structural.type-symmetric", "finalize.structural.kind", "finalize.type-relation", "finalize.direct-collaborator"]
LEDGER = "array<struct<id:string,source:string,delta:bigint,reason:string>>"


@dataclass
class Anchor:
    """What the plan knows of the place that a query starts from."""

    path: str
    profile: str = "service"
    module: str | None = None
    class_name: str | None = None
    symbol: str = ""
    package_name: str | None = None
    kind: str | None = None
    annotations: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    method: str | None = None
    line: int = 1
    column: int = 1


@dataclass
class Options:
    mode: str = "balanced"
    focus_modules: list[str] = field(default_factory=list)
    exclude_modules: list[str] = field(default_factory=list)
    task_keywords: list[str] = field(default_factory=list)
    cross_module: str = "auto"
    test_read_mode: str = "defer"
    read_plan_max: int | None = None
    semantic_policy: str = "auto"
    semantic_ready: bool = False


def entry(id_: str, source: str, delta: Column | int, reason: str) -> Column:
    return F.struct(F.lit(id_).alias("id"), F.lit(source).alias("source"), (delta if isinstance(delta, Column) else F.lit(delta)).cast("bigint").alias("delta"), F.lit(reason).alias("reason"))


def condition(rule: dict, anchor: Anchor, options: Options) -> Column:
    """All conditions of a rule on (path, module, layer, source_set, category); two missing modules are the same one."""
    tests = []
    if "category" in rule:
        tests.append(F.col("category").isin(rule["category"]))
    if "profile" in rule:
        tests.append(F.lit(anchor.profile == rule["profile"]))
    if "source_set" in rule:
        tests.append(F.col("source_set").eqNullSafe(rule["source_set"]))
    if "layer" in rule:
        tests.append(F.coalesce(F.col("layer").isin(rule["layer"]), F.lit(False)))
    if "path" in rule:
        tests.append(F.coalesce(F.col("path").rlike(rule["path"]), F.lit(False)))
    if rule.get("same_file"):
        tests.append(F.col("path").eqNullSafe(anchor.path))
    if rule.get("same_module"):
        tests.append(F.col("module").eqNullSafe(F.lit(anchor.module)))
    if rule.get("focus_module"):
        tests.append(F.coalesce(F.col("module").isin(options.focus_modules), F.lit(False)) if options.focus_modules else F.lit(False))
    if rule.get("task_keyword"):
        tests.append(matches_any(F.col("path"), options.task_keywords))
    if "module" in rule:
        tests.append(F.col("module").eqNullSafe(rule["module"]))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def base_score(anchor: Anchor, options: Options, rules: list[dict] = RULES) -> Column:
    """What evidence of column category is worth by the rules, 1 at least."""
    base = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in CATEGORY_BASE.items()], F.lit(OTHER_BASE)).cast("bigint")
    for rule in rules:
        base = base + F.when(condition(rule, anchor, options), rule["delta"]).otherwise(0)
    return F.greatest(F.lit(1), base)


def package_proximity(a: Column, b: Column) -> Column:
    """30 for one package, 18 for near, 8 for related ones, else 0."""
    x, y = F.split(a, "[.]"), F.split(b, "[.]")
    most = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(1), most), lambda i: F.element_at(x, i) != F.element_at(y, i))
    common = F.when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(most)
    near = (common >= 3) & (F.size(x) - common <= 1) & (F.size(y) - common <= 1)
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0).when(a == b, 30).when(near, 18).when(common >= 4, 8).otherwise(0)


def stereotype(annotations: Column) -> Column:
    """The first annotation that is a stereotype."""
    names = F.transform(annotations, lambda x: simple_annotation(F.trim(F.substring_index(F.trim(x), "(", 1))))
    return F.try_element_at(F.filter(names, lambda x: x.isin(STEREOTYPES)), F.lit(1))


def collaborators(name: str | None) -> list[str]:
    """Stereotypes that work with name, either way."""
    return sorted({*COLLABORATION.get(name, []), *(k for k, v in COLLABORATION.items() if name in v)})


def collaboration_pairs(spark) -> DataFrame:
    """The symmetric pairs of COLLABORATION as a table, for joins."""
    pairs = {(a, b) for a, bs in COLLABORATION.items() for b in bs}
    return spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "a string, b string")


def direct_names(stem: str) -> list[str]:
    return [*(f"{stem}{s}" for s in DIRECT_SUFFIXES), f"Final{stem}Result"]


def direct_collaborator(anchor: Anchor, options: Options, type_name: Column) -> Column:
    """170 for a type named after the anchor or a task keyword, 140 for a keyword's assembler; 50 more for ports in a domain."""
    base = class_stem(anchor.class_name or "")
    action = action_tail(anchor.symbol)
    stems = [base, base.removesuffix("Import"), f"{base}{action}" if action else ""]
    same = F.col("module").isNotNull() & F.col("module").eqNullSafe(F.lit(anchor.module))
    always = {n for s in stems if s for n in direct_names(s)}
    at_home: set[str] = set()
    assembler = F.lit(False)
    for stem, count in keyword_stems(options.task_keywords):
        (always if count > 1 else at_home).update(direct_names(stem))
        if len(stem) >= 5:
            assembler = assembler | (type_name.startswith(stem) & type_name.endswith("Assembler"))
    named = type_name.isin(sorted(always)) | (same & type_name.isin(sorted(at_home)) if at_home else F.lit(False))
    delta = F.when(named, 170).when(same & assembler, 140).otherwise(0)
    if anchor.profile == "port":
        delta = delta + F.when((delta > 0) & F.col("path").contains("/domain/"), 50).otherwise(0)
    usable = F.col("path").endswith(".java") & (type_name != "") & (type_name != F.lit(anchor.class_name or ""))
    return F.when(usable, delta).otherwise(0)


def final_scores(candidates: DataFrame, anchor: Anchor, options: Options) -> DataFrame:
    """candidates (path, module, layer, source_set, score, match_count, ledger and facts) with the final score and ledger.

    Facts are type_name, kind, package_name, annotations and parents (simple names); null without facts. Every delta that isn't 0 is an
    entry of the ledger, whose sum is the score.
    """
    type_name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.java$", "")
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    anchor_name = F.lit(anchor.class_name)
    focus = F.coalesce(F.col("module").isin(options.focus_modules), F.lit(False)) if options.focus_modules else F.lit(False)
    keyword = matches_any(F.col("path"), options.task_keywords)
    other = F.col("path") != anchor.path
    has_facts = other & F.col("path").endswith(".java")
    mine = stereotype_of(anchor.annotations)
    deltas = [
        ("finalize.match-count", "match count", F.least(F.lit(40), F.col("match_count") * 2)),
        ("finalize.focus-module", "focus module", F.when(focus, 35).otherwise(0)),
        ("finalize.task-keyword", "task keyword", F.when(keyword, 30).otherwise(0)),
        ("finalize.direct-collaborator", "direct type-name collaborator", direct_collaborator(anchor, options, type_name)),
        ("finalize.type-relation", "implements or extends anchor type", F.when(has_facts & F.array_contains(parents, anchor_name), 95).otherwise(0)),
        ("finalize.structural.annotation", "stereotype collaboration", F.when(has_facts & F.coalesce(stereotype(F.col("annotations")).isin(collaborators(mine)), F.lit(False)), 50).otherwise(0)),
        ("finalize.structural.package", "package proximity", F.when(has_facts, package_proximity(F.lit(anchor.package_name).cast("string"), F.col("package_name"))).otherwise(0)),
        ("finalize.structural.type-symmetric", "anchor is candidate subtype", F.when(has_facts & F.coalesce(simple_name(F.col("type_name")).isin(anchor.parents), F.lit(False)), 95).otherwise(0)),
        ("finalize.structural.kind", "interface-impl pairing", F.when(has_facts & F.lit(anchor.profile == "port" and anchor.kind == "interface") & (F.col("kind") == "class") & F.array_contains(parents, anchor_name), 20).otherwise(0)),
        ("finalize.defer-test", "defer test candidate", F.when(F.lit(options.test_read_mode == "defer") & F.col("source_set").eqNullSafe("test"), -10).otherwise(0)),
    ]
    if options.cross_module != "all":
        away = F.col("module").isNotNull() & ~F.col("module").eqNullSafe(F.lit(anchor.module)) & ~focus & ~keyword
        deltas.append(("finalize.cross-module", "cross module policy", F.when(away, -80 if options.cross_module == "focused" else -20).otherwise(0)))
    added = F.filter(F.array(*[entry(i, "finalize", F.coalesce(d, F.lit(0)), r) for i, r, d in deltas]), lambda e: e["delta"] != 0)
    total = F.col("score") + F.aggregate(added, F.lit(0).cast("bigint"), lambda s, e: s + e["delta"])
    clamp = F.when(total < 1, F.array(entry("finalize.clamp", "finalize", 1 - total, "minimum score clamp"))).otherwise(F.array().cast(LEDGER))
    return candidates.withColumns({"ledger": F.concat(F.col("ledger"), added, clamp), "score": F.greatest(F.lit(1).cast("bigint"), total)})


def stereotype_of(annotations: list[str]) -> str | None:
    return next((n for a in annotations if (n := a.lstrip("@").split("(")[0].split(".")[-1]) in STEREOTYPES), None)


def ledger_faults(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ledger doesn't sum to the score; none if all is well."""
    return scored.withColumn("ledger_sum", F.aggregate("ledger", F.lit(0).cast("bigint"), lambda s, e: s + e["delta"])).filter("ledger_sum <> score").select(*keys, "score", "ledger_sum")
