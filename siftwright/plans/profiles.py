"""From anchors to search plans: profile votes and pattern sections. Plans are built on the driver from a few anchor rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import action_tail, class_stem, is_noisy, keyword_stems, literal, simple_annotation, snake
from siftwright.operators.evidence import fused, prune_sections

# Profiles in the order that breaks ties, and what votes for them.
PROFILES = ["controller", "parser", "listener", "job", "repository", "mapper", "entity", "port", "dto", "vo", "service"]
ANNOTATION_VOTES = {"RestController": "controller", "Controller": "controller", "Service": "service", "Repository": "repository", "Mapper": "mapper", "Entity": "entity", "Table": "entity"}
PARENT_VOTES = {"repository": r"(JpaRepository|CrudRepository|Repository)\b", "mapper": r"\bMapper\b", "port": r"(Gateway|Client|Port)\b"}
PATH_VOTES = {"controller": r"/interfaces/web/|/controller/", "parser": "/parser/", "listener": "/listener/", "job": "/job/", "repository": "/repository/", "mapper": "/mapper/", "entity": "/entity/", "dto": "/dto/", "vo": "/vo/"}
NAME_VOTES = {
    "controller": "Controller$", "parser": "Parser$", "listener": "(Listener|EventHandler|Consumer)$", "job": "(Job|Scheduler|Scheduled|Task)$", "repository": "Repository$",
    "mapper": "Mapper$", "entity": "(Entity|DO)$", "port": "(Gateway|Port|Client)$", "dto": "(Request|Response|View|DTO|Command|Result)$", "vo": "(VO|Vo)$",
}
WEIGHTS = {"annotation": 100, "parent": 80, "path": 50, "name": 35}


def profile_votes(facts: DataFrame) -> DataFrame:
    """(path, profile, weight) of facts (path, type_name, kind, annotations, implements_types, extends_type)."""
    vote = lambda profile, weight: F.struct(F.lit(profile).alias("profile"), F.lit(weight).alias("weight"))
    noted = F.transform(F.coalesce("annotations", F.array().cast("array<string>")), simple_annotation)
    parents = F.concat_ws(" ", "implements_types", "extends_type")
    low = F.lower("path")
    controller = F.filter(noted, lambda a: a.isin("RestController", "Controller"))
    votes = [F.transform(controller, lambda _: vote("controller", WEIGHTS["annotation"]))]

    def noted_as(name: str, profile: str):
        return F.transform(F.filter(noted, lambda a: a == name), lambda _: vote(profile, WEIGHTS["annotation"]))

    votes += [noted_as(name, profile) for name, profile in ANNOTATION_VOTES.items() if profile != "controller"]
    single = [F.when(parents.rlike(pattern) | ((F.col("kind") == "interface") if profile == "port" else F.lit(False)), vote(profile, WEIGHTS["parent"])) for profile, pattern in PARENT_VOTES.items()]
    single += [F.when(low.rlike(pattern), vote(profile, WEIGHTS["path"])) for profile, pattern in PATH_VOTES.items()]
    named = F.coalesce("type_name", F.lit(""))
    single += [F.when(named.rlike(pattern) | ((F.col("kind") == "record") if profile == "dto" else F.lit(False)), vote(profile, WEIGHTS["name"])) for profile, pattern in NAME_VOTES.items()]
    return facts.select("path", F.explode(F.concat(*votes, F.array_compact(F.array(*single)))).alias("v")).select("path", "v.*")


def best_profile(votes: DataFrame, by: list[str], order: list[str] = PROFILES) -> DataFrame:
    """by and the profile of most votes; earlier profiles win ties, sums of 0 or less don't count."""
    tie = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("profile"))
    sums = votes.groupBy(*by, "profile").agg(F.sum("weight").alias("total")).filter("total > 0")
    return sums.groupBy(*by).agg(F.max_by("profile", F.struct(F.col("total"), -tie)).alias("profile"))


def infer_profiles(facts: DataFrame, role: str | None = None) -> DataFrame:
    """(path, profile); a role that names a profile overrides all votes, without any it is service."""
    if role and role.lower() in PROFILES:
        return facts.select("path", F.lit(role.lower()).alias("profile"))
    return facts.select("path").join(best_profile(profile_votes(facts), ["path"]), "path", "left").withColumn("profile", F.coalesce("profile", F.lit("service")))


# Suffixes that a profile's collaborators carry after the anchor's stem.
FAMILY = {
    "service": "Controller|AppService|Service|Assembler|Command|Request|Response|View|Result",
    "controller": "Controller|AppService|Service|Assembler|Request|Response|Command|Result|Confirm|Summary",
    "repository": "Repository|RepositoryImpl|Mapper|DO|Entity|AppService|Service|Task",
    "parser": "Parser|Controller|AppService|Service|Assembler|Command|Result|DiffBuilder|ExcelParser|ParsedTemplate|Task|Artifact",
    "port": "Gateway|Port|Client|AppService|Service|Command|Result|Config|Mapper",
    "dto": "Response|View|DTO|Assembler|Controller|AppService|Service",
    "vo": "VO|Vo|View|DTO|Assembler|Controller|AppService|Service|Response",
    "entity": "Entity|DO|Mapper|Repository|RepositoryImpl|Service|AppService|Converter|Assembler",
    "mapper": "Mapper|Entity|DO|Repository|RepositoryImpl|Service|AppService|Converter|Assembler",
    "job": "Job|Scheduler|Task|AppService|Service|Repository|Config|Properties",
    "listener": "Listener|Event|Publisher|Handler|Consumer|AppService|Service|Repository|Config",
}
# What a section looks for, as results say it.
REASONS = {
    "repository": "repository port, implementation, mapper, entity, and application callers",
    "sql": "mapper, migration, and SQL evidence",
    "controller": "endpoint contract, assembler, command/result, and application service path",
    "parser": "parser port, implementation, parsed model, and app-service callers",
    "dto": "DTO/view field propagation and mapper usage",
    "upstream": "likely upstream source service or view",
    "vo": "VO/view field propagation, assembler, and service callers",
    "entity": "entity mapping, mapper, repository, and service callers",
    "entity sql": "entity table, mapper XML, migration, and SQL evidence",
    "mapper": "mapper interface, entity, repository, and service callers",
    "mapper sql": "mapper XML, entity table, migration, and SQL evidence",
    "job": "scheduled job, application service, repository, and config path",
    "job config": "job scheduling and runtime configuration evidence",
    "listener": "event listener, publisher, handler, service, and repository path",
    "listener config": "listener/event runtime configuration evidence",
    "port": "port contract, implementations, and direct callers",
    "service": "service, direct callers, and local protocol family",
    "tests": "targeted verification candidates",
    "recall": "runtime configuration evidence",
}
DRAFTS = "ParsedTemplate|StudentDraft|TeacherDraft|GradeDraft|ClassDraft|PreviewItem|BindingDraft|BindingPreviewItem"
FLOW = "Controller|AppService|QueryAppService|Service|Assembler|Response|View|DTO"
FLOW_NOISE = ("Student", "Item", "Detail", "Entry")
KEYWORD_FAMILY = {
    False: "Command|Request|Response|Result|DTO|View|Executor|Engine|Repository|Mapper|Entity|DO|Gateway|Port",
    True: "Controller|AppService|Service|Assembler|Command|Request|Response|Result|DTO|View|Executor|Engine|Repository|Mapper|Entity|DO|Gateway|Port|Client|Config|Properties|Event|Listener|Handler|Consumer",
}
WITH_TAIL = {"repository", "port", "entity", "mapper", "job", "listener"}
CALLS = {"dto", "vo"}
SNAKED = {"entity", "mapper"}
GLOBS = {"java": ["*.java"], "protocol": ["*.java"], "persistence": ["*.sql", "*.xml", "*.java"], "config": ["*.yml", "*.yaml", "*.properties", "*.xml"], "tests": ["*Test.java"]}


@dataclass
class Section:
    category: str
    reason: str
    pattern: str
    roots: str  # main, test, persistence, broad, or module: and a name
    globs: list[str]


def profile_terms(profile: str, base: str, symbol: str) -> list[str]:
    stem = class_stem(base)
    terms = [literal(base), f"{literal(stem)}({FAMILY[profile]})"]
    if profile == "parser" and stem.endswith("Import"):
        terms.append(f"{literal(stem.removesuffix('Import'))}({DRAFTS})")
    if profile == "dto":
        flow = stem
        for noise in FLOW_NOISE:
            flow = flow.replace(noise, "")
        terms.append(f"{literal(flow)}({FLOW})" if flow != stem and len(flow) >= 8 else "")
    if profile in SNAKED:
        terms.append(snake(stem))
    terms.append("" if is_noisy(symbol) else literal(symbol))
    if profile in WITH_TAIL and action_tail(symbol):
        terms.append(literal(action_tail(symbol)))
    if profile in CALLS and symbol:
        terms += [rf"{literal(symbol)}\(", rf"\.{literal(symbol)}\("]
    return terms


def keyword_terms(keywords: list[str]) -> list[str]:
    out = []
    for stem, count in keyword_stems(keywords):
        s = literal(stem)
        out += [f"{s}({KEYWORD_FAMILY[count > 1]})", f"{s}(Request|Response)Assembler", f"Final{s}Result"]
        out += [f"{s}.*Assembler"] if count == 1 else []
    return out


def sql_terms(base: str, symbol: str) -> list[str]:
    return [literal(snake(x)) for x in (base, class_stem(base), symbol, action_tail(symbol)) if x]


def search_plan(profile: str, base: str, symbol: str = "", keywords: list[str] | None = None, mode: str = "balanced") -> list[Section]:
    """Sections to search for an anchor of class base; one pattern each, sections without one left out."""
    extra, stem = keyword_terms(keywords or []), class_stem(base)

    def section(category: str, reason: str, terms: list[str], roots: str) -> Section:
        return Section(category, reason, fused([*terms, *extra]), roots, GLOBS[category])

    raw = [base, stem, symbol]
    out = [section("protocol" if profile == "controller" else "java", REASONS[profile], profile_terms(profile, base, symbol), "broad" if profile == "port" else "main")]
    root = symbol.removesuffix("Code")
    if profile == "dto" and root != symbol and len(root) >= 4:
        terms = [f"{literal(root[0].upper() + root[1:])}(QueryAppService|View)", rf"{literal(symbol)}\(", rf"\.{literal(symbol)}\("]
        out.append(section("java", REASONS["upstream"], terms, f"module:{root[0].lower() + root[1:]}"))
    if profile in {"repository", "entity", "mapper"}:
        out.append(section("persistence", REASONS["sql"] if profile == "repository" else REASONS[f"{profile} sql"], sql_terms(base, symbol), "persistence"))
    if profile in {"job", "listener"}:
        out.append(section("config", REASONS[f"{profile} config"], raw, "broad"))
    tests = [*profile_terms("port", base, symbol), f"{literal(stem)}.*Test"] if profile in {"port", "service"} else profile_terms(profile, base, symbol)
    out.append(section("tests", REASONS["tests"], tests, "test"))
    if mode == "recall":
        out.append(section("config", REASONS["recall"], [base, stem], "broad"))
    return [Section(**s) for s in prune_sections([vars(x) for x in out])]
