"""Facts of build files: layout, build system, required and resolved JDK, generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import version_key

# Where a requirement can stand, in order of precedence; whether only the same major will do; the patterns tried in turn.
SOURCES = {
    "sdkmanrc": ([".sdkmanrc"], True, [r"java\s*=\s*(\S+)"]),
    "java-version": ([".java-version"], True, [r"(?s)^\s*(.*?)\s*$"]),
    "gradle-toolchain": (["build.gradle.kts", "build.gradle"], False, [r"JavaLanguageVersion\.of\((\d+)\)", r"VERSION_(\d+)", r"(?:sourceCompatibility|targetCompatibility)\s*=\s*['\"]?(\d+(?:\.\d+)?)"]),
    "maven": (["pom.xml"], False, [rf"<{p}>\s*([^<]+)\s*</{p}>" for p in (r"maven\.compiler\.release", r"maven\.compiler\.source", r"java\.version")]),
    "mvn-jvm-config": ([".mvn/jvm.config"], False, [r"(?:--release|-Djava\.version=)(\d+(?:\.\d+)?)"]),
}
BUILD_SOURCES = ["gradle-toolchain", "maven"]


def major(version: Column) -> Column:
    """8 of 1.8, 17 of 17.0.2 and of temurin-17; null without a number."""
    found = F.regexp_extract(version, r"(\d+)(?:\.(\d+))?", 0)
    first, second = F.split_part(found, F.lit("."), F.lit(1)).try_cast("int"), F.split_part(found, F.lit("."), F.lit(2)).try_cast("int")
    return F.when((first == 1) & (second > 0), second).otherwise(F.nullif(first, F.lit(0)))


def requirements(files: DataFrame) -> DataFrame:
    """(repo, place, source, raw, required, strict) of files (repo, path, content): at most one requirement for each source of a repo."""
    rows = []
    for place, (source, (names, strict, patterns)) in enumerate(SOURCES.items()):
        of_name = [F.max(F.when(F.col("path") == n, F.nullif("content", F.lit("")))) for n in names]
        text = F.coalesce(*of_name)
        raw = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(source).alias("source"), raw.alias("raw"), major(raw).alias("required"), F.lit(strict).alias("strict")))
    return files.groupBy("repo").agg(F.array(*rows).alias("r")).select("repo", F.inline("r")).filter("required is not null")


def resolve_jdk(required: DataFrame, installed: DataFrame, repos: DataFrame | None = None, fallback: int | None = None) -> DataFrame:
    """(repo, source, raw, required, status, jdk, runtime) from requirements() and installed (jdk, major).

    A build file's requirement goes first, else the first source. The same major is resolved, even if other sources ask for another one;
    the least newer major will do unless the source is strict: degraded, or ambiguous if sources differ. Else it is missing, or ambiguous.
    repos (repo) that require nothing have the fallback major, degraded, or are missing.
    """
    build = F.col("source").isin(BUILD_SOURCES)
    pick = F.struct("place", "source", "raw", "required", "strict")
    need = required.groupBy("repo").agg(F.coalesce(F.min(F.when(build, pick)), F.min(pick)).alias("p"), F.collect_set("required").alias("all"))
    need = need.select("repo", "p.*", (F.col("p.source").isin(BUILD_SOURCES) & (F.size("all") > 1)).alias("conflict"))
    found = need.join(installed.filter("major is not null").withColumnRenamed("major", "_m"), F.col("_m") >= F.col("required"), "left")
    best = found.groupBy("repo", "source", "raw", "required", "strict", "conflict").agg(F.min(F.struct("_m", "jdk")).alias("best"))
    exact = F.coalesce(F.col("best._m") == F.col("required"), F.lit(False))
    usable = exact | (F.col("best._m").isNotNull() & ~F.col("strict"))
    status = F.when(exact, "resolved").when(F.col("conflict"), "ambiguous").when(usable, "degraded").otherwise("missing")
    runtime = F.when(F.col("required") == 8, "JavaSE-1.8").otherwise(F.concat(F.lit("JavaSE-"), F.col("required").cast("string")))
    out = best.select("repo", "source", "raw", "required", status.alias("status"), F.when(usable, F.col("best.jdk")).alias("jdk"), runtime.alias("runtime"))
    if repos is None:
        return out
    have = F.lit(fallback).cast("int")
    filled = {"source": F.lit("missing" if fallback is None else "fallback"), "raw": have.cast("string"), "required": have, "status": F.lit("missing" if fallback is None else "degraded")}
    joined = repos.select("repo").distinct().join(out, "repo", "left")
    none = F.col("source").isNull()
    named = joined.select("repo", *[F.when(none, filled[c]).otherwise(F.col(c)).alias(c) if c in filled else c for c in out.columns[1:-1]])
    return named.withColumn("runtime", runtime)


# Annotation processors by the text that shows them, and the files that are looked at.
PROCESSORS = {"lombok": "(?i)lombok", "mapstruct": "(?i)mapstruct", "auto-value": "(?i)auto[-.]?value", "dagger": "(?i)dagger"}
PROCESSOR_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle/libs.versions.toml"]
LOMBOK_VERSION = [r"org\.projectlombok:lombok:([A-Za-z0-9_.-]+)", r"(?s)<artifactId>\s*lombok\s*</artifactId>.{0,200}<version>\s*([^<]+)\s*</version>", r"lombokVersion\s*=\s*[\"']([^\"']+)[\"']"]


def generated_code(files: DataFrame, lombok_versions: list[str] = (), override: bool = False) -> DataFrame:
    """(repo, processors, enabled, source, lombok, semantics) of files (repo, path, content).

    lombok is enabled if its jar is there: the version that the build asks for, any if it asks for none, or an override.
    """
    place = F.array_position(F.array(*map(F.lit, PROCESSOR_FILES)), F.col("path"))
    parts = F.array_sort(F.collect_list(F.when(place > 0, F.struct(place.alias("k"), "content"))))
    text = F.array_join(F.transform(parts, lambda p: p["content"]), "\n")
    built = files.groupBy("repo").agg(text.alias("text"))
    named = built.withColumn("processors", F.array_compact(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in PROCESSORS.items()])))
    version = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in LOMBOK_VERSION])
    there = F.lit(True) if override else F.when(version.isNull(), F.lit(bool(lombok_versions))).otherwise(version.isin(list(lombok_versions)) if lombok_versions else F.lit(False))
    wants, some = F.array_contains("processors", "lombok"), F.size("processors") > 0
    lombok = F.when(~wants, "not-detected").when(there, "enabled").otherwise("missing-agent")
    semantics = F.when(~some, "not-detected").when(wants & ~there, "incomplete").otherwise("ok")
    return named.select("repo", "processors", some.alias("enabled"), F.when(some, "auto").otherwise("not-detected").alias("source"), lombok.alias("lombok"), semantics.alias("semantics"))


def latest_version(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version of each key."""
    return artifacts.groupBy(*keys).agg(F.max_by("version", F.struct(version_key(F.col("version")), F.col("version"))).alias("version"))


def maven_modules(pom: Column) -> Column:
    return F.regexp_extract_all(pom, F.lit(r"<module>\s*([^<\s]+)\s*</module>"), 1)


#: Where modules can be: the root itself, its folders, and folders under modules and apps.
MODULE = r"(?:(?:(?:modules|apps)/)?[^/]+/)?"


def module_of(root: Column, inner: str) -> Column:
    """The module of a source root: the folder above it, '.' at the root."""
    above = F.regexp_replace(root, rf"/?{inner}$", "")
    return F.when(above == "", ".").otherwise(F.element_at(F.split(above, "/"), -1))


def layout(files: DataFrame) -> DataFrame:
    """(repo, layout, build_system, broad_roots) of files (repo, path, content); content is read of pom.xml alone."""
    path = F.col("path")
    root = F.nullif(F.regexp_extract(path, rf"^({MODULE}src/(?:main|test)/java)/", 1), F.lit(""))
    module = module_of(root, "src/(main|test)/java")
    has = lambda names: F.bool_or(path.isin(names))
    facts = files.groupBy("repo").agg(
        has(["settings.gradle", "settings.gradle.kts"]).alias("settings"), has(["build.gradle", "build.gradle.kts"]).alias("gradle"), has(["pom.xml"]).alias("maven"),
        F.bool_or(root.isNotNull()).alias("any"), F.coalesce(F.bool_or(root.rlike("^(modules|apps)/")), F.lit(False)).alias("nested"), F.array_sort(F.collect_set(module)).alias("modules"),
        F.coalesce(F.flatten(F.collect_list(F.when(path == "pom.xml", maven_modules(F.col("content"))))), F.array()).alias("declared"),
        F.array_sort(F.collect_set(F.nullif(F.regexp_extract(path, "^(modules|apps)/", 1), F.lit("")))).alias("tops"),
    )
    away = F.filter("modules", lambda m: m != ".")
    kind = (
        F.when(F.col("settings"), F.when(F.col("nested"), "gradle-multi").otherwise("single"))
        .when(F.col("maven"), F.when((F.size("declared") > 0) | (F.size(away) > 0), "maven-multi").otherwise("single"))
        .when(F.col("any"), "single")
        .otherwise("flat-layers")
    )
    system = F.when(F.col("settings") | F.col("gradle"), "gradle").when(F.col("maven"), "maven").otherwise("unknown")
    named = F.array_sort(F.array_union("declared", "modules"))
    broad = F.when(F.size("tops") > 0, F.col("tops")).when(F.size(named) > 0, named).otherwise(F.array(F.lit(".")))
    return facts.select("repo", kind.alias("layout"), system.alias("build_system"), broad.alias("broad_roots"))
