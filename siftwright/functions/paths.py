"""Column expressions on repo-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers by precedence, ignored directory names.
LAYERS = ["interfaces", "application", "domain", "infrastructure", "controller", "service", "repository", "mapper", "entity", "dto", "vo"]
IGNORED = [".git", ".gradle", ".idea", ".settings", "build", "dist", "node_modules", "target"]


def parts(path: Column) -> Column:
    return F.split(path, "/")


def module(path: Column) -> Column:
    """The directory under modules/ or apps/, else all directories before the first src; null at the root."""
    p = parts(path)
    at = F.array_position(p, "src")
    named = p[0].isin("modules", "apps") & (F.try_element_at(p, F.lit(2)) != "")
    return F.when(named, F.try_element_at(p, F.lit(2))).when(at > 1, F.array_join(F.slice(p, F.lit(1), (at - 1).cast("int")), "/"))


def project_path(path: Column) -> Column:
    p = parts(path)
    named = p[0].isin("modules", "apps") & (F.try_element_at(p, F.lit(2)) != "")
    return F.when(named, F.concat(F.lit(":"), p[0], F.lit(":"), F.try_element_at(p, F.lit(2)))).otherwise(module(path))


def source_set(path: Column) -> Column:
    """The segment after the first src."""
    p = parts(path)
    at = F.array_position(p, "src")
    return F.when(at > 0, F.try_element_at(p, (at + 1).cast("int")))


def layer(path: Column) -> Column:
    """The first of LAYERS, in their order, that is a segment."""
    p = parts(path)
    return F.coalesce(*[F.when(F.array_contains(p, x), F.lit(x)) for x in LAYERS])


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(x) for x in IGNORED]))


def is_within(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def relative(path: Column, root: str) -> Column:
    """path below root; null outside."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30))


def repo_hash(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def uri_to_path(uri: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(uri, "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))


def path_to_uri(path: Column) -> Column:
    encoded = F.array_join(F.transform(parts(path), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(F.lit("file://"), encoded)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(parts(path), -1), r"\.[^.]*$", "")


def classified(df, path: str = "path"):
    """df with module, project_path, source_set and layer."""
    c = F.col(path)
    return df.withColumns({"module": module(c), "project_path": project_path(c), "source_set": source_set(c), "layer": layer(c)})
