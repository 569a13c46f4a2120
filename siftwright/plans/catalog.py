"""Queries that bind the operators to the driver's tables, with their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import build, facts, paths, text
from siftwright.operators import evaluation, evidence, graph, ranking, readplan, references, scoring, snapshot
from siftwright.plans import api, profiles
from siftwright.session import table
from siftwright.sources import tree
from siftwright.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# What the documents are searched for: fixed sections, as a search plan would give them.
SECTIONS = [
    {"category": "java", "pattern": "(thing|ation)"},
    {"category": "persistence", "pattern": "(License|Licen[cs]ed)"},
    {"category": "config", "pattern": "[0-9]{3,}"},
]
SECTION_SQL = "(VALUES (0, 'java', '(thing|ation)'), (1, 'persistence', '(License|Licen[cs]ed)'), (2, 'config', '[0-9]{3,}')) s(section, category, pattern)"
LINES_SQL = "SELECT doc_id, lang, source, unnest(string_split_regex(text, '\\r?\\n')) AS value, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS line FROM documents"
MATCH_SQL = f"SELECT doc_id, lang, source, line, section, category FROM ({LINES_SQL}), {SECTION_SQL} WHERE regexp_matches(value, pattern)"
#: An item's path, as a source tree would have it.
PATH_SQL = "'modules/' || lang || '/src/' || CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'main' END || '/java/' || CASE doc_id % 4 WHEN 0 THEN 'interfaces' WHEN 1 THEN 'application' WHEN 2 THEN 'domain' ELSE 'infrastructure' END || '/' || source || '/Doc' || doc_id || CASE doc_id % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' ELSE 'Repository' END || '.java'"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan_lines(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.section_matches(lines_of(spark, sf_dir), SECTIONS, ["doc_id", "lang", "source"])


def doc_path(doc_id=None):
    d = F.col("doc_id") if doc_id is None else doc_id
    layer = F.when(d % 4 == 0, "interfaces").when(d % 4 == 1, "application").when(d % 4 == 2, "domain").otherwise("infrastructure")
    kind = F.when(d % 3 == 0, "Controller").when(d % 3 == 1, "Service").otherwise("Repository")
    return F.concat(F.lit("modules/"), "lang", F.lit("/src/"), F.when(d % 5 == 0, "test").otherwise("main"), F.lit("/java/"), layer, F.lit("/"), "source", F.lit("/Doc"), d.cast("string"), kind, F.lit(".java"))


ANCHOR = scoring.Anchor("modules/en/src/main/java/application/src1/Doc1Service.java", "controller", "en", "Doc1Service", "confirm")
OPTIONS = scoring.Options(focus_modules=["fr"], task_keywords=["src3"], cross_module="auto")


@query(f"SELECT doc_id, count(*) AS n_lines, max(length(value)) AS longest FROM ({LINES_SQL}) GROUP BY doc_id")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.char_length("value")).cast("long").alias("longest"))


@query(f"SELECT section, category, doc_id, count(*) AS match_count FROM ({MATCH_SQL}) GROUP BY ALL")
def pattern_section_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches_of(spark, sf_dir).groupBy(F.col("section").cast("long").alias("section"), "category", "doc_id").agg(F.count("*").alias("match_count"))


@query(f"""
SELECT section, doc_id, count(*) AS match_count, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (k <= 4) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY section, doc_id ORDER BY line) AS k FROM ({MATCH_SQL})) GROUP BY section, doc_id
""")
def section_first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evidence.per_item(matches_of(spark, sf_dir), ["doc_id"])
    return per.select(F.col("section").cast("long").alias("section"), "doc_id", "match_count", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the sections for the documents, under their paths."""
    per = evidence.per_item(matches_of(spark, sf_dir), ["doc_id", "lang", "source"])
    found = paths.classified(per.withColumn("path", doc_path()))
    return found.select(
        F.lit("q").alias("query_id"), "path", F.lit(2).alias("stage"), F.col("section").alias("ord"), scoring.base_score(ANCHOR, OPTIONS).cast("bigint").alias("score"), F.col("match_count"),
        F.transform("lines", lambda n: F.struct(n.cast("int").alias("line"), F.lit(1).alias("column"))).alias("positions"), F.array("category").alias("categories"), F.array(F.lit("pattern")).alias("reasons"),
        F.array(F.lit("rg")).alias("verified_by"), F.lit("medium").alias("confidence"), "module", "layer", "source_set",
    )


BASE_SQL = """greatest(1, CASE category WHEN 'persistence' THEN 70 WHEN 'java' THEN 56 ELSE 18 END
  + CASE WHEN path = 'modules/en/src/main/java/application/src1/Doc1Service.java' THEN 180 ELSE 0 END + CASE WHEN module = 'en' THEN 28 ELSE 0 END
  + CASE WHEN source_set = 'main' THEN 14 ELSE 0 END + CASE WHEN layer IN ('interfaces', 'application') THEN 12 ELSE 0 END + CASE WHEN layer = 'interfaces' THEN 35 ELSE 0 END
  + CASE WHEN module = 'fr' THEN 18 ELSE 0 END + CASE WHEN contains(lower(path), 'src3') THEN 20 ELSE 0 END)"""
ITEM_SQL = f"""SELECT section, category, doc_id, {PATH_SQL} AS path, lang AS module, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'main' END AS source_set,
  CASE doc_id % 4 WHEN 0 THEN 'interfaces' WHEN 1 THEN 'application' WHEN 2 THEN 'domain' ELSE 'infrastructure' END AS layer, count(*) AS match_count FROM ({MATCH_SQL}) GROUP BY ALL"""
MERGED_SQL = f"SELECT path, module, layer, source_set, CAST(sum({BASE_SQL}) AS BIGINT) AS score, CAST(sum(match_count) AS BIGINT) AS match_count, string_agg(category, ',' ORDER BY section) AS categories FROM ({ITEM_SQL}) GROUP BY ALL"


@query(MERGED_SQL)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = evidence.merge_evidence(evidence_rows(spark, sf_dir))
    return merged.select("path", "module", "layer", "source_set", "score", "match_count", F.array_join("categories", ",").alias("categories"))


FINAL_SQL = f"""
SELECT path, module, source_set, categories, score + least(40, 2 * match_count) + CASE WHEN module = 'fr' THEN 35 ELSE 0 END + CASE WHEN contains(lower(path), 'src3') THEN 30 ELSE 0 END
       + CASE WHEN source_set = 'test' THEN -10 ELSE 0 END + CASE WHEN regexp_extract(path, '([^/]*)[.]java$', 1) IN ('Doc1Controller', 'Doc1Repository') THEN 170 ELSE 0 END
       + CASE WHEN module NOT IN ('en', 'fr') AND NOT contains(lower(path), 'src3') THEN -20 ELSE 0 END AS total FROM ({MERGED_SQL})"""


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = evidence.merge_evidence(evidence_rows(spark, sf_dir))
    none = {"type_name": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"), "package_name": F.lit(None).cast("string"), "annotations": F.lit(None).cast("array<string>"), "parents": F.lit(None).cast("array<string>")}
    start = merged.withColumns(none).withColumn("ledger", F.array(scoring.entry("evidence", "merge", F.col("score"), "merged evidence")))
    return scoring.final_scores(start, ANCHOR, OPTIONS)


@query(f"SELECT path, CAST(greatest(1, total) AS BIGINT) AS score FROM ({FINAL_SQL})")
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_items(spark, sf_dir).select("path", "score")


@query(f"SELECT path, CAST(greatest(1, total) AS BIGINT) AS score, CAST(greatest(1, total) AS BIGINT) AS ledger_sum FROM ({FINAL_SQL})")
def score_ledger_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = scored_items(spark, sf_dir).select("path", "score", F.explode("ledger").alias("e"))
    return exploded.groupBy("path", "score").agg(F.sum("e.delta").alias("ledger_sum"))


@query(f"""
SELECT section, category, count(*) AS matched_items, CAST(sum(match_count) AS BIGINT) AS total_matches, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 6) AS top
FROM (SELECT section, category, doc_id, count(*) AS match_count, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, doc_id) AS k FROM ({MATCH_SQL}) GROUP BY section, category, doc_id) GROUP BY section, category
""")
def section_summary_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evidence.per_item(matches_of(spark, sf_dir), ["doc_id"]).withColumn("score", F.col("match_count"))
    out = evidence.section_summary(per, ["doc_id"])
    return out.select(F.col("section").cast("long").alias("section"), "category", "matched_items", "total_matches", F.array_join(F.transform("top", lambda x: x["doc_id"].cast("string")), ",").alias("top"))


@query(f"SELECT {PATH_SQL} AS path, lang AS module, ':modules:' || lang AS project_path, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'main' END AS source_set, CASE doc_id % 4 WHEN 0 THEN 'interfaces' WHEN 1 THEN 'application' WHEN 2 THEN 'domain' ELSE 'infrastructure' END AS layer FROM documents")
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.classified(table(spark, sf_dir, "documents").select(doc_path().alias("path"))).select("path", "module", "project_path", "source_set", "layer")


@query("SELECT page_id, substr(sha1(url), 1, 12) AS repo_hash, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host FROM pages")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.repo_hash(url).alias("repo_hash"), F.split(F.regexp_replace(url, "^https?://", ""), "/")[0].alias("host"))


VOTE_SQL = """SELECT p_partkey, 'controller' AS profile, 100 AS weight, 1 AS tie FROM part WHERE p_brand LIKE '%1' UNION ALL SELECT p_partkey, 'repository', 80, 5 FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'parser', 50, 2 FROM part WHERE lower(p_type) LIKE '%e%' UNION ALL SELECT p_partkey, 'port', 35, 8 FROM part WHERE p_retailprice > 1000 UNION ALL SELECT p_partkey, 'repository', 35, 5 FROM part WHERE p_name LIKE 'part%'"""


@query(f"""
SELECT p.p_partkey, coalesce(b.profile, 'service') AS profile FROM part p LEFT JOIN (
  SELECT p_partkey, profile FROM (SELECT p_partkey, profile, row_number() OVER (PARTITION BY p_partkey ORDER BY sum(weight) DESC, min(tie)) AS k FROM ({VOTE_SQL}) GROUP BY p_partkey, profile) WHERE k = 1) b USING (p_partkey)
""")
def profile_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    vote = lambda cond, p, w: F.when(cond, F.struct(F.lit(p).alias("profile"), F.lit(w).alias("weight")))
    votes = F.array_compact(
        F.array(
            vote(F.col("p_brand").endswith("1"), "controller", 100), vote(F.col("p_size") % 2 == 0, "repository", 80), vote(F.contains(F.lower("p_type"), F.lit("e")), "parser", 50),
            vote(F.col("p_retailprice") > 1000, "port", 35), vote(F.col("p_name").startswith("part"), "repository", 35),
        )
    )
    best = profiles.best_profile(part.select("p_partkey", F.explode(votes).alias("v")).select("p_partkey", "v.*"), ["p_partkey"])
    return part.select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", F.coalesce("profile", F.lit("service")).alias("profile"))


@query("""
WITH w AS (SELECT p_partkey, [x FOR x IN string_split_regex(lower(p_name), '[^a-z0-9]+') IF x <> ''] AS words FROM part),
     s AS (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS a FROM w), r AS (SELECT p_partkey, words, a, unnest(range(1, least(4, len(words) - a + 1) + 1)) AS n FROM s)
SELECT p_partkey, a AS start, array_to_string([upper(x[1]) || substr(x, 2) FOR x IN words[a : a + n - 1]], '') AS stem, n AS word_count FROM r
""")
def keyword_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(text.keyword_words(F.lower("p_name")), text.capitalize)
    grams = table(spark, sf_dir, "part").select("p_partkey", words.alias("words")).select("p_partkey", F.size("words").alias("n"), F.posexplode(text.word_ngrams(F.col("words"))).alias("k", "g"))
    numbered = grams.withColumn("start", F.sum((F.col("g.word_count") == 1).cast("long")).over(Window.partitionBy("p_partkey").orderBy("k")))
    return numbered.select("p_partkey", "start", F.col("g.stem").alias("stem"), F.col("g.word_count").cast("long").alias("word_count"))


CAMEL_SQL = "array_to_string([upper(x[1]) || substr(x, 2) FOR x IN string_split(p_name, ' ')], '')"


@query(f"SELECT p_partkey, lower(regexp_replace(regexp_replace({CAMEL_SQL}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def camel_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = F.array_join(F.transform(F.split("p_name", " "), text.capitalize), "")
    return table(spark, sf_dir, "part").select("p_partkey", text.camel_to_snake(camel).alias("snake"))


@query(r"""
SELECT c_custkey, regexp_replace(n, '(Controller|Service|Repository)$', '') AS stem, regexp_replace(a, '^(get|find|list|load|resolve|create|update|delete|save|mark|claim)', '') AS tail, length(a) < 5 OR a IN ('update') AS noisy
FROM (SELECT c_custkey, 'C' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' ELSE 'Repository' END AS n, CASE c_custkey % 3 WHEN 0 THEN 'findOrder' WHEN 1 THEN 'update' ELSE 'get' || c_custkey END AS a FROM customer)
""")
def identifier_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("C"), k, F.when(k % 3 == 0, "Controller").when(k % 3 == 1, "Service").otherwise("Repository"))
    symbol = F.when(k % 3 == 0, "findOrder").when(k % 3 == 1, "update").otherwise(F.concat(F.lit("get"), k))
    return table(spark, sf_dir, "customer").select(k, text.class_stem_column(name).alias("stem"), text.action_tail_column(symbol).alias("tail"), text.is_noisy_column(symbol).alias("noisy"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_type || '.' || replace(p_name, ' ', '.'), '.') AS x FROM part), a AS (SELECT x AS y FROM p WHERE p_partkey = (SELECT min(p_partkey) FROM part)),
     c AS (SELECT p_partkey, x, y, coalesce((SELECT min(i) FROM range(1, least(len(x), len(y)) + 1) r(i) WHERE x[i] <> y[i]) - 1, least(len(x), len(y))) AS n FROM p, a)
SELECT p_partkey, CAST(CASE WHEN x = y THEN 30 WHEN n >= 3 AND len(x) - n <= 1 AND len(y) - n <= 1 THEN 18 WHEN n >= 4 THEN 8 ELSE 0 END AS BIGINT) AS proximity FROM c
""")
def token_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")))
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("package"))
    anchor = part.agg(F.min_by("package", "p_partkey").alias("package")).first()["package"]
    return part.select("p_partkey", scoring.package_proximity(F.lit(anchor).cast("string"), F.col("package")).cast("long").alias("proximity"))


STEREOTYPE_SQL = "['Service', 'Mapper', 'Repository', 'Entity', 'Controller', 'Unknown'][1 + p_partkey % 6]"


def stereotyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates with facts: a stereotype by their key, parents and kinds by their size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(x) for x in ("Service", "Mapper", "Repository", "Entity", "Controller", "Unknown")])
    return table(spark, sf_dir, "part").select(
        F.lit("q").alias("query_id"), F.concat(F.lit("modules/m/src/main/java/P"), k.cast("string"), F.lit(".java")).alias("path"), F.lit("m").alias("module"), F.lit("domain").alias("layer"), F.lit("main").alias("source_set"),
        F.lit(10).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("match_count"), F.concat(F.lit("P"), k.cast("string")).alias("type_name"), F.when(size % 2 == 0, "class").otherwise("interface").alias("kind"),
        F.concat(F.lit("a.b.c"), (size % 3).cast("string")).alias("package_name"), F.array(F.concat(F.lit("org.x."), F.element_at(names, (1 + k % 6).cast("int")))).alias("annotations"),
        F.when(size % 5 == 0, F.array(F.lit("Port1"))).otherwise(F.array().cast("array<string>")).alias("parents"), F.array(scoring.entry("evidence", "merge", F.lit(10), "merged evidence")).alias("ledger"), k,
    )


@query(f"""
SELECT p_partkey, CAST(10 + CASE WHEN p_size % 5 = 0 THEN 95 ELSE 0 END + CASE WHEN {STEREOTYPE_SQL} IN ('Repository', 'Mapper', 'Service', 'Controller') THEN 50 ELSE 0 END
  + CASE WHEN p_size % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN p_partkey IN (7, 8) THEN 95 ELSE 0 END + CASE WHEN p_size % 2 = 0 AND p_size % 5 = 0 THEN 20 ELSE 0 END AS BIGINT) AS score FROM part
""")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type relations either way, stereotypes, packages and kinds."""
    anchor = scoring.Anchor("modules/m/src/main/java/Port1.java", "port", "m", "Port1", package_name="a.b.c0", kind="interface", annotations=["Service"], parents=["P7", "P8"])
    return scoring.final_scores(stereotyped(spark, sf_dir), anchor, scoring.Options()).select("p_partkey", "score")


@query("""
WITH p(a, b) AS (VALUES ('Controller', 'Service'), ('Controller', 'AppService'), ('Controller', 'QueryAppService'), ('RestController', 'Service'), ('RestController', 'AppService'), ('RestController', 'QueryAppService'),
  ('Service', 'Repository'), ('Service', 'Mapper'), ('Service', 'Component'), ('Service', 'Service'), ('Service', 'Configuration'), ('AppService', 'Repository'), ('AppService', 'Mapper'), ('AppService', 'Service'),
  ('QueryAppService', 'Repository'), ('QueryAppService', 'Mapper'), ('QueryAppService', 'Service'), ('Repository', 'Mapper'), ('Repository', 'Entity'), ('Repository', 'Table'), ('Mapper', 'Entity'), ('Mapper', 'Table'),
  ('Component', 'Service'), ('Component', 'Repository'), ('Component', 'Component')), s AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
  t AS (SELECT p_partkey, ['Service', 'Mapper', 'Repository', 'Entity', 'Controller', 'Unknown'][1 + p_partkey % 6] AS name FROM part)
SELECT p_partkey, count(b) AS partners FROM t LEFT JOIN s ON s.a = t.name GROUP BY p_partkey
""")
def pair_collaboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = stereotyped(spark, sf_dir).select("p_partkey", scoring.stereotype(F.col("annotations")).alias("a"))
    return named.join(F.broadcast(scoring.collaboration_pairs(spark)), "a", "left").groupBy("p_partkey").agg(F.count("b").alias("partners"))


@query("""
WITH t AS (SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^a-z]+') IF length(x) >= 9][1] AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents)
SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM t JOIN w USING (term)) WHERE k <= 20
""")
def implementers_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("text"), "[^a-z]+")
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.try_element_at(F.filter(words, lambda x: F.char_length(x) >= 9), F.lit(1)).alias("type_name"))
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.array_distinct(words).alias("implements_types"), F.lit(None).cast("string").alias("extends_type"))
    anchors = terms.filter("type_name is not null").select(F.col("item_id").cast("string").alias("query_id"), F.lit("").alias("path"), "type_name")
    return evidence.type_relations(docs, anchors).select(F.col("query_id").cast("long").alias("item_id"), F.col("path").cast("long").alias("doc_id"))


@query("""
WITH spans AS (SELECT l_orderkey, l_linenumber * 10 - l_quantity % 7 AS start, l_linenumber * 10 + 12 AS stop, l_linenumber AS name FROM lineitem), probes AS (SELECT o_orderkey, o_orderkey % 40 AS point FROM orders)
SELECT o_orderkey, CAST(point AS BIGINT) AS point, CAST(name AS BIGINT) AS name FROM (SELECT o_orderkey, point, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY start DESC NULLS LAST, stop, name DESC) AS k FROM probes LEFT JOIN spans ON o_orderkey = l_orderkey AND point BETWEEN start AND stop) WHERE k = 1
""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    spans = line.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 10 - F.col("l_quantity") % 7).alias("start"), (F.col("l_linenumber") * 10 + 12).cast("double").alias("end"), F.col("l_linenumber").cast("long").alias("name"))
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("point"))
    return readplan.innermost(probes, spans, ["o_orderkey"], "point").select("o_orderkey", "point", "name")


@query("""
WITH probes AS (SELECT user_id, ts + INTERVAL 1 HOUR AS at, event_id AS probe FROM events WHERE event_type = 'click')
SELECT probe, value FROM (SELECT p.probe, e.event_id AS value, row_number() OVER (PARTITION BY p.probe ORDER BY e.ts DESC, e.event_id DESC) AS k FROM probes p LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') e ON e.user_id = p.user_id AND e.ts <= p.at) WHERE k = 1
""")
def asof_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    probes = events.filter("event_type = 'click'").select("user_id", (F.col("ts") + F.expr("interval 1 hour")).alias("at"), F.col("event_id").alias("probe"))
    others = events.filter("event_type <> 'click'").select("user_id", "ts", F.col("event_id").alias("value"))
    return readplan.latest_before(probes, others, ["user_id"], "at", "ts", "value").select("probe", "value")


PRIORITY_SQL = "CASE WHEN source_set = 'test' THEN 2 WHEN contains(categories, 'config') THEN 2 ELSE 1 END"


def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_items(spark, sf_dir).withColumns({"priority": ranking.priority(), "protected": F.col("path").rlike("/src[12]/")})


@query(f"SELECT path, score, priority, k AS place FROM (SELECT path, score, priority, row_number() OVER (ORDER BY priority, score DESC, path) AS k FROM (SELECT path, CAST(greatest(1, total) AS BIGINT) AS score, CAST({PRIORITY_SQL} AS BIGINT) AS priority FROM ({FINAL_SQL}))) WHERE k <= 12")
def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.priority_top(prioritised(spark, sf_dir), ["query_id"], ranking.read_plan_max("recall")).select("path", "score", F.col("priority").cast("long").alias("priority"), F.col("place").cast("long").alias("place"))


@query(f"""
SELECT path, score, row_number() OVER (ORDER BY priority, score DESC, path) AS place FROM (SELECT *, row_number() OVER (ORDER BY NOT regexp_matches(path, '/src[12]/'), priority, score DESC, path) AS turn
FROM (SELECT path, CAST(greatest(1, total) AS BIGINT) AS score, {PRIORITY_SQL} AS priority FROM ({FINAL_SQL}))) WHERE turn <= 8
""")
def protected_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.protected_top(prioritised(spark, sf_dir), ["query_id"], ranking.read_plan_max("precision")).select("path", "score", F.col("place").cast("long").alias("place"))


TAIL_SQL = """
WITH base AS (SELECT c_nationkey AS q, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS path, CAST(floor(abs(c_acctbal)) AS BIGINT) AS score, c_custkey % 7 = 0 AS strong, c_custkey % 11 = 0 AS covered FROM customer),
 r AS (SELECT *, strong OR covered AS kept FROM base),
 t AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, count(*) FILTER (strong) OVER (PARTITION BY q) AS s, count(*) FILTER (covered) OVER (PARTITION BY q) AS c, count(*) FILTER (kept) OVER (PARTITION BY q) AS p,
   row_number() OVER (PARTITION BY q, kept ORDER BY score DESC, path) - 1 AS idx, row_number() OVER (PARTITION BY q, covered ORDER BY score DESC, path) - 1 AS open_idx, lag(score) OVER (PARTITION BY q, kept ORDER BY score DESC, path) AS prev FROM r),
 u AS (SELECT *, n - p AS d, coalesce(min(CASE WHEN NOT kept AND score < 0.5 * prev THEN idx END) OVER (PARTITION BY q), n - p) AS cliff FROM t),
 v AS (SELECT *, least(s // 2, 4, cliff) AS k1 FROM u), w AS (SELECT *, least(d, k1 + greatest(0, greatest(c, 8) - (p + least(k1, d)))) AS k2 FROM v)
SELECT q, path, score FROM w WHERE CASE WHEN n <= 10 THEN true WHEN s < 6 THEN n <= 26 OR covered OR open_idx < 26 - c ELSE kept OR idx < CASE WHEN p + k2 <= 26 THEN k2 ELSE greatest(26 - p, 0) END END
"""


@query(TAIL_SQL)
def cliff_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("q"), F.lpad(k.cast("string"), 9, "0").alias("path"), F.floor(F.abs("c_acctbal")).alias("score"), (k % 7 == 0).alias("strong"), (k % 11 == 0).alias("covered")
    )
    return ranking.truncate_tail(rows, ["q"], ranking.candidate_limit("balanced")).select("q", "path", "score")


@query(f"""
WITH f AS (SELECT doc_id, min(line) AS line FROM ({MATCH_SQL}) WHERE section = 0 GROUP BY doc_id), m AS (SELECT doc_id, line, CAST(doc_id % 3 AS BIGINT) AS p, greatest(1, line - doc_id % 5) AS a, line + doc_id % 30 AS b FROM f),
     x AS (SELECT *, greatest(1, line - CASE p WHEN 0 THEN 24 WHEN 1 THEN 16 ELSE 10 END) AS lo, line + CASE p WHEN 0 THEN 44 WHEN 1 THEN 32 ELSE 22 END AS hi, greatest(1, a - CASE p WHEN 0 THEN 12 ELSE 8 END) AS mlo, b + 8 AS mhi FROM m)
SELECT doc_id, CASE WHEN p <> 2 AND mlo >= lo AND mhi <= hi THEN mlo ELSE lo END AS start_line, CASE WHEN p <> 2 AND mlo >= lo AND mhi <= hi THEN mhi ELSE hi END AS end_line FROM x
""")
def read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = matches_of(spark, sf_dir).filter("section = 0").groupBy("doc_id").agg(F.min("line").cast("long").alias("line"))
    d, line = F.col("doc_id"), F.col("line")
    a, b = readplan.read_window(d % 3, line, F.greatest(F.lit(1), line - d % 5), line + d % 30)
    return first.select("doc_id", a.cast("long").alias("start_line"), b.cast("long").alias("end_line"))


@query(f"SELECT doc_id, string_agg(lpad(CAST(l.line AS VARCHAR), 5, ' ') || ': ' || l.value, chr(10) ORDER BY l.line) AS preview FROM ({LINES_SQL}) l WHERE abs(l.line - 3) <= 2 GROUP BY doc_id")
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around the third of every document."""
    probes = table(spark, sf_dir, "documents").select("doc_id", F.lit(3).alias("line"))
    return readplan.preview(table(spark, sf_dir, "documents"), probes, ["doc_id"]).select("doc_id", "preview")


LINK = r"""href=["']([^"']+)["']"""


@query(f"SELECT page_id, url AS src, unnest(regexp_extract_all(html, '{LINK.replace(chr(39), chr(39) * 2)}', 1)) AS dst FROM pages")
def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))


EDGE_SQL = "SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT DISTINCT 'r' || n_regionkey, 'n' || (n_nationkey + 1) % 25 FROM nation UNION SELECT DISTINCT 'c' || c_custkey % 50, 'n' || c_nationkey FROM customer"


@query(f"""
WITH RECURSIVE e AS ({EDGE_SQL}), s AS (SELECT DISTINCT 'c' || c_custkey % 50 AS node FROM customer),
  w AS (SELECT s.node AS query_id, 1 AS depth, e.src, e.dst FROM s JOIN e ON e.src = s.node UNION SELECT w.query_id, w.depth + 1, e.src, e.dst FROM w JOIN e ON e.src = w.dst WHERE w.depth < 3)
SELECT query_id, CAST(depth AS BIGINT) AS depth, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, src, dst) AS k FROM (SELECT DISTINCT * FROM w)) WHERE k <= 40
""")
def bounded_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    node = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    region, owner = node("r", F.col("n_regionkey")), node("c", F.col("c_custkey") % 50)
    edges = nation.select(node("n", F.col("n_nationkey")).alias("src"), region.alias("dst")).union(nation.select(region, node("n", (F.col("n_nationkey") + 1) % 25))).union(customer.select(owner, node("n", F.col("c_nationkey"))))
    starts = customer.select(owner.alias("query_id"), owner.alias("node")).distinct()
    return graph.bounded_walk(edges, starts, 3, 40).select("query_id", F.col("depth").cast("long").alias("depth"), "src", "dst")


@query("SELECT p_partkey, arg_max(root, length(root)) AS root FROM (SELECT p_partkey, unnest(['part', 'part/' || p_brand, 'part/' || p_brand || '/' || p_size]) AS root FROM part) WHERE root IN (SELECT 'part' UNION SELECT DISTINCT 'part/' || p_brand FROM part WHERE p_brand LIKE '%1') GROUP BY p_partkey")
def deepest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = F.concat(F.lit("part/"), "p_brand")
    probes = part.select(F.concat(brand, F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    roots = part.filter(F.col("p_brand").endswith("1")).select(brand.alias("root")).distinct().union(spark.createDataFrame([("part",)], "root string")).withColumn("alias", F.col("root"))
    return graph.deepest_root(probes, roots).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("p_partkey"), F.col("alias").alias("root"))


@query("""
WITH k AS (SELECT event_type, user_id, ts, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
  p AS (SELECT event_type, user_id, count(*) AS n, min(ts) AS seen, arg_min(event_id, ts) AS first_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (n <= 3) AS positions FROM k GROUP BY ALL)
SELECT event_type, user_id, n, positions FROM p
""")
def references_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    per = references.grouped(items.select("event_type", "user_id", F.struct("ts", "event_id").alias("at")), ["event_type"], "user_id", ["at"])
    return per.select("event_type", "user_id", "n", F.array_join(F.transform("positions", lambda x: x["event_id"].cast("string")), ",").alias("positions"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 80")
def references_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.filtered(table(spark, sf_dir, "events"), 80, ["ts", "event_id"], event_type="purchase").select("event_id", "user_id")


CAND_SQL = f"SELECT lang AS q, doc_id, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, doc_id) AS rank FROM ({MATCH_SQL}) WHERE section = 0 GROUP BY lang, doc_id"
GOLD_SQL = "SELECT lang AS q, doc_id, toxic = 1 AS must FROM documents JOIN labels USING (doc_id) WHERE quality = 1"


def ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches_of(spark, sf_dir).filter("section = 0").groupBy(F.col("lang").alias("q"), "doc_id").agg(F.count("*").alias("score"))
    ranked = ranking.rank(found, ["q"], "doc_id")
    return ranked.withColumn("planned", F.col("rank") <= 12).withColumn("verified_by", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("rg"), F.lit("typeGraph"))).otherwise(F.array(F.lit("rg"))))


def golden_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("quality = 1")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("lang").alias("q"), "doc_id", (F.col("toxic") == 1).alias("must"))


@query(f"""
WITH c AS ({CAND_SQL}), g AS ({GOLD_SQL}), j AS (SELECT coalesce(c.q, g.q) AS q, c.rank, coalesce(c.rank <= 12, false) AS planned, g.doc_id IS NOT NULL AS gold, coalesce(g.must, false) AS must FROM c FULL JOIN g ON c.q = g.q AND c.doc_id = g.doc_id),
 n AS (SELECT q, count(rank) AS returned, count(*) FILTER (gold) AS wanted, count(*) FILTER (gold AND rank IS NOT NULL) AS hits, count(*) FILTER (rank <= 5) AS t5, count(*) FILTER (rank <= 5 AND gold) AS h5, count(*) FILTER (rank <= 10) AS t10,
   count(*) FILTER (rank <= 10 AND gold) AS h10, count(*) FILTER (planned) AS pl, count(*) FILTER (planned AND gold) AS ph, count(*) FILTER (must) AS m, count(*) FILTER (must AND planned) AS mp FROM j GROUP BY q)
SELECT q, returned, hits, CASE WHEN returned > 0 THEN hits / returned ELSE 0.0 END AS precision, CASE WHEN wanted > 0 THEN hits / wanted ELSE 1.0 END AS recall, CASE WHEN t5 > 0 THEN h5 / t5 ELSE 0.0 END AS p_at_5,
  CASE WHEN t10 > 0 THEN h10 / t10 ELSE 0.0 END AS p_at_10, CASE WHEN pl > 0 THEN ph / pl ELSE 1.0 END AS p_read, CASE WHEN m > 0 THEN mp / m ELSE 1.0 END AS r_read_must FROM n
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(ranked_docs(spark, sf_dir).select("q", "doc_id", "rank", "planned"), golden_docs(spark, sf_dir), ["q"], "doc_id")


@query(f"""
WITH c AS ({CAND_SQL}) SELECT g.q, g.doc_id, g.must, c.rank IS NOT NULL AS in_files, coalesce(c.rank <= 12, false) AS in_plan, CASE WHEN c.rank IS NULL THEN 'unknown' WHEN c.doc_id % 2 = 0 THEN 'typeGraph' ELSE 'rg' END AS source,
  CASE WHEN c.rank <= 12 THEN 'hit' WHEN c.rank IS NOT NULL THEN 'readplan-full' ELSE 'absent' END AS blocked_by FROM ({GOLD_SQL}) g LEFT JOIN c ON c.q = g.q AND c.doc_id = g.doc_id
""")
def golden_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attribution(golden_docs(spark, sf_dir), ranked_docs(spark, sf_dir), ["q"], "doc_id")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT event_type, count(value) AS samples, min(value) AS least, max(value) AS most, list_sort(list(value) FILTER (value IS NOT NULL))[1 + count(value) // 2] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT lang, sum(coalesce(quality, 0)) / count(*) AS quality, sum(coalesce(toxic, 0)) / count(*) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def mean_missing_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(*[evaluation.mean_missing_as_zero(c).alias(c) for c in ("quality", "toxic")])


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, n, before, n - before AS delta, CASE WHEN before > 0 THEN floor((n - before) * 10000 / before + 0.5) / 100 ELSE 0.0 END AS delta_pct FROM l WHERE before IS NOT NULL
""")
def adjacent_delta_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return evaluation.adjacent_change(days, [], "day", "n")


@query("SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS payload, CAST(floor(sum(strlen(text)) / 4 + 0.5) AS BIGINT) AS tokens, floor(sum(strlen(text)) FILTER (doc_id % 2 = 0) / sum(strlen(text)) * 10000 + 0.5) / 10000 AS even_share FROM documents GROUP BY lang, source")
def payload_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    sums = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum(size).alias("payload"), F.sum(F.when(F.col("doc_id") % 2 == 0, size)).alias("even"))
    return sums.select("lang", "source", "payload", evaluation.payload_tokens(F.col("payload")).alias("tokens"), evaluation.share_of(F.col("even"), F.col("payload")).alias("even_share"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def lww_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return snapshot.last_writes(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id)
SELECT user_id, event_type AS batch_id, count(e.event_id) AS n_children FROM b LEFT JOIN events e USING (user_id, event_type) GROUP BY ALL
""")
def snapshot_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    files = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("batch_id"), F.struct("ts", "event_id").alias("seq"))
    symbols = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("batch_id"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.col("event_id").cast("string").alias("name"))
    return snapshot.load(files, symbols).select(F.col("path").cast("long").alias("user_id"), "batch_id", F.size("methods").cast("long").alias("n_children"))


@query("SELECT count(*) AS records, count(DISTINCT user_id) AS distinct_keys, 1 - count(DISTINCT user_id) / count(*) AS duplicate_ratio, 1 - count(DISTINCT user_id) / count(*) > 0.3 AND count(*) > count(DISTINCT user_id) + 10 AS compact FROM events")
def compaction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.statistics(table(spark, sf_dir, "events"), ["user_id"])


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS size FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE size IS NULL OR size <> 25 * (o_orderkey % 5)")
def dirty_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit(0.0).alias("mtime_ms"), (25 * (F.col("o_orderkey") % 5)).cast("double").alias("size"))
    now = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.sum("l_quantity").alias("size")).withColumn("mtime_ms", F.lit(0.0))
    return snapshot.dirty(listing, now).select(F.col("path").alias("o_orderkey"))


CHANGE_SQL = """SELECT user_id, event_id, CASE WHEN e AND k THEN 2 WHEN e THEN 1 ELSE 3 END AS change_type FROM (SELECT user_id, event_id, event_type <> 'error' AS e, coalesce(lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS k FROM events) WHERE e OR k"""


@query(CHANGE_SQL.replace("CASE WHEN e AND", "CAST(CASE WHEN e AND").replace("ELSE 3 END AS", "ELSE 3 END AS BIGINT) AS"))
def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("exists"))
    return changes.classify(log, "user_id", "exists", ("ts", "event_id")).select("user_id", "event_id", F.col("change_type").cast("long").alias("change_type"))


@query("""
WITH f AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM f)
SELECT user_id, CAST(burst AS BIGINT) AS burst, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY user_id, burst, event_type
""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    out = changes.debounce_batch(log.withColumn("id", F.col("event_id")), "user_id", "event_type", "id", ["event_id"], "ts", "6 hours")
    return out.select("user_id", "burst", "event_type", F.col("id").alias("event_id"), "n")


@query("""
WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS dep FROM orders)
SELECT o_orderkey FROM d WHERE dep IS NULL OR dep IN (SELECT user_id FROM c)
""")
def dependency_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array("o_custkey"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), deps.alias("depends_on"))
    changed = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("key"))
    return changes.invalidated(entries, changed).select(F.col("entry").alias("o_orderkey"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, ts AS written, false AS hit FROM o WHERE k = 1 UNION ALL
        SELECT o.user_id, o.event_id, o.k, CASE WHEN o.ts < s.written + INTERVAL 12 HOUR THEN s.written ELSE o.ts END, o.ts < s.written + INTERVAL 12 HOUR FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, event_id, hit FROM s
""")
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return changes.ttl_hits(reads, "user_id", "ts", "event_id", 12 * 3600).select("user_id", "event_id", "hit")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY AND NOT o_orderpriority LIKE '1%'")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("t")).first()["t"]
    meta = orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_git_worktree"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").startswith("1").alias("live"))
    return snapshot.stale(meta, F.lit(now).cast("timestamp_ntz"), 400).select("o_orderkey")


@query(f"SELECT doc_id FROM (SELECT doc_id, min(line) AS line FROM ({MATCH_SQL}) WHERE section = 1 GROUP BY doc_id) ORDER BY doc_id, line LIMIT 6")
def baseline_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six in scan order: the limit is the baseline's own."""
    return evidence.first_seen(matches_of(spark, sf_dir).filter("section = 1"), ["doc_id"], ["doc_id", "line"]).select("doc_id")


@query("SELECT s_nationkey, arg_max(v, [CAST(x AS INTEGER) FOR x IN string_split(v, '.')]) AS version FROM (SELECT s_nationkey, '1.' || s_suppkey % 40 || '.' || s_suppkey % 7 AS v FROM supplier) GROUP BY s_nationkey")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    versions = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("1."), (k % 40).cast("string"), F.lit("."), (k % 7).cast("string")).alias("version"))
    return build.latest_version(versions, ["s_nationkey"])


BUILD_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS repo, s_suppkey % 3 AS kind, 8 + s_suppkey % 5 * 3 AS major, CASE WHEN s_suppkey % 4 = 0 THEN 11 WHEN s_suppkey % 4 = 1 THEN 17 END AS pinned, s_suppkey AS k FROM supplier"""


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build file for each supplier, and for half of them a pinned version; sources in one of four shapes."""
    k = F.col("s_suppkey")
    version = F.when(8 + k % 5 * 3 == 8, "1.8").otherwise((8 + k % 5 * 3).cast("string"))
    content = (
        F.when(k % 3 == 0, F.concat(F.lit("<project><maven.compiler.release> "), version, F.lit(" </maven.compiler.release><artifactId>lombok</artifactId></project>")))
        .when(k % 3 == 1, F.concat(F.lit("java { JavaLanguageVersion.of("), (8 + k % 5 * 3).cast("string"), F.lit(") } dagger auto.value")))
        .otherwise(F.concat(F.lit("targetCompatibility = '"), version, F.lit("'")))
    )
    suppliers = table(spark, sf_dir, "supplier").select(k.cast("string").alias("repo"), "s_suppkey")
    built = suppliers.select("repo", F.when(k % 3 == 0, "pom.xml").when(k % 3 == 1, "build.gradle.kts").otherwise("build.gradle").alias("path"), content.alias("content"))
    pinned = suppliers.filter(k % 4 < 2).select("repo", F.lit(".sdkmanrc").alias("path"), F.when(k % 4 == 0, "java=11.0.2-tem").otherwise("java = 17.0.9").alias("content"))
    inner = F.when(k % 7 < 2, "modules/x/src/main/java/A.java").when(k % 7 < 4, "x/src/test/java/A.java").when(k % 7 < 6, "src/main/java/A.java").otherwise("lib/A.java")
    sources = suppliers.select("repo", inner.alias("path"), F.lit("").alias("content"))
    settings = suppliers.filter(k % 2 == 0).select("repo", F.lit("settings.gradle").alias("path"), F.lit("include").alias("content"))
    return built.unionByName(pinned).unionByName(sources).unionByName(settings)


@query(f"""
SELECT repo, CASE WHEN kind = 0 THEN 'maven' ELSE 'gradle-toolchain' END AS source, CAST(major AS BIGINT) AS required,
  CASE WHEN major IN (11, 17) THEN 'resolved' WHEN pinned IS NOT NULL THEN 'ambiguous' WHEN major < 17 THEN 'degraded' ELSE 'missing' END AS status,
  CASE WHEN major <= 11 THEN 'a11' WHEN major <= 17 THEN 'b17' END AS jdk, CASE WHEN major = 8 THEN 'JavaSE-1.8' ELSE 'JavaSE-' || major END AS runtime FROM ({BUILD_SQL})
""")
def jdk_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    installed = spark.createDataFrame([("a11", 11), ("b17", 17)], "jdk string, major int")
    files = build_files(spark, sf_dir)
    return build.resolve_jdk(build.requirements(files), installed, files.select("repo")).select("repo", "source", F.col("required").cast("long").alias("required"), "status", "jdk", "runtime")


@query(f"""
SELECT repo, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 < 2 THEN 'gradle-multi' ELSE 'single' END WHEN kind = 0 THEN CASE WHEN k % 7 < 4 THEN 'maven-multi' ELSE 'single' END WHEN k % 7 < 6 THEN 'single' ELSE 'flat-layers' END AS layout,
  CASE WHEN k % 2 = 0 OR kind <> 0 THEN 'gradle' ELSE 'maven' END AS build_system, CASE WHEN k % 7 < 2 THEN 'modules' WHEN k % 7 < 4 THEN 'x' ELSE '.' END AS broad_roots FROM ({BUILD_SQL})
""")
def layout_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.layout(build_files(spark, sf_dir)).withColumn("broad_roots", F.array_join("broad_roots", ","))


@query(f"""
SELECT repo, CASE kind WHEN 0 THEN 'lombok' WHEN 1 THEN 'auto-value,dagger' ELSE '' END AS processors, kind < 2 AS enabled, CASE WHEN kind = 0 THEN 'missing-agent' ELSE 'not-detected' END AS lombok,
  CASE kind WHEN 0 THEN 'incomplete' WHEN 1 THEN 'ok' ELSE 'not-detected' END AS semantics FROM ({BUILD_SQL})
""")
def generated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build.generated_code(build_files(spark, sf_dir))
    return found.select("repo", F.array_join("processors", ",").alias("processors"), "enabled", "lombok", "semantics")


@query("SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, regexp_extract(text, '^[A-Za-z_][A-Za-z0-9_]*', 0) AS token FROM conversations WHERE regexp_matches(text, '^[A-Za-z_]')")
def token_at_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").withColumn("token", text.token_at(F.element_at(F.split("text", "\n"), 1), F.lit(1)))
    return found.filter(F.col("text").rlike("^[A-Za-z_]")).select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"), "token")


@query("SELECT conv_id, arg_max(role, turn) AS kind, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'end'")
def open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("kind"), "turn")
    return changes.open_intervals(rows, "conv_id", "turn").select("conv_id", "kind", "turn")


@query(f"SELECT 'F' || row_number() OVER (ORDER BY score DESC, path) AS file_id, path, score, CAST(row_number() OVER (ORDER BY score DESC, path) AS BIGINT) AS rank FROM (SELECT path, CAST(greatest(1, total) AS BIGINT) AS score FROM ({FINAL_SQL}))")
def rank_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank(scored_items(spark, sf_dir), ["query_id"])
    return ranked.select(F.concat(F.lit("F"), F.col("rank").cast("string")).alias("file_id"), "path", "score", F.col("rank").cast("long").alias("rank"))


FLAGSHIP_SQL = f"""
WITH places AS (SELECT {PATH_SQL} AS path, arg_min(line, section * 1000000000 + line) AS line FROM ({MATCH_SQL}) GROUP BY ALL),
 f AS (SELECT t.*, CAST(greatest(1, total) AS BIGINT) AS score, {PRIORITY_SQL} AS priority, regexp_extract(path, '([^/]*)[.]java$', 1) IN ('Doc1Controller', 'Doc1Repository') AS strong FROM ({FINAL_SQL}) t),
 c AS (SELECT *, row_number() OVER (ORDER BY priority, score DESC, path) <= 6 AS covered FROM f),
 k AS (SELECT *, count(*) OVER () AS n, count(*) FILTER (strong) OVER () AS s, row_number() OVER (PARTITION BY covered ORDER BY score DESC, path) AS turn FROM c),
 r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM k WHERE n <= 10 OR n <= 16 OR covered OR turn <= 10)
SELECT 'F' || rank AS file_id, r.path, score, 'P' || priority AS priority, CAST(greatest(1, line - CASE priority WHEN 1 THEN 16 ELSE 10 END) AS BIGINT) AS start_line, CAST(line + CASE priority WHEN 1 THEN 32 ELSE 22 END AS BIGINT) AS end_line,
 CASE WHEN contains(categories, 'persistence') THEN 'persistence or migration evidence' WHEN source_set = 'test' THEN 'deferred verification candidate' ELSE 'ranked candidate from source index, rg summary, and optional LSP' END AS reason, covered AS in_plan
FROM r JOIN places ON places.path = r.path
"""


@query(FLAGSHIP_SQL)
def impact_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked documents of the anchor's query, truncated (fewer than six are strong), with priority, read window and reason."""
    scored = scored_items(spark, sf_dir).withColumns({"priority": ranking.priority(), "strong": ranking.is_strong(F.col("ledger"))})
    covered = ranking.priority_top(scored, ["query_id"], ranking.read_plan_max("balanced")).select("query_id", "path", F.lit(True).alias("covered"))
    ranked = scored.join(covered, ["query_id", "path"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    kept = ranking.rank(ranking.truncate_tail(ranked, ["query_id"], ranking.candidate_limit("balanced", ANCHOR.profile)), ["query_id"])
    first, last = readplan.fixed_window(F.col("priority"), F.col("positions")[0]["line"])
    return kept.select(
        F.concat(F.lit("F"), F.col("rank").cast("string")).alias("file_id"), "path", "score", F.concat(F.lit("P"), F.col("priority").cast("string")).alias("priority"),
        first.cast("long").alias("start_line"), last.cast("long").alias("end_line"), ranking.read_reason(F.col("priority")).alias("reason"), F.col("covered").alias("in_plan"),
    )


@query(f"""
SELECT count(*) FILTER (source_set = 'test' AND module <> 'de') AS deferred_tests, count(*) FILTER (module NOT IN ('en', 'fr', 'de') AND NOT contains(lower(path), 'src3')) AS cross_module_consumers, count(*) FILTER (module = 'de') AS excluded_modules FROM ({MERGED_SQL})
""")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a query holds back, and why."""
    scored = scored_items(spark, sf_dir)
    return ranking.suppression_counts(scored, ranking.exclude_modules(scored, ["de"]), ["de"], ["query_id"]).drop("query_id")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, 'a.b' || p_partkey % 5 AS package_name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'enum' END AS kind, 'P' || p_partkey AS type_name, 'Base' AS extends_type, 'Port<X>|Other' AS implements_types, 'Service|Deprecated' AS annotations,
  '[{"name":"size","line":4,"end_line":' || (6 + p_size % 7) || '},{"name":"open","line":' || (7 + p_size % 7) || ',"end_line":' || (12 + p_size % 7) || '}]' AS methods FROM part
""")
def java_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of sources made of the part table: header by expressions, methods from Arrow batches."""
    k = F.col("p_partkey")
    source = F.concat(
        F.lit("package a.b"), (k % 5).cast("string"), F.lit(";\n@Service\npublic "), F.when(F.col("p_size") % 2 == 0, "class").otherwise("enum"), F.lit(" P"), k.cast("string"), F.lit(" extends Base implements Port<X>, Other {\n  @Deprecated public <T> List<T> size() {\n"),
        F.repeat(F.lit("    run(\"{\" + \"}\");\n"), F.col("p_size") % 7), F.lit("    return null;\n  }\n  private void open(int a,\n      int b) { // }\n    if (a > b) {\n      run();\n    }\n  }\n  public abstract int none();\n  void hidden() {\n  }\n}\n"),
    )
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("path"), source.alias("content"))
    found = facts.with_methods(facts.header_facts(files))
    return found.select("path", "package_name", "kind", "type_name", "extends_type", F.array_join("implements_types", "|").alias("implements_types"), F.array_join("annotations", "|").alias("annotations"), F.to_json("methods").alias("methods"))


@query("SELECT doc_id, line, value FROM (" + LINES_SQL + ") WHERE line <= 3")
def match_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of every document, as a search program prints them, parsed again."""
    some = lines_of(spark, sf_dir).filter("line <= 3")
    printed = some.select(F.concat("doc_id", F.lit(":"), "line", F.lit(":"), "value").alias("value"))
    return tree.parse_matches(printed).select(F.col("path").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("text").alias("value"))


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 3 = 0 AS config FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderkey IS NOT NULL AS exists FROM a FULL JOIN b USING (o_orderkey) WHERE (a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.status) AND coalesce(a.o_orderkey, b.o_orderkey) % 3 <> 1
""")
def file_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poller sees between two listings; a third of the files isn't watched."""
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("modules/m"), k.cast("string"), F.lit("/pom.xml"))).when(k % 3 == 1, F.concat(F.lit("docs/D"), k.cast("string"), F.lit(".java"))).otherwise(F.concat(F.lit("src/main/java/O"), k.cast("string"), F.lit(".java")))
    orders = table(spark, sf_dir, "orders").withColumn("path", path)
    before = orders.filter(k % 5 != 0).select("path", F.col("o_orderstatus").alias("mtime"), F.lit(1).alias("size"))
    after = orders.filter(k % 11 != 0).select("path", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("mtime"), F.lit(1).alias("size"))
    return changes.listing_events(before, after, F.lit(0)).select(F.regexp_extract("uri", r"(\d+)(/pom.xml|\.java)$", 1).cast("long").alias("o_orderkey"), "exists")


@query("""
WITH r AS (SELECT event_id, user_id, ts, (SELECT count(*) FROM events d WHERE d.event_type = 'error' AND d.user_id = 1 AND d.ts <= e.ts) AS generation FROM events e WHERE event_type = 'view')
SELECT event_id, CAST(generation AS BIGINT) AS generation, row_number() OVER (PARTITION BY generation, user_id ORDER BY ts, event_id) > 1 AS hit FROM r
""")
def search_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a cache that every error of one user empties; entries don't age."""
    events = table(spark, sf_dir, "events")
    reads = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    drops = events.filter("event_type = 'error' and user_id = 1").select("ts")
    return changes.search_cache_hits(reads, drops, ["user_id"], "ts", "event_id", 10**9).select("event_id", F.col("generation").cast("long").alias("generation"), "hit")


@query("""
WITH l AS (SELECT user_id, value < 50 AS part, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS last_at FROM events GROUP BY ALL)
SELECT user_id, count(*) FILTER (kind <> 'purchase') AS active, CASE WHEN count(*) FILTER (kind <> 'purchase') = 0 THEN max(last_at) END AS idle_since FROM l GROUP BY user_id
""")
def idle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns({"token": F.col("value") < 50, "kind": F.when(F.col("event_type") == "purchase", "end").otherwise("report"), "at": F.struct("ts", "event_id")})
    return changes.idle_since(events, ["user_id"], "token", "at").select("user_id", "active", F.col("idle_since.ts").alias("idle_since"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'close' ELSE 'change' END AS action, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 4 + 2 AS BIGINT) END AS version FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0)
""")
def document_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, of which the even ones are open; a third of the changes deletes, a fifth changes nothing."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    opened = orders.filter(k % 2 == 0).select(k.alias("path"), (F.col("o_custkey") % 4 + 1).cast("long").alias("version"), F.col("o_orderstatus").alias("text"))
    files = orders.select(k.alias("path"), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise(F.concat("o_orderstatus", F.lit("2"))).alias("text"))
    changed = orders.select(k.alias("path"), F.when(k % 3 == 0, changes.DELETED).otherwise(changes.CHANGED).alias("change_type"))
    return snapshot.sync_documents(opened, changed, files).select(F.col("path").alias("o_orderkey"), "action", "version")


@query("SELECT lang, count(*) AS n, floor(avg(strlen(text)) * 100 + 0.5) / 100 AS text_bytes FROM documents WHERE text IS NOT NULL GROUP BY lang")
def payload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average bytes of the files part of payloads whose one file is a document's text; its two quotes and brackets don't count."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    held = docs.select("lang", F.concat(F.lit('{"evidenceGaps":["'), F.regexp_replace("text", r'["\\\x00-\x1f]', "_"), F.lit('"]}')).alias("json"))
    out = api.payload_attribution(held, ["lang"])
    return out.select("lang", "n", (F.round(F.col("gaps_bytes") - 4, 2)).alias("text_bytes"))


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path, starts_with(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '/es/') AS inside, CASE WHEN starts_with(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '/es/') THEN substr(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), 5) END AS below,
  page_id % 3 = 0 AS ignored, 'file:///a%20b/' || page_id || '%25.java' AS uri FROM pages
""")
def path_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of URIs, containment, ignored folders, and URIs of paths, there and back."""
    k = F.col("page_id")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1)
    local = F.concat(F.lit("/a b/"), k.cast("string"), F.lit("%.java"))
    folder = F.concat(F.lit("x/"), F.when(k % 3 == 0, "node_modules").otherwise("nodes"), F.lit("/y"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), local.alias("local"), folder.alias("folder"))
    back = rows.withColumn("uri", paths.path_to_uri(F.col("local"))).filter(paths.uri_to_path(F.col("uri")) == F.col("local"))
    return back.select("page_id", "path", paths.is_within(F.col("path"), "/es").alias("inside"), paths.relative(F.col("path"), "/es/").alias("below"), paths.is_ignored(F.col("folder")).alias("ignored"), "uri")


@query("""
SELECT p_partkey, 'x = 1; ' AS code, 'Map' AS simple, 'Service' AS annotation, CASE p_size % 30 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'File' WHEN 5 THEN 'Class' WHEN 6 THEN 'Method' WHEN 11 THEN 'Interface' WHEN 12 THEN 'Function' WHEN 26 THEN 'TypeParameter' WHEN 27 THEN 'Kind27' ELSE 'other' END AS kind,
  CAST(CASE WHEN p_retailprice < 1 THEN 1 WHEN p_retailprice > 950 THEN 950 ELSE floor(p_retailprice) END AS BIGINT) AS clamped, CAST(floor(p_retailprice / 7 + 0.5) AS BIGINT) AS rounded FROM part
""")
def java_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code without comments, simple names, names of symbol kinds, clamped and rounded numbers."""
    k = F.col("p_partkey").cast("string")
    named = F.when((F.col("p_size") % 30).isin(0, 1, 5, 6, 11, 12, 26, 27), text.symbol_kind(F.col("p_size") % 30)).otherwise("other")
    rows = table(spark, sf_dir, "part").withColumns({"line": F.concat(F.lit("x = 1; // "), k), "type": F.concat(F.lit("java.util.Map<a.K"), k, F.lit(", V>")), "mark": F.lit("@org.x.Service")})
    return rows.select(
        "p_partkey", text.strip_line_comment(F.col("line")).alias("code"), text.simple_name(F.col("type")).alias("simple"), text.simple_annotation(F.col("mark")).alias("annotation"), named.alias("kind"),
        text.clamp(F.col("p_retailprice"), 1, 950, 80).cast("long").alias("clamped"), text.half_up(F.col("p_retailprice") / 7).cast("long").alias("rounded"),
    )


@query("""
WITH s AS (SELECT 'O' || o_orderkey AS path, o_orderkey % 4 AS n FROM orders), f AS (SELECT path, 0 AS seq, NULL AS parent_seq, 'T' AS name, 5 AS kind, 1 AS line, 10 AS end_line FROM s UNION ALL SELECT path, k, 0, 'm' || k, 6, 1 + k, 2 + k FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS k))
SELECT path, CAST(seq AS BIGINT) AS seq, CAST(parent_seq AS BIGINT) AS parent_seq, name, CAST(kind AS BIGINT) AS kind, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line FROM f
""")
def symbols_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested symbols of a class with up to three methods for every order, flattened with their parents."""
    at = lambda a, b: F.concat(F.lit('"range":{"start":{"line":'), a.cast("string"), F.lit('},"end":{"line":'), b.cast("string"), F.lit("}}"))
    many = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (k > 0) & (k <= F.col("o_orderkey") % 4))
    children = F.array_join(F.transform(many, lambda k: F.concat(F.lit('{"name":"m'), k.cast("string"), F.lit('","kind":6,'), at(k, k + 1), F.lit("}"))), ",")
    tree_ = F.concat(F.lit('[{"name":"T","kind":5,'), at(F.lit(0), F.lit(9)), F.lit(',"children":['), children, F.lit("]}]"))
    flat = facts.flatten_symbols(table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("path"), tree_.alias("symbols")))
    return flat.select("path", *[F.col(c).cast("long").alias(c) for c in ("seq", "parent_seq")], "name", *[F.col(c).cast("long").alias(c) for c in ("kind", "line", "end_line")])


@query("""
SELECT 'r' || s_nationkey || '/m' || s_suppkey || '/src/A.java' AS path, CASE s_nationkey % 3 WHEN 0 THEN 'r' || s_nationkey WHEN 1 THEN 'r' || s_nationkey ELSE 'r' || s_nationkey || '/m' || s_suppkey END AS root FROM supplier
""")
def build_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder whose build file governs each source: a settings file's, a Maven aggregator's, or the nearest build.gradle's."""
    kind, top = F.col("s_nationkey") % 3, F.concat(F.lit("r"), F.col("s_nationkey").cast("string"))
    inner = F.concat(top, F.lit("/m"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier")
    name = F.when(kind == 0, "settings.gradle.kts").when(kind == 1, "pom.xml").otherwise("build.gradle")
    outer = rows.select(top.alias("dir"), name.alias("name"), (kind == 1).alias("aggregator")).distinct()
    own = rows.select(inner.alias("dir"), F.when(kind == 1, "pom.xml").otherwise("build.gradle.kts").alias("name"), F.lit(False).alias("aggregator"))
    return graph.build_root(rows.select(F.concat(inner, F.lit("/src/A.java")).alias("path")), outer.unionByName(own))


@query("""
SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'modules/m' || s_nationkey || '/src/main/java' WHEN 1 THEN 'm' || s_nationkey || '/src/test/java' WHEN 2 THEN 'src/main/java' END AS relative_path,
  CASE WHEN s_suppkey % 4 = 2 THEN '.' ELSE 'm' || s_nationkey END AS module, CASE WHEN s_suppkey % 4 = 1 THEN 'test' ELSE 'main' END AS source_set FROM supplier WHERE s_suppkey % 4 < 3
""")
def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("s_suppkey"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string"))
    root = F.when(k % 4 == 0, F.concat(F.lit("modules/"), m, F.lit("/src/main/java/"))).when(k % 4 == 1, F.concat(m, F.lit("/src/test/java/"))).when(k % 4 == 2, "src/main/java/").otherwise(F.concat(F.lit("deep/er/"), m, F.lit("/src/main/java/")))
    return tree.source_roots(table(spark, sf_dir, "supplier").select(F.concat(root, F.lit("p/S"), k.cast("string"), F.lit(".java")).alias("path")))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def last_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was last published for every user; an error publishes an empty list, which clears."""
    ids = F.when(F.col("event_type") == "error", F.array().cast("array<bigint>")).otherwise(F.array("event_id"))
    published = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), ids.alias("diagnostics"))
    return changes.latest_diagnostics(published, "user_id", "at").select("user_id", F.col("diagnostics")[0].alias("event_id"))


@query("""
SELECT count(*) AS entries, count(*) FILTER (o_orderkey % 3 = 0) AS regex_facts, count(*) FILTER (o_orderkey % 3 = 1) AS symbol_facts, count(*) FILTER (o_orderkey % 4 = 0) AS dirty, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS started FROM orders
""")
def server_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    known = orders.select(k.alias("path"), F.lit(1.0).alias("mtime_ms"), F.lit(1).alias("size"), F.when(k % 3 == 0, "regex").when(k % 3 == 1, "documentSymbol").otherwise("none").alias("fact_source"))
    listing = orders.select(k.alias("path"), F.lit(1.0).alias("mtime_ms"), F.when(k % 4 == 0, 2).otherwise(1).alias("size"))
    runtimes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("repo"), F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") % 2 == 0).alias("started"))
    return api.status(known, listing, runtimes).select("entries", "regex_facts", "symbol_facts", "dirty", "started")


@query("SELECT user_id, event_type AS name, CAST(sum(event_id % 97) AS BIGINT) AS ms, count(*) AS n FROM events GROUP BY user_id, event_type")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.phase_totals(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), (F.col("event_id") % 97).alias("ms")), ["user_id"])


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || repeat(chr(10), 4) || 'x' ELSE role END AS hover, role AS picked, '/c d/' || conv_id AS path, CAST(turn + 1 AS BIGINT) AS line, CAST(conv_id % 50 + 1 AS BIGINT) AS col FROM conversations")
def hovers_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of hovers in the three forms they have, settings by dotted path, and places of locations and links."""
    role, t = F.col("role"), F.col("turn") % 3
    quoted = F.concat(F.lit('"'), role, F.lit('"'))
    hover = F.when(t == 0, F.concat(F.lit('{"value":'), quoted, F.lit("}"))).when(t == 1, F.concat(F.lit("["), quoted, F.lit(',"",{"value":"x"}]'))).otherwise(quoted)
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", hover.alias("h"), F.concat(F.lit('{"java":{"home":'), quoted, F.lit("}}")).alias("settings"), F.when(t == 0, F.concat(F.lit("file:///c%20d/"), "conv_id")).alias("target_uri"),
        F.when(t == 0, F.lit("file:///other")).otherwise(F.concat(F.lit("file:///c%20d/"), "conv_id")).alias("uri"), F.col("turn").alias("line"), (F.col("conv_id") % 50).alias("character"),
    )
    placed = api.describe_location(rows)
    return placed.select("conv_id", "turn", api.hover_text(F.col("h")).alias("hover"), api.pick(F.col("settings"), "java.home").alias("picked"), "path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"))


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS memory_gb, CAST(CASE WHEN p_size <= 24 THEN 1 WHEN p_size <= 48 THEN 3 ELSE 4 END AS BIGINT) AS repos, CASE WHEN p_size <= 24 THEN '1536m' WHEN p_size <= 48 THEN '2g' ELSE '3g' END AS heap,
  CAST(CASE p_partkey % 4 WHEN 0 THEN p_partkey // 2 + CASE WHEN p_partkey = 0 THEN 80 ELSE 0 END ELSE 80 END AS BIGINT) AS n FROM part
""")
def resource_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What machines of a part's size in GB run, and numbers read from texts, of which three in four aren't usable."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, (k / 2).cast("string")).when(k % 4 == 1, "many").when(k % 4 == 2, F.concat(F.lit("-"), k.cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", api.resource_defaults(F.col("p_size")).alias("d"), api.positive_integer(raw, 80).cast("long").alias("n"))
    return rows.select("p_partkey", F.col("d.memory_gb").cast("long").alias("memory_gb"), F.col("d.max_active_repos").cast("long").alias("repos"), "d.heap", "n")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey ELSE 'Kept' END AS type_name FROM part")
def facts_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of parts as sources, two thirds of which were parsed before and haven't changed."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.lit(1).alias("mtime"), F.when(k % 3 == 0, 2).otherwise(1).alias("size"), F.concat(F.lit("public class P"), k.cast("string"), F.lit(" {\n}")).alias("content"))
    made = facts.with_methods(facts.header_facts(files)).drop("content")
    known = made.withColumns({"size": F.lit(1), "type_name": F.lit("Kept")})
    return facts.refreshed(files, known).select("path", "type_name")
