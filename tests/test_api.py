"""The lookups beside the flagship query."""

from pyspark.sql import functions as F

from siftwright.plans import api
from siftwright.schemas import SEMANTIC_EDGES


def test_references_limit_before_grouping(spark):
    rows = [("reference", "a.java", 3, 1, f"modules/{m}/src/main/java/domain/{f}.java", n, 1, 0) for m, f, n in [("x", "B", 9), ("x", "B", 2), ("y", "C", 1), ("x", "A", 5)]] + [("definition", "a.java", 3, 1, "z", 1, 1, 0)]
    edges = spark.createDataFrame(rows, SEMANTIC_EDGES)
    got = [(r.module, r.path[-6:], r.n, [p.line for p in r.positions], r.place) for r in api.references(edges, "a.java", 3).orderBy("module", "place").collect()]
    assert got == [("x", "B.java", 2, [2, 9], 1), ("x", "A.java", 1, [5], 2), ("y", "C.java", 1, [1], 1)]
    assert api.references(edges, "a.java", 3, limit=2).agg(F.sum("n")).first()[0] == 2
    assert api.references(edges, "a.java", 3, module="y").count() == 1


def test_symbols_diagnostics_status(spark):
    table = spark.createDataFrame([(f"Order{k}", 5, "f", k) for k in range(4)], "name string, kind int, file string, line int")
    rows, more = api.symbols(table, "Order", 3)
    assert [r.kind_name for r in rows.collect()] == ["Class"] * 3 and more
    latest = spark.createDataFrame([("a", ["x"])], "file string, diagnostics array<string>")
    assert {r.file: r.diagnostics for r in api.diagnostics(latest, ["a", "b"]).collect()} == {"a": ["x"], "b": []}
    facts = spark.createDataFrame([("p", 1.0, 1, "regex")], "path string, mtime_ms double, size int, fact_source string")
    listing = spark.createDataFrame([("p", 1.0, 2)], "path string, mtime_ms double, size int")
    row = api.status(facts, listing, spark.createDataFrame([("r", 7, True), ("s", 8, False)], "repo string, pid int, started boolean")).first()
    assert (row.entries, row.regex_facts, row.dirty, row.started, row.pids) == (1, 1, 1, 1, [7])


def test_texts_and_projections(spark):
    df = spark.createDataFrame([('{"value":"a"}', "a"), ('["x",{"value":"y"}]', "x\n\ny"), ('"t"', "t")], "h string, wanted string")
    assert all(r.got == r.wanted for r in df.select("wanted", api.hover_text(F.col("h")).alias("got")).collect())
    one = spark.createDataFrame([("x" * 90, '{"java":{"home":"/j"}}', "file:///a%20b", 0, 4)], "json string, settings string, uri string, line int, character int")
    sized = api.with_output_bytes(one).first()
    assert sized.output_bytes == 90 + len(',"outputBytes":') + 3 and one.select(api.pick(F.col("settings"), "java.home")).first()[0] == "/j"
    place = api.describe_location(one).first()
    assert (place.path, place.line, place.column) == ("/a b", 1, 5)
    full = api.evidence_gaps(F.lit(True), F.lit(False), F.lit(True), F.array(F.lit("dto"), F.lit("port")), F.lit("defer"))
    compact, standard, whole = one.select(api.short_gaps(full, "compact"), api.short_gaps(full, "standard"), api.short_gaps(full, "diagnostic")).first()
    assert compact == ["Run compile/test before claims.", "Check rg/runtime evidence for wiring and DB/config."]
    assert standard[2] == "Semantic skipped; raise semanticPolicy for exact binding." and len(standard) == 3
    assert [g.split()[0] for g in whole] == ["Run", "Use", "LSP", "Source", "Review", "Tests"]
    prompts = {"排查 Java service 调用链": True, "fix the OrderMapper": True, "hello": False}
    got = spark.createDataFrame([(p,) for p in prompts], "p string").select("p", api.looks_semantic(F.col("p")).alias("y")).collect()
    assert {r.p: r.y for r in got} == prompts


def test_semantic_policy():
    use, verify = api.use_semantic, api.verify_semantic
    assert not use("fast", "recall", ["service"]) and use("required", "balanced", []) and use("auto", "precision", ["dto"]) and use("auto", "balanced", ["dto", "service"]) and not use("auto", "balanced", ["port"])
    assert not verify("fast", "recall", True, True) and verify("required", "balanced", False) and verify("auto", "recall", True) and verify("auto", "balanced", True, True) and not verify("auto", "balanced", False, True)


def test_payload_attribution(spark):
    rows = [("s", '{"files":[1,2],"rgSummary":{"sections":[{"files":[{"a":1}]},{"files":[]}]},"metrics":{"outputBytes":7,"cache":{}}}'), ("s", "{}")]
    row = api.payload_attribution(spark.createDataFrame(rows, "v string, json string"), ["v"]).first()
    assert (row.n, row.files_bytes, row.section_files_bytes, row.gaps_bytes, row.output_bytes) == (2, 3.5, 8.0, 2.0, 3.5)


def test_alias_resolution(spark):
    probes = spark.createDataFrame([("r/a/b/X", "g1"), ("q/X", "g1"), ("q/Y", "g2"), ("q/Z", "g3")], "path string, family string")
    aliases = spark.createDataFrame([("one", "r"), ("two", "r/a")], "alias string, root string")
    families = spark.createDataFrame([("one", "g1"), ("one", "g2"), ("two", "g2")], "alias string, family string")
    assert {r.path: (r.alias, r.how) for r in api.resolve_alias(probes, aliases, families).collect()} == {"r/a/b/X": ("two", "root"), "q/X": ("one", "family"), "q/Y": (None, "conflict"), "q/Z": (None, "none")}
