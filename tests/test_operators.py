"""Evidence, scores, ranking, windows, graphs, snapshots, change feeds and the whole query."""

import pytest
from pyspark.sql import functions as F

from siftwright.operators import evaluation, evidence, graph, ranking, readplan, scoring, snapshot
from siftwright.plans import impact, profiles
from siftwright.schemas import EVIDENCE, SEMANTIC_EDGES
from siftwright.sources import tree
from siftwright.streaming import changes


def test_rule_scores(spark):
    anchor = scoring.Anchor("modules/imp/src/main/java/application/StudentParser.java", "parser", "imp")
    rows = [("modules/imp/src/test/java/ExcelParserTest.java", "imp", None, "test", "tests"), ("modules/imp/src/main/java/infrastructure/persistence/TaskRepository.java", "imp", "infrastructure", "main", "java"), (anchor.path, "imp", "application", "main", "java")]
    df = spark.createDataFrame(rows, "path string, module string, layer string, source_set string, category string")
    got = [r[0] for r in df.select(scoring.base_score(anchor, scoring.Options())).collect()]
    assert got == [24 + 28 + 38 + 90, 56 + 28 + 14 - 70, 56 + 180 + 28 + 14 + 12 + 38]
    nulls = df.limit(1).withColumn("module", F.lit(None).cast("string"))
    assert nulls.select(scoring.base_score(scoring.Anchor("x", "vo", None), scoring.Options())).first()[0] == 24 + 28


def test_package_proximity(spark):
    cases = [("a.b.c", "a.b.c", 30), ("a.b.c.d", "a.b.c.e", 18), ("a.b", "x.y", 0), ("a.b.c.d.e.f", "a.b.c.d.x.y.z", 8), ("a.b.c", "a.b.c.d.e", 0), (None, "a", 0)]
    df = spark.createDataFrame(cases, "a string, b string, n int")
    assert all(r.got == r.n for r in df.select("n", scoring.package_proximity(F.col("a"), F.col("b")).alias("got")).collect())


def test_stereotypes(spark):
    assert "Service" in scoring.collaborators("Controller") and "Controller" in scoring.collaborators("Service") and scoring.collaborators(None) == []
    df = spark.createDataFrame([(["Deprecated", "@org.x.RestController(\"/a\")"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(scoring.stereotype(F.col("a"))).collect()] == ["RestController", None]
    pairs = {tuple(r) for r in scoring.collaboration_pairs(spark).collect()}
    assert ("Mapper", "Repository") in pairs and ("Repository", "Mapper") in pairs


def test_direct_collaborators(spark):
    anchor = scoring.Anchor("modules/pay/src/main/java/domain/OrderPort.java", "port", "pay", "OrderPort", "createInvoice")
    options = scoring.Options(task_keywords=["bulk refund", "ledger"])
    rows = [("OrderGateway", 220), ("OrderInvoiceService", 220), ("BulkRefundCommand", 220), ("LedgerEntity", 220), ("LedgerLineAssembler", 190), ("FinalOrderResult", 220), ("Other", 0), ("OrderPort", 0)]
    df = spark.createDataFrame([(f"modules/pay/src/main/java/domain/{n}.java", "pay", n, d) for n, d in rows], "path string, module string, name string, wanted int")
    got = df.select("wanted", scoring.direct_collaborator(anchor, options, F.col("name")).alias("got")).collect()
    assert all(r.got == r.wanted for r in got), got


def test_merge_keeps_order_and_sums(spark):
    rows = [
        ("q", "a", 2, 1, 5, 1, [(9, 1)], ["tests"], ["r2"], ["rg"], "medium", "m2", None, None),
        ("q", "a", 0, 0, 1000, 0, [(1, 1)], ["target"], ["target"], ["anchor"], "high", "m", "l", "main"),
        ("q", "a", 2, 0, 7, 3, [(1, 1), (4, 1)], ["java"], ["r2"], ["rg"], "low", "m3", None, None),
        ("q", "b", 2, 0, 1, 1, [(k, 1) for k in range(20)], ["java"], [], [], "low", None, None, None),
    ]
    out = {r.path: r for r in evidence.merge_evidence(spark.createDataFrame(rows, EVIDENCE)).collect()}
    a = out["a"]
    assert (a.score, a.match_count, a.categories, a.reasons, a.confidence, a.module, a.layer) == (1012, 4, ["target", "java", "tests"], ["target", "r2"], "high", "m", "l")
    assert [p.line for p in a.positions] == [1, 4, 9] and len(out["b"].positions) == 8


def tail(spark, rows, limit=26):
    df = spark.createDataFrame([("q", f"p{k:03}", s, strong, covered) for k, (s, strong, covered) in enumerate(rows)], "q string, path string, score long, strong boolean, covered boolean")
    return sorted(r.path for r in ranking.truncate_tail(df, ["q"], limit).collect())


def test_tail_truncation(spark):
    strong = [(200 - k, True, k == 0) for k in range(8)]
    assert len(tail(spark, [(5, False, False)] * 9)) == 9
    assert len(tail(spark, strong + [(50 - k, False, k == 0) for k in range(12)], 20)) == 13
    assert tail(spark, strong + [(100, False, False), (95, False, False), (20, False, False)]) == [f"p{k:03}" for k in range(10)]
    assert len(tail(spark, [(200, True, False)] * 3 + [(50, False, False)] * 9, 20)) == 12
    kept = tail(spark, [(100 - k, False, k == 11) for k in range(12)], 5)
    assert len(kept) == 5 and "p011" in kept


def test_priorities_and_protected_top(spark):
    rows = [("a", "test", [], [], 90, False), ("b", "main", [], ["target"], 10, False), ("c", "main", ["config"], [], 80, False), ("d", "main", [], [], 70, False), ("e", None, [], [], 99, True)]
    df = spark.createDataFrame([("q", *r) for r in rows], "q string, path string, source_set string, categories array<string>, reasons array<string>, score int, protected boolean").withColumn("priority", ranking.priority())
    assert {r.path: r.priority for r in df.collect()} == {"a": 2, "b": 0, "c": 2, "d": 1, "e": 2}
    assert [r.path for r in ranking.priority_top(df, ["q"], 3).orderBy("place").collect()] == ["b", "d", "e"]
    assert [r.path for r in ranking.protected_top(df, ["q"], 2).orderBy("place").collect()] == ["b", "e"]
    assert ranking.candidate_limit("balanced", "port") == 20 and ranking.candidate_limit("recall", "port") == 70 and ranking.candidate_limit("balanced") == 26 and ranking.read_plan_max("recall") == 12
    assert [r.path for r in ranking.exclude_modules(df.withColumn("module", F.when(F.col("path") == "a", "x")), ["x"]).collect()] == ["b", "c", "d", "e"]


def test_collation_order(spark):
    df = spark.createDataFrame([("q", p, 1) for p in ("A/z.java", "a/B.java", "a/_x.java", "a/a.java")], "q string, path string, score int")
    assert [r.path for r in ranking.rank(df, ["q"], collation="UNICODE").orderBy("rank").collect()] == ["a/_x.java", "a/a.java", "a/B.java", "A/z.java"]


def test_read_windows(spark):
    df = spark.createDataFrame([(0, 31, 30, 33, 18, 41), (0, 35, None, None, 11, 79), (2, 35, 34, 36, 25, 57), (1, 3, 1, 200, 1, 35)], "p int, line int, a int, b int, first int, last int")
    first, last = readplan.read_window(F.col("p"), F.col("line"), F.col("a"), F.col("b"))
    assert all((r.f, r.l) == (r.first, r.last) for r in df.select("first", "last", first.alias("f"), last.alias("l")).collect())


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    starts = spark.createDataFrame([("q", "a")], "query_id string, node string")
    got = [tuple(r)[1:] for r in graph.bounded_walk(edges, starts, 3, 40).orderBy("depth", "src", "dst").collect()]
    assert got == [(1, "a", "b"), (2, "b", "a"), (2, "b", "c"), (3, "a", "b"), (3, "c", "d")]
    assert graph.bounded_walk(edges, starts, 3, 2).count() == 2


def test_build_roots(spark):
    files = spark.createDataFrame([("x/y/src/A.java",), ("m/n/src/A.java",), ("g/h/src/A.java",), ("none/A.java",)], "path string")
    builds = spark.createDataFrame([("x", "settings.gradle", False), ("x/y", "build.gradle", False), ("m", "pom.xml", True), ("m/n", "pom.xml", False), ("g", "build.gradle", False), ("g/h", "build.gradle", False)], "dir string, name string, aggregator boolean")
    assert {r.path: r.root for r in graph.build_root(files, builds).collect()} == {"x/y/src/A.java": "x", "m/n/src/A.java": "m", "g/h/src/A.java": "g/h"}


def test_snapshots(spark):
    log = spark.createDataFrame([(f"p{k % 2}", f"b{k}", k, 1.0 * k, k) for k in range(24)], "path string, batch_id string, seq int, mtime_ms double, size int")
    stats = snapshot.statistics(log, ["path"]).first()
    assert (stats.records, stats.distinct_keys, stats.compact) == (24, 2, True)
    now = snapshot.last_writes(log, ["path"], ["seq"])
    assert {r.path: r.batch_id for r in now.collect()} == {"p0": "b22", "p1": "b23"}
    symbols = spark.createDataFrame([("p0", "b22", "m", 1, 2), ("p0", "b20", "old", 1, 2)], "path string, batch_id string, name string, line int, end_line int")
    assert {r.path: [m.name for m in r.methods] for r in snapshot.load(log, symbols).collect()} == {"p0": ["m"], "p1": []}
    listing = spark.createDataFrame([("p0", 22.0, 22), ("p1", 23.0, 99), ("p2", 1.0, 1)], "path string, mtime_ms double, size int")
    assert sorted(r.path for r in snapshot.dirty(listing, now).collect()) == ["p1", "p2"]


def test_changes_in_batch_and_stream(spark, tmp_path):
    rows = [("a", True, 1), ("a", True, 2), ("a", False, 3), ("a", False, 4), ("b", False, 1), ("a", True, 5)]
    df = spark.createDataFrame(rows, "uri string, exists boolean, t long").withColumn("event_time", F.timestamp_seconds("t"))
    wanted = [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 5, 1)]
    assert sorted((r.uri, r.t, r.change_type) for r in changes.classify(df).collect()) == wanted
    df.select("uri", "exists", "event_time").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = changes.classify_stream(spark.readStream.schema("uri string, exists boolean, event_time timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("classified").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("classified").selectExpr("uri", "unix_seconds(event_time) t", "change_type").collect()
    assert sorted(tuple(r) for r in got) == wanted


def test_debounce_twins_agree(spark):
    rows = [("r", "x", 1, 0.0), ("r", "y", 2, 0.1), ("r", "x", 3, 0.3), ("r", "x", 4, 5.0), ("s", "x", 5, 0.0)]
    df = spark.createDataFrame(rows, "repo string, uri string, kind int, t double").withColumn("event_time", (F.col("t") * 1000).cast("long")).withColumn("event_time", F.timestamp_millis("event_time"))
    batch = sorted((r.repo, r.uri, r.kind) for r in changes.debounce_batch(df, "repo", "uri", "kind", ["kind"]).collect())
    assert batch == sorted((r.repo, r.uri, r.kind) for r in changes.debounce(df, "repo", "uri", "kind").collect()) == [("r", "x", 3), ("r", "x", 4), ("r", "y", 2), ("s", "x", 5)]


def test_invalidation_and_ttl(spark):
    entries = spark.createDataFrame([("a", ["k"]), ("b", ["z"]), ("c", [])], "entry string, depends_on array<string>")
    assert sorted(r.entry for r in changes.invalidated(entries, spark.createDataFrame([("k",)], "key string")).collect()) == ["a", "c"]
    reads = spark.createDataFrame([("u", k, k * 4) for k in range(5)], "u string, id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.hit for r in changes.ttl_hits(reads, "u", "ts", "id", 10).orderBy("id").collect()] == [False, True, True, False, True]
    drops = spark.createDataFrame([(1, 2), (2, 0), (3, 5)], "k int, dropped int")
    assert [r.generation for r in changes.generations(drops, ["k"]).orderBy("k").collect()] == [2, 2, 7]


def test_metrics_of_empty_sets(spark):
    none = spark.createDataFrame([], "q string, path string, rank int, planned boolean")
    gold = spark.createDataFrame([("q", "a", True)], "q string, path string, must boolean")
    row = evaluation.retrieval_metrics(none, gold, ["q"]).first()
    assert (row.precision, row.recall, row.p_read, row.r_read_must) == (0.0, 0.0, 1.0, 0.0)


def test_attribution(spark):
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "q string, path string")
    cand = spark.createDataFrame([("q", "a", True, ["rg", "reference"]), ("q", "b", False, [])], "q string, path string, planned boolean, verified_by array<string>")
    got = {r.path: (r.in_files, r.in_plan, r.source, r.blocked_by) for r in evaluation.attribution(gold, cand, ["q"]).collect()}
    assert got == {"a": (True, True, "reference", "hit"), "b": (True, False, "unknown", "readplan-full"), "c": (False, False, "unknown", "absent")}


def test_profiles(spark):
    rows = [("x/controller/A.java", "A", "class", ["Service"], [], None, "service"), ("x/A.java", "OrderDTO", "class", [], [], None, "dto"), ("x/A.java2", "P", "interface", [], [], None, "port"), ("x/B.java", "Z", "class", [], [], None, "service"), ("x/C.java", "CVO", "class", [], ["JpaRepository<A>"], None, "repository")]
    df = spark.createDataFrame(rows, "path string, type_name string, kind string, annotations array<string>, implements_types array<string>, extends_type string, wanted string")
    got = {r.path: r.profile for r in profiles.infer_profiles(df).collect()}
    assert got == {r[0]: r[-1] for r in rows}
    assert {r.profile for r in profiles.infer_profiles(df, "Mapper").collect()} == {"mapper"}


def test_search_plans():
    plan = profiles.search_plan("repository", "OrderRepository", "findByOwner", ["bulk refund"])
    assert [s.category for s in plan] == ["java", "persistence", "tests"] and "Order(Repository|" in plan[0].pattern and "order_repository" in plan[1].pattern and "BulkRefund(" in plan[0].pattern
    assert [s.category for s in profiles.search_plan("job", "CleanJob", "run", mode="recall")] == ["java", "config", "tests", "config"]
    assert "ByOwner" in plan[0].pattern and "Doc.*Test" in profiles.search_plan("service", "DocService")[-1].pattern


FILES = {
    "src/main/java/demo/controller/DemoController.java": "package demo.controller;\n\n@RestController\npublic class DemoController {\n    public String save(String a) {\n        return new DemoService().save(a);\n    }\n}\n",
    "src/main/java/demo/service/DemoService.java": "package demo.service;\n\n@Service\npublic class DemoService {\n    public String save(String a) {\n        return a;\n    }\n}\n",
    "src/main/java/demo/other/Noise.java": "package demo.other;\n\npublic class Noise {\n}\n",
    "src/test/java/demo/DemoControllerTest.java": "package demo;\n\npublic class DemoControllerTest {\n    public void saves() {\n        new DemoController().save(\"a\");\n    }\n}\n",
}


def test_impact_end_to_end(spark, tmp_path):
    for path, content in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    files = tree.read_tree(spark, str(tmp_path))
    assert {r.path for r in files.select("path").collect()} == set(FILES)
    ranked, plan = impact.impact(files.select("path", "content"), "src/main/java/demo/controller/DemoController.java", 5, 19, scoring.Options(task_keywords=["demo", "save"]))
    rows = ranked.collect()
    assert {r.path.split("/")[-1] for r in rows} == {"DemoController.java", "DemoService.java", "DemoControllerTest.java"}
    assert all(sum(e.delta for e in r.ledger) == r.score for r in rows) and not scoring.ledger_faults(ranked, ["path"]).count()
    read = plan.collect()
    assert (read[0].priority, read[0].path.split("/")[-1], read[0].start_line) == ("P0", "DemoController.java", 1) and len(read) == 3
    with pytest.raises(ValueError):
        impact.impact(files.select("path", "content"), "missing.java", 1, 1)
    assert [r.module for r in tree.source_roots(files).collect()] == [".", "."]


def files_in(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_read_windows_around_an_anchor(spark):
    lines = ["package demo;", "public class WindowService {", *["  int padding;"] * 27, "  public void targetMethod() {", "    int value = 1;", "    value++;", "  }", "", "  int afterMethod;", "}"]
    path = "src/main/java/demo/WindowService.java"
    files = files_in(spark, {path: "\n".join(lines)})
    rows = [impact.impact_of(files, [(path, line, column)], scoring.Options(read_plan_max=1), "service").read_plan.collect() for line, column in ((31, 10), (35, 7))]
    assert [(r.priority, r.file_id, r.start_line, r.end_line, r.reason) for (r,) in rows] == [("P0", "F1", 18, 41, "anchor symbol and local behavior"), ("P0", "F1", 11, 79, "anchor symbol and local behavior")]


ORDERS = {
    "pom.xml": "<project></project>",
    "modules/order/src/main/java/com/x/order/app/OrderService.java": "package com.x.order.app;\n@Service\npublic class OrderService { public void placeOrder() { } }\n",
    "modules/order/src/main/java/com/x/order/infra/OrderRepository.java": "package com.x.order.infra;\n@Repository\npublic class OrderRepository { public void saveOrder(Long orderId) { } }\n",
    "modules/pay/src/main/java/com/x/pay/OrderGateway.java": "package com.x.pay;\npublic interface OrderGateway { }\n",
    "modules/pay/src/main/java/com/x/pay/StripeGateway.java": "package com.x.pay;\npublic class StripeGateway implements OrderGateway { }\n",
    "modules/order/src/test/java/com/x/order/OrderServiceTest.java": "package com.x.order;\npublic class OrderServiceTest { OrderService s; }\n",
}


def test_structural_signals_and_counters(spark):
    files = files_in(spark, ORDERS)
    found = impact.impact_of(files, [("modules/order/src/main/java/com/x/order/app/OrderService.java", 3, 21)], scoring.Options(task_keywords=["order"]))
    rows = {r.path.split("/")[-1]: r for r in found.files.collect()}
    ledger = {e.id: e.delta for e in rows["OrderRepository.java"].ledger}
    assert ledger["finalize.structural.annotation"] == 50 and ledger["finalize.structural.package"] == 18
    assert all(sum(e.delta for e in r.ledger) == r.score for r in rows.values())
    assert "StripeGateway.java" not in rows  # another module
    counts = found.suppressed.first()
    assert (counts.deferred_tests, counts.cross_module_consumers, counts.excluded_modules) == (1, 0, 0)
    assert found.gaps[2].startswith("LSP semantic enrichment was skipped") and len(found.gaps) == 5
    assert {(s.category, s.reason) for s in found.sections.collect()} == {("java", "service, direct callers, and local protocol family"), ("tests", "targeted verification candidates")}


def test_type_graph_and_semantic_edges(spark):
    files = files_in(spark, ORDERS)
    place = ("modules/pay/src/main/java/com/x/pay/OrderGateway.java", 2, 20)
    plain = {r.path.split("/")[-1]: r for r in impact.impact_of(files, [place]).files.collect()}
    stripe = plain["StripeGateway.java"]
    assert "typeGraph" in stripe.verified_by and "typeGraph" in stripe.reasons and "semantic" in stripe.categories and "implementation" not in stripe.reasons
    edges = spark.createDataFrame([("implementation", place[0], 2, 20, "modules/pay/src/main/java/com/x/pay/StripeGateway.java", 2, 14, 0), ("reference", place[0], 2, 20, "modules/order/src/main/java/com/x/order/infra/OrderRepository.java", 3, 5, 0)], SEMANTIC_EDGES)
    off = impact.impact_of(files, [place], edges=edges)  # a port in a balanced mode doesn't ask
    assert {r.path.split("/")[-1]: r.score for r in off.files.collect()} == {k: r.score for k, r in plain.items()}
    on = impact.impact_of(files, [place], scoring.Options(semantic_policy="required"), edges=edges)
    rows = {r.path.split("/")[-1]: r for r in on.files.collect()}
    assert {"implementation", "typeGraph"} <= set(rows["StripeGateway.java"].reasons) and "semantic-implementation" in rows["StripeGateway.java"].verified_by and rows["StripeGateway.java"].confidence == "high"
    assert "reference" in rows["OrderRepository.java"].reasons
    assert {r.path.split("/")[-1]: r.priority for r in on.read_plan.collect()}["StripeGateway.java"] == "P0"
    assert not any("skipped" in g for g in on.gaps)


def test_several_anchors_are_merged(spark):
    files = files_in(spark, ORDERS)
    places = [("modules/order/src/main/java/com/x/order/app/OrderService.java", 3, 21), ("modules/pay/src/main/java/com/x/pay/OrderGateway.java", 2, 20)]
    found = impact.impact_of(files, places, scoring.Options(exclude_modules=["nothing"]))
    rows = {r.path.split("/")[-1]: r for r in found.files.collect()}
    assert [a.profile for a in found.anchors] == ["service", "port"] and {"OrderService.java", "OrderGateway.java", "StripeGateway.java", "OrderServiceTest.java"} <= set(rows)
    assert "target" in rows["OrderGateway.java"].reasons and sum(r.priority == "P0" for r in found.read_plan.collect()) == 2
    away = impact.impact_of(files, places, scoring.Options(exclude_modules=["pay"]))
    assert away.suppressed.first().excluded_modules >= 2 and not any("/pay/" in r.path for r in away.files.collect())
    for wrong in ([], places * 3):
        with pytest.raises(ValueError, match="anchors"):
            impact.impact_of(files, wrong)


def tail_of(spark, rows, limit=26):
    table = spark.createDataFrame([("q", p, s, strong, covered) for p, s, strong, covered in rows], "q string, path string, score long, strong boolean, covered boolean")
    return {r.path for r in ranking.truncate_tail(table, ["q"], limit).collect()}


def test_tail_cases(spark):
    strong = lambda n, top: [(f"/s/S{i}.java", top - i, True, False) for i in range(n)]
    noise = [(f"/n/N{i:02d}.java", 50 - i, False, i == 0) for i in range(12)]
    covered = [(p, s, k, c or i == 0) for i, (p, s, k, c) in enumerate(strong(8, 200))]
    kept = tail_of(spark, covered + noise)
    assert len(kept) == 13 and {p for p, *_ in covered} <= kept
    cliff = tail_of(spark, strong(8, 300) + [("/n/A.java", 100, False, False), ("/n/B.java", 95, False, False), ("/n/C.java", 20, False, False)])
    assert {"/n/A.java", "/n/B.java"} <= cliff and "/n/C.java" not in cliff
    assert len(tail_of(spark, strong(3, 300) + [(f"/n/N{i}.java", 100 - i, False, False) for i in range(9)], 20)) == 12
    focus = tail_of(spark, [(f"/f/F{i:02d}.java", 120 - i, False, i == 0) for i in range(12)], 5)
    assert len(focus) == 5 and "/f/F00.java" in focus


def test_roots_are_looked_for_where_modules_are(spark):
    paths_ = ["src/main/java/A.java", "x/src/test/java/A.java", "modules/m/src/main/java/p/A.java", "apps/a/src/main/resources/x.yml", "a/b/src/main/java/A.java", "docs/sql/1.sql", "a/b/src/main/resources/r", "deep/docs/sql/2.sql"]
    files = spark.createDataFrame([(p,) for p in paths_], "path string")
    assert [tuple(r) for r in tree.source_roots(files).collect()] == [("modules/m/src/main/java", "m", "main"), ("src/main/java", ".", "main"), ("x/src/test/java", "x", "test")]
    assert [r[0] for r in tree.resource_roots(files).collect()] == ["apps/a/src/main/resources", "docs/sql"]


def test_aliases_and_printed_matches(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"aliases":[{"id":"x","root":"/r/s/"},{"id":"y","root":"/","lspEnabled":true,"layoutProfile":"ddd-gradle"}],"defaults":{}}')
    assert sorted(tuple(r) for r in tree.read_aliases(spark, str(tmp_path / "a.json")).collect()) == [("x", "/r/s", False, None), ("y", "/", True, "ddd-gradle")]
    (tmp_path / "b.json").write_text('{"aliases":[{"id":"x","root":"r"}]}')
    with pytest.raises(Exception, match="absolute root"):
        tree.read_aliases(spark, str(tmp_path / "b.json")).collect()
    printed = spark.createDataFrame([("a/b.java:12:x:1",), ("nothing",), ("c:3:",)], "value string")
    assert [tuple(r) for r in tree.parse_matches(printed).collect()] == [("a/b.java", 12, "x:1"), ("c", 3, "")]


def test_logs_are_whole_or_discarded(spark):
    facts = spark.createDataFrame([("p", 1.0, [("m", 1, 2)]), ("q", 2.0, [])], "path string, mtime_ms double, methods array<struct<name:string,line:int,end_line:int>>")
    files, symbols = snapshot.appended(facts)
    lines = lambda df: df.selectExpr("to_json(struct(*)) AS value")
    schemas = ("path string, mtime_ms double, batch_id string", "path string, batch_id string, name string, line int, end_line int")
    back, methods = snapshot.read_logs(lines(files), lines(symbols), *schemas)
    got = {r.path: [m.name for m in r.methods] for r in snapshot.load(back.withColumn("seq", F.lit(1)), methods).collect()}
    assert got == {"p": ["m"], "q": []}
    broken = lines(symbols).union(spark.createDataFrame([("{oops",)], "value string"))
    assert [df.count() for df in snapshot.read_logs(lines(files), broken, *schemas)] == [0, 0]


def test_equal_probes_stay_apart(spark):
    probes = spark.createDataFrame([("a", 5), ("a", 5), ("a", 50)], "path string, line int")
    spans = spark.createDataFrame([("a", "outer", 1, 9), ("a", "inner", 4, 6)], "path string, name string, start int, end int")
    assert sorted((r.line, r.name) for r in readplan.innermost(probes, spans, ["path"]).collect() if r.name) == [(5, "inner")] * 2


def test_watched_files_as_a_stream(spark, tmp_path):
    rows = [("src/main/java/A.java", True), ("docs/A.java", True), ("x/pom.xml", True), ("src/main/java/node_modules/B.java", True), ("gradle/libs.versions.toml", False), ("x/settings.gradle", True)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(p, e, "2024-01-01T00:00:00") for p, e in rows], "path string, exists boolean, at string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    q = changes.file_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.uri, r.exists) for r in spark.table("seen").collect()) == [("file://gradle/libs.versions.toml", False), ("file://src/main/java/A.java", True), ("file://x/pom.xml", True)]


def test_scenarios(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id":"a","golden":{"mustHit":["x"],"shouldHit":["y","z"]}}\n\n{"id":"b","golden":{}}\n')
    got = tree.read_scenarios(spark, str(tmp_path / "s.jsonl"))
    assert sorted(tuple(r) for r in evaluation.golden_entries(got).collect()) == [("a", "must", "x"), ("a", "should", "y"), ("a", "should", "z")] and got.count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        tree.read_scenarios(spark, str(tmp_path / "bad.jsonl")).collect()
