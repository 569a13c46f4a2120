"""Paths, identifiers, facts and build files."""

from pyspark.sql import functions as F

from siftwright.functions import build, facts, paths, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column).first()[0]


def test_paths(spark):
    rows = [
        ("modules/pay/src/main/java/application/A.java", "pay", ":modules:pay", "main", "application"),
        ("apps/web/src/test/java/domain/interfaces/B.java", "web", ":apps:web", "test", "interfaces"),
        ("core/sub/src/main/java/vo/C.java", "core/sub", "core/sub", "main", "vo"),
        ("src/main/java/D.java", None, None, "main", None),
        ("README", None, None, None, None),
    ]
    out = paths.classified(spark.createDataFrame([(r[0],) for r in rows], "path string")).collect()
    assert [tuple(r) for r in out] == rows


def test_path_scalars(spark):
    df = spark.createDataFrame([("/a/b c/x.java", "file:///a/b%20c/x+y.java")], "p string, u string")
    got = df.select(
        paths.is_within(F.col("p"), "/a/b c"), paths.is_within(F.col("p"), "/a/b"), paths.relative(F.col("p"), "/a"), paths.uri_to_path(F.col("u")), paths.path_to_uri(F.col("p")),
        paths.is_ignored(F.lit("a/node_modules/b")), paths.is_ignored(F.lit("a/nodes/b")), paths.file_stem(F.col("p")), F.length(paths.repo_hash(F.col("p"))),
    ).first()
    assert tuple(got) == (True, False, "b c/x.java", "/a/b c/x+y.java", "file:///a/b%20c/x.java", True, False, "x", 12)


def test_identifiers(spark):
    df = spark.createDataFrame([("HTTPServerName", "findOrderById", "OrderServiceImpl", "  foo.bar(baz)")], "a string, b string, c string, d string")
    got = df.select(
        text.camel_to_snake(F.col("a")), text.action_tail_column(F.col("b")), text.class_stem_column(F.lit("OrderAppService")), text.class_stem_column(F.lit("Service")), text.token_at(F.col("d"), F.lit(8)),
        text.token_at(F.col("d"), F.lit(1)), text.simple_name(F.lit("a.b.List<c.D>")), text.simple_annotation(F.lit("@x.Service")), text.capitalize(F.lit("oRDER")), text.strip_line_comment(F.lit("a // b")),
        text.symbol_kind(F.lit(5)), text.symbol_kind(F.lit(99)), text.half_up(F.lit(-2.5)), text.clamp(F.lit(900.0), 1, 300, 80), text.clamp(F.lit(None).cast("double"), 1, 300, 80),
    ).first()
    assert tuple(got) == ("http_server_name", "OrderById", "Order", "Service", "bar", None, "List", "Service", "ORDER", "a ", "Class", "Kind99", -2, 300, 80)
    assert text.class_stem("OrderAppService") == "Order" and text.snake("HTTPServerName") == "http_server_name" and text.literal("a.b(c)") == r"a\.b\(c\)"


def test_keyword_ngrams(spark):
    words = F.transform(text.keyword_words(F.col("k")), text.capitalize)
    grams = one(spark, text.word_ngrams(words), k="userOrder-export x")
    assert [(g["stem"], g["word_count"]) for g in grams][:4] == [("User", 1), ("UserOrder", 2), ("UserOrderExport", 3), ("UserOrderExportX", 4)] and len(grams) == 10
    assert one(spark, F.size(text.word_ngrams(F.array().cast("array<string>"))), k="") == 0
    assert text.keyword_stems(["userOrder", "order export"]) == [("User", 1), ("UserOrder", 2), ("UserOrderExport", 3), ("Order", 1), ("OrderExport", 2), ("Export", 1)]


def test_matches_any(spark):
    assert one(spark, text.matches_any(F.col("p"), ["", "ORD"]), p="src/order/A") is True
    assert one(spark, text.matches_any(F.col("p"), [""]), p="src/order/A") is False


SOURCE = """package shop.order;

import x.Y;

@Service
@Table(name = "orders")
public class OrderService extends Base implements Port<A>, Other {
    public int size() {
        return 1;
    }

    private void open(int a,
                      int b) {
        if (a > b) {
            run();
        }
    }

    void hidden() {
    }

    public abstract int none();
}
"""


def test_java_facts(spark):
    row = facts.with_methods(facts.header_facts(spark.createDataFrame([("a/OrderService.java", SOURCE)], "path string, content string"))).first()
    assert (row.package_name, row.kind, row.type_name, row.extends_type) == ("shop.order", "class", "OrderService", "Base")
    assert row.implements_types == ["Port<A>", "Other"] and row.annotations == ["Service", "Table"]
    assert [tuple(m) for m in row.methods] == [("size", 8, 10), ("open", 12, 17)]
    empty = facts.header_facts(spark.createDataFrame([("x", "")], "path string, content string")).first()
    assert empty.type_name is None and empty.implements_types == []


def test_method_lines():
    cases = {
        "public int size() {": "size", "  @Override public List<A, B> x(int a)": "x", "private static <T extends X> T[] foo(": "foo", "public OrderService(": "OrderService",
        '  @Foo("a") @Bar protected final Map<String, List<X>> m (': "m", "void hidden()": None, "if (x) {": None, "public @N String foo(": None, "public static final int X = foo(3);": None, "return new Foo(": None,
    }
    assert {line: facts.method_name(line) for line in cases} == cases
    spans = lambda *lines: [(m["name"], m["line"], m["end_line"]) for m in facts.method_spans("\n".join(lines))]
    assert spans("public int a() { return 1; }", "public int b() {", "}") == [("b", 2, 3)]  # a semicolon before the block
    assert spans("public void a() {", *["x"] * 200) == [("a", 1, 80)] and spans("public void a() {", "x") == [("a", 1, 2)]
    assert spans("public void a(", *["int b,"] * 11, ") {", "}") == [] and spans("public void a(", *["int b,"] * 10, ") {", "}") == [("a", 1, 13)]
    assert spans("public void a() // {", "{ // }", "}") == [("a", 1, 3)]


def test_symbols_flatten_and_win(spark):
    tree = '[{"name":"A","kind":10,"range":{"start":{"line":0},"end":{"line":9}},"children":[{"name":"z","kind":6,"range":{"start":{"line":1},"end":{"line":0}}},{"name":"m","kind":9,"range":{"start":{"line":1},"end":{"line":3}}}]}]'
    documents = spark.createDataFrame([("p", tree), ("q", None), ("e", "[]")], "path string, symbols string")
    flat = facts.flatten_symbols(documents)
    assert [tuple(r) for r in flat.orderBy("seq").collect()] == [("p", 0, None, "A", 10, 1, 10), ("p", 1, 0, "z", 6, 2, 1), ("p", 2, 0, "m", 9, 2, 4)]
    old = spark.createDataFrame([(p, "Old", "class", [("r", 1, 2)]) for p in "pqe"], "path string, type_name string, kind string, methods array<struct<name:string,line:int,end_line:int>>")
    got = {r.path: (r.fact_source, r.type_name, r.kind, [tuple(m) for m in r.methods]) for r in facts.prefer_symbols(old, documents).collect()}
    assert got == {"p": ("documentSymbol", "A", "enum", [("m", 2, 4), ("z", 2, 2)]), "q": ("regex", "Old", "class", [("r", 1, 2)]), "e": ("documentSymbol", "Old", "class", [("r", 1, 2)])}


def files_of(spark, repos):
    return spark.createDataFrame([(r, p, c) for r, files in repos.items() for p, c in files.items()], "repo string, path string, content string")


def test_layouts(spark):
    repos = {
        "single": {"src/main/java/demo/A.java": "", "src/test/java/demo/B.java": "", "pom.xml": "<project></project>"},
        "reactor": {"exam-management/src/main/java/demo/A.java": "", "report/src/main/resources/x.yml": "", "pom.xml": "<modules><module>exam-management</module><module>report</module></modules>"},
        "gradle": {"modules/school/src/main/java/demo/A.java": "", "apps/admin/src/main/java/demo/B.java": "", "settings.gradle": "include"},
        "flat": {"lib/A.java": ""}, "plain gradle": {"settings.gradle.kts": "", "core/src/main/java/A.java": ""}, "deep": {"a/b/src/main/java/A.java": ""}, "children": {"pom.xml": "", "x/src/test/java/A.java": ""},
    }
    out = {r.repo: (r.layout, r.build_system, r.broad_roots) for r in build.layout(files_of(spark, repos)).collect()}
    assert out == {
        "single": ("single", "maven", ["."]), "reactor": ("maven-multi", "maven", ["exam-management", "report"]), "gradle": ("gradle-multi", "gradle", ["apps", "modules"]), "flat": ("flat-layers", "unknown", ["."]),
        "plain gradle": ("single", "gradle", ["core"]), "deep": ("flat-layers", "unknown", ["."]), "children": ("maven-multi", "maven", ["x"]),
    }


def test_jdk_requirements_and_resolution(spark):
    repos = {
        "m8": {"pom.xml": "<maven.compiler.source>1.8</maven.compiler.source><java.version>11</java.version>"}, "g25": {"build.gradle.kts": "languageVersion.set(JavaLanguageVersion.of(25))"},
        "rel": {"pom.xml": "<java.version>11</java.version><maven.compiler.release> 17 </maven.compiler.release>"}, "sdk": {".sdkmanrc": "java=12.0.2-tem"}, "ver": {".java-version": "temurin-17\n"},
        "tgt": {"build.gradle": "targetCompatibility = '1.8'"}, "jvm": {".mvn/jvm.config": "-Djava.version=9"}, "fight": {"pom.xml": "<java.version>12</java.version>", ".sdkmanrc": "java=17"},
        "fight exact": {"pom.xml": "<java.version>11</java.version>", ".sdkmanrc": "java=17"}, "none": {"pom.xml": "<x/>"}, "both": {"build.gradle": "VERSION_17", "build.gradle.kts": "VERSION_11"},
    }
    files = files_of(spark, repos)
    need = build.requirements(files)
    installed = spark.createDataFrame([("j11", 11), ("j17", 17), ("old", None)], "jdk string, major int")
    out = {r.repo: (r.source, r.required, r.status, r.jdk, r.runtime) for r in build.resolve_jdk(need, installed, files.select("repo")).collect()}
    assert out == {
        "m8": ("maven", 8, "degraded", "j11", "JavaSE-1.8"), "g25": ("gradle-toolchain", 25, "missing", None, "JavaSE-25"), "rel": ("maven", 17, "resolved", "j17", "JavaSE-17"), "sdk": ("sdkmanrc", 12, "missing", None, "JavaSE-12"),
        "ver": ("java-version", 17, "resolved", "j17", "JavaSE-17"), "tgt": ("gradle-toolchain", 8, "degraded", "j11", "JavaSE-1.8"), "jvm": ("mvn-jvm-config", 9, "degraded", "j11", "JavaSE-9"),
        "fight": ("maven", 12, "ambiguous", "j17", "JavaSE-12"), "fight exact": ("maven", 11, "resolved", "j11", "JavaSE-11"), "none": ("missing", None, "missing", None, None), "both": ("gradle-toolchain", 11, "resolved", "j11", "JavaSE-11"),
    }
    assert {r.repo: (r.source, r.status, r.required) for r in build.resolve_jdk(need, installed, files.select("repo"), 21).collect()}["none"] == ("fallback", "degraded", 21)


def test_generated_code(spark):
    repos = {
        "gradle": {"build.gradle.kts": 'annotationProcessor("org.projectlombok:lombok:1.18.42")\nannotationProcessor("org.mapstruct:mapstruct-processor:1.6.3")'},
        "maven": {"pom.xml": "<groupId>org.projectlombok</groupId><artifactId>lombok</artifactId>\n<version>1.18.4</version>"}, "auto": {"gradle/libs.versions.toml": "auto-value dagger"}, "none": {"pom.xml": "", "src/lombok.txt": "lombok"},
    }
    row = lambda **kw: {r.repo: (r.processors, r.enabled, r.source, r.lombok, r.semantics) for r in build.generated_code(files_of(spark, repos), **kw).collect()}
    assert row(lombok_versions=["1.18.42"]) == {
        "gradle": (["lombok", "mapstruct"], True, "auto", "enabled", "ok"), "maven": (["lombok"], True, "auto", "missing-agent", "incomplete"),
        "auto": (["auto-value", "dagger"], True, "auto", "not-detected", "ok"), "none": ([], False, "not-detected", "not-detected", "not-detected"),
    }
    assert row(override=True)["maven"][3:] == ("enabled", "ok") and row()["gradle"][3:] == ("missing-agent", "incomplete")
    versions = spark.createDataFrame([("l", "1.18.4"), ("l", "1.18.38"), ("l", "1.18.30")], "k string, version string")
    assert build.latest_version(versions, ["k"]).first().version == "1.18.38"
