"""Behaviour that the stand-in queries don't reach: arguments, nulls, parsing, matching, files, streams."""

import pytest
from pyspark.sql import functions as F

from gritmill.functions import guards, scalars
from gritmill.operators import graph, mining, text_search, vector_search
from gritmill.operators import index_queries as q
from gritmill.plans import rules as r
from gritmill.plans.pipeline import Pipeline
from gritmill.sources import extract, readers, sinks


def one(spark, column, **values):
    """The value of an expression over one row."""
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()) or "*")
    return row.select(column.alias("v")).collect()[0]["v"]


def test_page_arguments():
    assert q.clamp(-1, 0) == (0, 20) and q.clamp("x", 101) == (0, 100) and q.clamp(None, None) == (0, 20) and q.clamp("7", "5") == (7, 5)
    assert q.sanitise("a\x00b\tc\x7f") == "ab\tc"
    with pytest.raises(ValueError):
        q.sanitise("x" * 1001)


def test_prefixes_and_members(spark):
    df = spark.createDataFrame([(1, ["org.junit.Test", "java.util.List"]), (2, []), (3, None), (4, ["orgx"])], "id int, imports array<string>")
    got = lambda c: [x["id"] for x in df.where(c).orderBy("id").collect()]
    assert got(q.any_prefix("imports", "org.")) == [1] and got(q.any_prefix("imports", "", " ")) == [] and got(q.any_prefix("imports", "org")) == [1, 4]
    assert got(q.any_prefix("imports", *(f"p{i}" for i in range(50)), "org")) == []
    assert got(~q.member("imports", "orgx")) == [1, 2, 3]


def test_dead_code_rules(spark):
    rows = [(1, ["a.b.C"], ["x.Y"]), (2, ["x.Y"], []), (3, ["p.q.Z"], ["p.q.*"]), (4, ["p.q.r.W"], []), (5, ["Plain"], []), (6, ["", "u.V"], []), (7, ["k.L", "x.Y"], [])]
    df = spark.createDataFrame(rows, "id int, names array<string>, imports array<string>")
    assert sorted(x["id"] for x in q.dead_code(df, "id", "names", "imports").collect()) == [1, 4, 5, 6]


def test_api_diff_nulls_and_duplicates(spark):
    kind = "path string, id int, methods string, visibility string"
    a = spark.createDataFrame([("f", 1, "m", "public"), ("f", 2, "n", "public"), (None, 3, "x", None), ("gone", 4, "g", None)], kind)
    b = spark.createDataFrame([("f", 5, "n", "package"), ("new", 6, None, "public")], kind)
    got = {x["path"]: (x["change"], x["detail"]) for x in q.api_diff(a, b, "path", "id", {"methods": "methods", "visibility": "visibility"}).collect()}
    assert got == {"f": ("changed", "visibility"), "gone": ("removed", ""), "new": ("added", "")}
    assert {x["path"] for x in q.public_only(q.api_diff(a, b, "path", "id", {"methods": "methods", "visibility": "visibility"}), "visibility").collect()} == {"f", "new"}


def test_rank_fusion(spark):
    s, t = spark.createDataFrame([(1, 0), (2, 1), (None, 2)], "id int, rank int"), spark.createDataFrame([(3, 0), (2, 1)], "id int, rank int")
    assert [x["id"] for x in q.rank_fusion(s, t).collect()] == [2, 1, 3]
    assert [x["id"] for x in q.rank_fusion(s, t, top=2).collect()] == [2, 1]


def test_anchor_paging(spark):
    df = spark.createDataFrame([(t, i) for i, t in enumerate([5, 3, 3, 9])], "t int, id int")
    assert [x["id"] for x in q.after_anchor(df, ["t", "id"], "id", 1, 2).collect()] == [2, 0]
    assert [x["id"] for x in q.after_anchor(df, ["t", "id"], "id", None, 2).collect()] == [1, 2] and not q.after_anchor(df, ["t", "id"], "id", 77, 2).collect()


def test_purge_keeps_unknown(spark):
    kept, gone = q.purge(spark.createDataFrame([(1,), (None,), (5,)], "x int"), F.col("x") < 3)
    assert sorted((x["x"] or 0) for x in kept.collect()) == [0, 5] and gone.collect()[0]["deleted"] == 1


def test_scalars(spark):
    assert one(spark, scalars.camel_split(F.lit("parseXMLFast"))) == ["parse", "XMLFast"] and one(spark, scalars.camel_split(F.lit("XMLParser"))) == ["XMLParser"]
    path = lambda p: one(spark, scalars.project_name(F.lit(p)))
    assert path("proj/src/a/B.java") == "proj" and path("/src/B.java") is None and path("a/b/tst/C.java") == "b" and path("x.java") is None
    assert one(spark, scalars.line_count(F.lit(None).cast("string"))) == 0 and one(spark, scalars.line_count(F.lit("a\n"))) == 2
    assert one(spark, scalars.file_type(F.lit("a.b/c"))) == "b/c" and one(spark, scalars.file_type(F.lit("Makefile"), "text")) == "text"
    assert one(spark, scalars.suggest_name(F.lit("int[]"), F.lit("row"))) == "intArrayRow" and one(spark, scalars.suggest_name(F.lit("List<String>"), F.lit(""))) == "stringList"
    assert one(spark, scalars.resolve_type(F.lit("List<String>"), F.array(F.lit("java.util.List")), F.lit("p"))) == "java.util.List"
    assert one(spark, scalars.resolve_type(F.lit("Foo"), F.array(F.lit("java.util.List")), F.lit("p"))) == "p.Foo"
    assert one(spark, scalars.normalise_rule(F.lit(" a \r\n\r\n\tb"))) == "a\nb"
    assert one(spark, scalars.is_binary(F.lit(b"ab\x00"))) and not one(spark, scalars.is_binary(F.lit(b"\x10\x01")))
    assert one(spark, scalars.dsl_error(F.lit(None).cast("string"))) == "INVALID_DSL_RULE"
    assert one(spark, sinks.csv_field(F.lit('a "q", b'))) == '"a ""q"", b"' and one(spark, sinks.csv_field(F.lit(None))) == ""


def test_guard_truth_tables(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(rows, "l boolean, r boolean")
    guards.register_guard("left", lambda: F.col("l"))
    guards.register_guard("right", lambda: F.col("r"))
    got = [(x["a"], x["o"], x["n"]) for x in df.select(guards.parse_guard("left && right").alias("a"), guards.parse_guard("left() || right()").alias("o"), guards.parse_guard("!(left)").alias("n")).collect()]

    def both(a, b):
        return False if a is False or b is False else None if a is None or b is None else True

    def either(a, b):
        return True if a or b else None if a is None or b is None else False

    assert got == [(both(a, b), either(a, b), None if a is None else not a) for a, b in rows]
    state = df.select(guards.decide(F.col("l"), F.lit(True), True).alias("s"), guards.decide(F.col("l"), F.lit(True), False).alias("c")).distinct().collect()
    assert {tuple(x) for x in state} == {("match", "match"), ("no_match", "no_match"), ("unknown", "match")}
    for bad in ("left &&", "nosuch(1)", "(left", "left right"):
        with pytest.raises(ValueError):
            guards.parse_guard(bad)
    assert len(guards.GUARDS) > 60


def test_guards_on_bindings(spark):
    df = spark.range(1).select(F.create_map(F.lit("$x"), F.array(F.lit('"UTF-8"')), F.lit("$c"), F.array(F.lit("a.run(1)")), F.lit("$l$"), F.array(F.lit("p"), F.lit("q")), F.lit("$e"), F.array().cast("array<string>")).alias("bindings"), F.lit(11.0).alias("source_version"), F.array(F.lit("METHOD_DECLARATION"), F.lit("WHILE")).alias("ancestors"), F.lit("class T { x }").alias("method_text"))
    truth = {"isCharsetString($x)": True, "isStringLiteral($x)": True, "isSingleCharacter($x)": False, "isRegexp($x)": False, "matchesAny($x)": True, "matchesAny($none)": False, "matchesNone($e)": True, "hasNoSideEffect($c)": False, "hasNoSideEffect($x)": True, "methodNameMatches($c, \"r.n\")": True, "methodNameMatches($c, \"r\")": False, "argsCount($l$, 2)": True, "sourceVersionGE(1.8)": True, "sourceVersionBetween(17, 21)": False, "isInLoop": True, "isInConstructor": False, "contains(\"T {\")": True, "notContains(\"T {\")": False, "otherwise": True, "isLiteral($x), !isNullLiteral($x)": True}
    got = df.select(*(guards.parse_guard(g).alias(str(i)) for i, g in enumerate(truth))).collect()[0]
    assert dict(zip(truth, got, strict=True)) == truth
    assert df.select(guards.parse_guard("genericTypeIs($x, 0, T)").alias("v")).collect()[0]["v"] is None


RULES = """<!id: t.rules>
<!foreach T: Integer -> int, Long -> long>
@id: one
"Say it":
foo($a, $rest$, $z) :: argsCount($rest$, 1)
=> bar($z, $rest$, $a)
;;
$x == $x
=> true
;;
new ${T.key}($v)
=> ${T.key}.valueOf($v)
;;
log($m:StringLiteral)
;;
import a.b.C;
"""


def test_rule_files_parse():
    got = r.parse_rules(RULES, "t")
    assert [x.name for x in got] == ["one", "t2", "t3", "t4", "t5", "t6"] and got[0].message == "Say it" and got[0].guard == "argsCount($rest$, 1)"
    assert [x.pattern for x in got[2:4]] == ["new Integer($v)", "new Long($v)"] and got[2].alternatives[0].text == "Integer.valueOf($v)"
    assert [x.kind for x in got] == ["METHOD_CALL", "EXPRESSION", "CONSTRUCTOR", "CONSTRUCTOR", "METHOD_CALL", "IMPORT"]
    books = {"a": "<!include: b>\nx()\n;;\n", "b": "<!include: a>\ny()\n;;\n"}
    assert [x.pattern for x in r.parse_rules(books["a"], "a", books.get)] == ["y()", "x()"]
    kinds = {"int x = 1;": "DECLARATION", "return x;": "STATEMENT", "a(); b();": "STATEMENT_SEQUENCE", "private int x;": "FIELD", "class A {}": "TYPE_DECLARATION", "@Test": "ANNOTATION", "{ a(); }": "BLOCK", "void m() {}": "METHOD_DECLARATION", "a + b": "EXPRESSION"}
    assert {k: r.infer_kind(k) for k in kinds} == kinds


def test_rules_match_and_rewrite(spark):
    code = 'foo(1, b(2, 3), c);\nfoo(1, 2);\nif (p.q == p.q || r == s) { log("hi"); log(x); }\nnew Long(f(1)); // foo(9, 9, 9)\n'
    rules = r.parse_rules(RULES, "t")
    found = r.matches(spark.createDataFrame([("F.java", code), ("G.java", None), ("H.java", "")], "file_path string, text string"), "text", rules)
    got = {(x["rule_name"], x["matched"], x["replacement"]) for x in r.report(found, rules).collect()}
    assert ("one", "foo(1, b(2, 3), c)", "bar(c, b(2, 3), 1)") in got and not any(m == "foo(1, 2)" for _, m, _ in got)
    assert ("t4", "new Long(f(1))", "Long.valueOf(f(1))") in got and ("t5", 'log("hi")', None) in got and ("t2", "p.q == p.q", "true") in got
    assert not any(m in ("r == s", "log(x)", "foo(9, 9, 9)") for _, m, _ in got)
    assert {x["line"] for x in found.where("rule_name = 't4'").collect()} == {4}


def test_variadic_and_substitution():
    def m(pattern, text):
        found = r.match_at([t.group() for t in r.TOKEN.finditer(pattern)], [t for t, _, _ in r.lex(text)], 0)
        return found and found[1]

    assert m("f($a, $r$, $z)", "f(1, 2, 3, 4)") == {"$a": ["1"], "$r$": ["2", "3"], "$z": ["4"]} and m("f($a, $r$, $z)", "f(1, 4)") == {"$a": ["1"], "$r$": [], "$z": ["4"]}
    assert m("f($r$)", "f()") == {"$r$": []} and m("f($x, $x)", "f(a, b)") is None and m("f($x, $x)", "f(a.b, a.b)")
    bound = {"$x": ["v"], "$xs$": ["a", "b", "c"]}
    assert r.substitute("g($x, $xs$) $xs$[0] $xs$[-1] $xs$.length $y", bound) == "g(v, a, b, c) a c 3 $y"


def test_java_extraction():
    got = extract.extract_java('package p.q;\nimport java.util.List;\nimport static x.Y.z;\n/** Doc of A. */\n@Deprecated\npublic abstract class A extends B implements java.io.Closeable, C<D> {\n  private final List<String> xs = null;\n  public static void main(String[] args) { String s = "literal"; foo("ab"); }\n  int add(int a, List<Map<K, V>> b) { return 1; } // class Not {}\n}\nenum E { X }\n')
    assert got["package_name"] == "p.q" and got["declared_types"] == ["A", "E"] and got["fully_qualified_names"] == ["p.q.A", "p.q.E"] and got["import_statements"] == ["java.util.List", "x.Y.z"]
    assert got["extends_types"] == ["p.q.B"] and got["implements_types"] == ["java.io.Closeable", "p.q.C"] and got["annotations"] == ["Deprecated"] and got["visibility"] == "public abstract"
    assert got["declared_methods"] == ["main", "add"] and got["method_signatures"] == ["main(String[])", "add(int,List<Map<K, V>>)"] and got["declared_fields"] == ["xs"] and got["string_literals"] == ["literal"]
    assert got["has_main_method"] and got["type_documentation"] == "Doc of A."
    assert extract.search_tokens('@Foo int parseXML = 12; // gone') == ["foo", "int", "parsexml", "parse", "xml", "12"]
    assert extract.extract_java("")["declared_types"] == []


def test_text_extractors(spark):
    x = one(spark, extract.pom(F.lit("<groupId>g</groupId><artifactId> a </artifactId><artifactId>a</artifactId><module>m</module>")))
    assert (x["fqns"], x["types"], x["fields"]) == (["g", "a"], ["a"], ["m"])
    x = one(spark, extract.manifest(F.lit("Bundle-SymbolicName: b.c;singleton:=true\nExport-Package: p.a;version=\"1,2\",\n p.b\nRequire-Bundle: r.x\n")))
    assert (x["bundle"], x["exports"], x["imports"], x["requires"]) == ("b.c", ["p.a", "p.b"], [], ["r.x"])
    x = one(spark, extract.properties(F.lit("# c=1\nkey = a.b.Type\nother: x\nnone\n")))
    assert (x["fields"], x["fqns"]) == (["key", "other"], ["a.b.Type"])
    assert one(spark, extract.plugin_xml(F.lit('<extension point="a.b"><x class="c.D"/></extension>')))["fqns"] == ["a.b"]


def test_analyzers_and_search(spark):
    tokens = lambda kind, text: one(spark, text_search.ANALYZERS[kind](F.lit(text)))
    assert tokens("javaIdentifier", "parseXMLFile a1") == ["parsexmlfile", "parse", "xml", "file", "a1", "a", "1"] and tokens("javaPath", "src/FooBar.java") == ["src", "foo", "bar", "java"]
    assert tokens("commitMessage", "Fix the API") == ["fix", "api"] and tokens("dotQualifiedName", "a.b.C\na.D") == ["a b c\na d"] and tokens("javaSourceEcj", "int fooBar = 1; // no") == ["int", "foobar", "foo", "bar", "1"]
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma"), (4, None)], "id int, t string")
    assert [x["doc_id"] for x in text_search.search(df, "id", [("t", "commitMessage", 1.0)], "alpha beta").collect()] == [1, 2]
    assert one(spark, vector_search.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.7071, abs=1e-4)
    blank = F.lit(None).cast("string")
    text = spark.range(1).select(F.lit("N").alias("n"), blank.alias("d"), F.lit("m()").alias("m"), F.lit("").alias("p"))
    assert text.select(vector_search.embedding_text("n", "d", "m", "p").alias("t")).collect()[0]["t"] == "N\nMethods: m()"


def test_mining_rules(spark):
    hit = lambda s: one(spark, mining.relevant_message(F.lit(s).cast("string")))
    assert hit("REFACTOR it") and hit("use x instead") and hit("var x") and not hit("variable") and not hit(" ") and not hit(None)
    assert one(spark, mining.normalised_pattern(F.lit("$x.f($x1, $x)"))) == "#0#.f(#1#, #0#)"
    assert one(spark, mining.may_follow(F.lit("DISCOVERED"), F.lit("DSL_VALID"))) and not one(spark, mining.may_follow(F.lit("PROMOTED"), F.lit("REJECTED")))
    a = {"type": "call", "children": [{"type": "name", "text": "x"}, {"type": "lit", "text": "1"}]}
    b = {"type": "call", "children": [{"type": "name", "text": "x"}, {"type": "lit", "text": "2"}, {"type": "name", "text": "y"}]}
    assert mining.ast_diff(a, a) == ["IDENTICAL"] and mining.ast_diff(a, b) == ["IDENTICAL", "MODIFIED", "INSERTED"]
    assert mining.generalise("f(x, 1)", "g(x, 1)", [("x", False), ("1", True)]) == ("f($v, 1)", "g($v, 1)") and mining.generalise("a", "b", []) is None
    batch = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, True), (4, False, False), (5, True, False)], "n int, skipped boolean, evaluated boolean")
    anchor, left = mining.partial_batch(batch, "n", "skipped", "evaluated")
    assert anchor.collect()[0]["anchor"] == 2 and [x["n"] for x in left.collect()] == [4]


def test_duplicate_references_give_duplicate_gaps(spark):
    kind = "hash int, relevant boolean, light string, rule string, validation string, category string"
    ref = spark.createDataFrame([(1, True, "GREEN", "r", None, "c")] * 2 + [(2, True, "RED", None, None, None)], kind)
    mined = spark.createDataFrame([(1, True, "RED", "q", "bad guard", "d", 1), (1, True, "GREEN", " ", None, "c", 0)], kind + ", ord int")
    got = sorted((x["hash"], x["gap"]) for x in mining.compare(ref, mined).collect())
    assert got == sorted([(1, "WRONG_TRAFFIC_LIGHT"), (1, "GUARD_WISSEN"), (1, "CATEGORY_MISMATCH")] * 2 + [(2, "MISSED_RELEVANT")])


def test_closure_with_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {tuple(x) for x in graph.closure(pairs, lambda df: df.checkpoint()).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", y) for y in "abc"}


def test_pipeline_sources(spark):
    with pytest.raises(ValueError):
        Pipeline.range(spark, "1;5")
    assert Pipeline.range(spark, "5,2").count().collect()[0]["result"] == 0
    seen = []
    p = Pipeline.values(spark, [3, 1, 2], "x", "int").filter(F.col("x") > 1, "big ones").map(F.col("x") * 10, "y")
    p.sorted().foreach(lambda row: seen.append(row["y"]), ordered=True)
    assert seen == [20, 30] and "filter" in p.explain() and p.collect("JOINING", separator="-").collect()[0]["result"] == "20-30"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text("class A {}")
    (tmp_path / "src/b.txt").write_text("x")
    assert [x["text"] for x in readers.files(spark, str(tmp_path), "*.java").collect()] == ["class A {}"]
    (tmp_path / "a-candidate.json").write_text('{"id": "1", "revision": 2}')
    (tmp_path / "b-candidate.json").write_text("{broken")
    assert [x["id"] for x in readers.candidates(spark, str(tmp_path)).collect()] == ["1"]
    (tmp_path / "log").write_text("abc\tAnn\ta@x.y\t2024-01-02T03:04:05Z\tfix\tit\nbroken\n")
    assert readers.git_log(spark, str(tmp_path / "log")).collect()[0]["commit_message"] == "fix\tit"
    h = one(spark, readers.hunks(F.lit("@@ -1,2 +3 @@ x\n-a\n@@ -10 +11,4 @@\n")))
    assert [tuple(x) for x in h] == [(1, 2, 3, 1), (10, 1, 11, 4)]
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    assert sinks.markdown(df.limit(1)).splitlines()[-1] == '| 1 | a "q", b |'


def test_stream_equals_batch_and_reruns_add_nothing(spark, tmp_path):
    from gritmill.streaming.incremental import ingest

    first = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    at = lambda x: str(tmp_path / x)
    first.write.parquet(at("in"))
    assert ingest(spark, at("in"), first.schema, at("out"), at("ck"), "k") == 2
    assert ingest(spark, at("in"), first.schema, at("out"), at("ck"), "k") == 2
    spark.createDataFrame([(2, "again"), (3, "c")], first.schema).write.mode("append").parquet(at("in"))
    assert ingest(spark, at("in"), first.schema, at("out"), at("ck"), "k") == 3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_type", "user_id", "commits"] and set(e.oracle_sql()) <= set(e.queries())


def test_search_orders_rounded_scores(spark, tmp_path):
    from gritmill.operators import text_search as t

    # the shorter of two texts scores more, by less than a thousandth
    texts = spark.createDataFrame([(1, "x " + "pad " * 2001), (2, "x " + "pad " * 2000), (3, "pad")], "k long, t string")
    t.write_index(texts, "k", "t", "javaIdentifier", str(tmp_path / "index"))
    for digits, want in ((None, 2), (2, 1)):
        found = t.search(texts, "k", [("t", "javaIdentifier", 1.0)], "x", limit=1, digits=digits).collect(), t.search_index(spark, str(tmp_path / "index"), "x", "javaIdentifier", limit=1, digits=digits).collect()
        assert [[r["doc_id"] for r in rows] for rows in found] == [[want], [want]]
