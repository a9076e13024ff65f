"""Typed nodes, fluent queries, diffs and inference."""

from pyspark.sql import functions as F

from gritmill.operators import diffs as d
from gritmill.plans import nodes as n

CODE = """package p;
@SuppressWarnings("raw")
class A {
  @Deprecated int m(int a) {
    for (String s : xs) { System.out.println(s); }
    for (int i = 0; i < 3; i++) { if (i == 1) { foo(i, b.c()); } else if (i > 2) { return 1; } }
    while (true) { x.y().z("q"); }
    return (int) new Long(5).intValue();
  }
}
class B { void k() { foo(1); } }
"""


def frame(spark):
    return n.nodes(spark.createDataFrame([(1, CODE), (2, None), (3, "")], "file_id long, t string"), "file_id", "t").cache()


def texts(q):
    return [r["text"] for r in q.df.orderBy("file_id", "node_id").collect()]


def test_node_queries(spark):
    q = n.NodeQuery(frame(spark))
    assert texts(q.on("METHOD_CALL").when(n.named("println"), n.arg_count(1))) == ["System.out.println(s)"]
    assert [r["name"] for r in q.on("METHOD_CALL").inside("ENHANCED_FOR").df.collect()] == ["println"]
    assert texts(q.on("METHOD_CALL").when(n.named("foo")).not_inside("FOR")) == ["foo(1)"]
    assert [r["kind"] for r in q.on("FOR", "WHILE").when(n.infinite()).df.collect()] == ["WHILE"]
    assert len(texts(q.on("IF").when(n.has_else_if()))) == 1
    assert [r["name"] for r in q.on("METHOD_CALL").when(n.chained()).df.collect()] == ["z"]
    assert {r["name"] for r in q.on("METHOD_DECLARATION").df.collect()} == {"m", "k"} and {r["name"] for r in q.on("TYPE_DECLARATION").df.collect()} == {"A", "B"}
    assert texts(q.on("INFIX").when(n.operator_in(n.COMPARISON))) == ["i < 3", "i == 1", "i > 2"]
    assert texts(q.on("CONSTRUCTOR")) == ["new Long(5)"] and len(texts(q.on("CAST"))) == 1
    assert [r["name"] for r in q.on("METHOD_DECLARATION").containing(q.on("WHILE").df).df.collect()] == ["m"]
    assert [r["name"] for r in q.on("METHOD_DECLARATION").not_containing(q.on("WHILE").df).df.collect()] == ["k"]
    assert texts(q.on("METHOD_CALL").when(n.named("foo")).not_suppressed("raw")) == ["foo(1)"]
    got = q.on("METHOD_CALL").first_handled(print=n.named("println"), any=n.arg_count(1))
    assert {(r["name"], r["handled"]) for r in got.collect()} >= {("println", "print"), ("z", "any")}
    rows = {r["node_id"]: r for r in q.df.where("file_id = 1").collect()}
    assert all(r["parent_id"] is None or (rows[r["parent_id"]]["start"] <= r["start"] and r["end"] <= rows[r["parent_id"]]["end"]) for r in rows.values())
    assert all(CODE[r["start"] : r["end"]] == r["text"] and CODE.count("\n", 0, r["start"]) + 1 == r["line"] for r in rows.values())


def test_type_facts(spark):
    row = spark.range(1).select(n.type_facts(F.lit("java.util.List<Map<K, V>, X>[]")).alias("t")).collect()[0]["t"]
    assert (row["simple"], row["list"], row["dimensions"], row["arguments"]) == ("List", True, 1, ["Map<K, V>", "X"])


def test_commit_diffs(spark):
    kind = "commit string, path string, text string"
    a = spark.createDataFrame([("c", "a/x", "1\n2\n"), ("c", "a/old", "same"), ("c", "b/y", "q")], kind)
    b = spark.createDataFrame([("c", "a/x", "1\n3\n"), ("c", "a/new", "same"), ("c", "b/y", "r"), ("e", "a/z", "z")], kind)
    got = {r["commit"]: r["diff"] for r in d.commit_diffs(a, b, "a/").collect()}
    assert "rename from a/old\nrename to a/new" in got["c"] and "-2\n+3" in got["c"] and "b/y" not in got["c"] and "+z" in got["e"]
    assert {r["diff"] for r in d.commit_diffs(a, b, "a/", max_files=1).where("commit = 'c'").collect()} == {""}
    assert d.unified("a\n" * 9, "b\n" * 9, "p", max_lines=5).endswith("more lines")


def test_refine_and_infer(spark):
    hunks = spark.createDataFrame([("f", 0, 2, 1, 2, 1)], "key string, hunk int, before_start int, before_count int, after_start int, after_count int")
    kind = "key string, start int, end int, text string"
    before = spark.createDataFrame([("f", 1, 9, "{ all }"), ("f", 2, 2, "new Integer(x)"), ("f", 5, 5, "z")], kind)
    after = spark.createDataFrame([("f", 1, 9, "{ all }"), ("f", 2, 2, "Integer.valueOf(x)")], kind)
    rows = d.pairs(d.refine(hunks, before, "before"), d.refine(hunks, after, "after"))
    assert [(r["before"], r["after"]) for r in rows.collect()] == [("new Integer(x)", "Integer.valueOf(x)")]
    got = d.inferred_rules(rows).collect()[0]
    assert "$v" in got["pattern"] and 0 < got["confidence"] <= 1
    assert d.infer("a", "a") is None and d.infer('foo(x, "k")', 'bar(x, "k")')[:2] == ('foo($v, "k")', 'bar($v, "k")')


def test_sequences_and_nullness(spark):
    df = spark.createDataFrame([("int a = b; f(a, b);",), ("int x = y; f(x, y);",), ("int x = y; f(y, x);",)], "t string")
    got = [r["c"] for r in df.select(d.canonical_sequence("t").alias("c")).collect()]
    assert got[0] == got[1] != got[2]
    rows = spark.createDataFrame([("new A()", None, "", []), ("m.get(k)", None, "", []), ("v", "null", "", []), ("w", None, "if (w != null)", []), ("u", None, "", ["Nullable"]), ("t", None, "", [])], "e string, i string, c string, a array<string>")
    assert [r["s"]["status"] for r in rows.select(d.nullness("e", "i", "c", "a").alias("s")).collect()] == ["NON_NULL", "NULLABLE", "NULLABLE", "POTENTIALLY_NULLABLE", "NULLABLE", "UNKNOWN"]


def test_guards_about_surroundings(spark):
    """Every guard runs through a report; those about roles of a wider plan have nothing to hold for."""
    from gritmill.functions.guards import GUARDS, guard_names
    from gritmill.plans import rules as r

    calls = {"sourceVersionGE": '"1.8"', "sourceVersionLE": "8", "sourceVersionBetween": "8, 11", "mode": "strict", "contains": '"x"', "notContains": '"x"', "inClass": '"A"', "inPackage": '"p"', "parentMatches": '"foo"', "paramCount": "1", "hasReturnType": '"int"', "throwsException": "", "hasField": '"f"', "classOverrides": '"m"', "enclosingClassExtends": '"Base"', "containsAnnotation": '"Deprecated"', "hasSuppressWarnings": '"raw"'}
    plain = ("otherwise", "isInLoop", "isInConstructor", "isInTryWithResourceBlock", "isPassedToMethod", "isAssignedToLocalVariable", "isResourceVariable", "inSerializableClass")
    text = "".join(f"@id: {g}\nfoo($a$) :: {g}({calls.get(g, '' if g in plain else '$a$, 1, 2')})\n;;\n" for g in GUARDS if g not in ("isSingleCharacter",) and not g.startswith(("planned", "enclosingPlanned")) and g not in ("isNullable", "genericTypeIs"))
    text += '@id: role\nfoo($a$) :: plannedRole("x") || plannedRelationCount("x", 1) || plannedValue("a", "b")\n;;\n@id: nullable\nfoo($a$) :: isNullable($a$, 5)\n;;\n@id: generic\nfoo($a$) :: genericTypeIs($a$, 0, "X")\n;;\n'
    rules = r.parse_rules(text.replace("hasNoSideEffect($a$, 1, 2)", "hasNoSideEffect($a$)"))
    rules = [x for x in rules if "$a$, 1, 2" not in (x.guard or "") or x.name in ("matchesAny", "matchesNone")] + [x for x in r.parse_rules("".join(f"@id: {g}\nfoo($a$) :: {g}({a})\n;;\n" for g, a in (("isStatic", "$a$"), ("hasModifier", '$a$, "final"'), ("isLiteral", "$a$"), ("isField", "$a$"), ("instanceof", '$a$, "int"'), ("argsCount", "$a$, 2"), ("referencedIn", "$a$, $a$"))))]
    found = r.matches(spark.createDataFrame([(1, CODE), (2, None)], "file_id long, t string"), "t", rules, ("file_id",))
    got = {}
    for row in r.report(found, rules).collect():
        got.setdefault(row["rule_name"], set()).add(row["line"])
    assert got["otherwise"] == {6, 11} and got["isInLoop"] == {6} and got["inClass"] == {6} and got["inPackage"] == {6, 11}
    assert got["hasReturnType"] == {6} and got["containsAnnotation"] == {6} and got["hasSuppressWarnings"] == {6} and got["argsCount"] == {6}
    assert got["nullable"] == {6, 11} and "role" not in got and "generic" not in got and "isInConstructor" not in got
    assert guard_names('a($x) && isInLoop || $x instanceof List') == ["isInLoop", "instanceof"]


def test_declarations():
    from gritmill.plans.context import FOUND, Context

    code = "package a.b;\nclass C<T extends D> extends E<F, G> implements H {\n  static final int[] xs = {1};\n  <R> R m(final int a, Map<K, List<V>> b, String... c) throws I, J { int[] q = b(a, xs); Runnable r = new Runnable() { public void run() { b(q); } }; return null; }\n  C() { b(this.xs); }\n}\nenum Z { P, Q; int n; }\n"
    c = Context(code)

    def at(text, **bindings):
        return dict(zip(FOUND, c.around(code.index(text), code.index(text) + len(text), {f"${k}": [v] for k, v in bindings.items()}), strict=True))

    one = at("b(a, xs)", a="a", x="xs", b="b", u="nowhere")
    assert (one["package_name"], one["class_name"], one["supertypes"], one["fields"], one["methods"]) == ("a.b", "a.b.C", ["E", "H"], ["xs"], ["m"])
    assert (one["return_type"], one["parameters"], one["thrown"], one["parent_kind"]) == ("R", ["int", "Map<K,List<V>>", "String..."], ["I", "J"], "LOCAL_VARIABLE")
    assert one["element_kinds"] == {"$a": "PARAMETER", "$x": "FIELD", "$b": "PARAMETER"} and one["modifiers"]["$x"] == ["static", "final"] and one["types"]["$b"] == ["Map<K,List<V>>", "Map"]
    assert at("b(q)", q="q")["element_kinds"] == {"$q": "LOCAL_VARIABLE"}
    two = at("b(this.xs)", x="this.xs")
    assert two["return_type"] == "" and two["element_kinds"] == {"$x": "FIELD"} and "CONSTRUCTOR_DECLARATION" in two["ancestors"]
    assert Context("").around(0, 0, {})[0] == "" and Context("class").types == [] and Context("class A { void m( {").types[0].name == "A"


def test_scored_markdown_and_state(spark, tmp_path):
    from gritmill.operators import mining_state as st
    from gritmill.queries.state import _scored
    from gritmill.sources import reports

    rows = _scored(spark, "/root/testdata/sf0.001").where("line < 12")
    page = reports.scored_markdown(rows, "2024-01-01").split("\n")
    assert page[0] == "# Refactoring Mining Report — 2024-01-01" and page[2] == "## Summary"
    sizes = {r["line"]: r["score"]["trivial_change"] for r in rows.collect()}
    warnings = page[page.index(next(x for x in page if x.startswith("## ⚠️"))) :]
    listed = [int(x.split("`")[1].split(":")[1]) for x in warnings[: warnings.index("", 4)] if x.startswith("- `")]
    assert listed and [sizes[i] for i in listed] == sorted((sizes[i] for i in listed), reverse=True)
    path = str(tmp_path / "state")
    for n in (1, 2, 3):
        st.save_state(spark.createDataFrame([("repo", n)], "repo string, epoch int"), path)
        assert [r["epoch"] for r in st.load_state(spark, path, "repo string, epoch int").collect()] == [n]
    assert st.allowed(rows, None) is rows
    assert {x: st.verify(x, "f(1)", "g(1)", "h(1)") for x in ("f($x)\n=> g($x)\n;;", "f($x)\n=> g($x)", "")} == {"f($x)\n=> g($x)\n;;": None, "f($x)\n=> g($x)": "DSL_VALIDATION", "": "SCHEMA"}


def test_matches_share_work_of_equal_patterns(spark, monkeypatch):
    from gritmill.plans import rules as r

    rules = r.parse_rules("".join(f"@id: r{i}\nuse($a, $b)\n;;\n" for i in range(20)) + "@id: other\ncall($a)\n;;\n")
    tried, one = [], r.match_at
    monkeypatch.setattr(r, "match_at", lambda pattern, *rest: (tried.append(pattern), one(pattern, *rest))[1])
    assert len(list(r.find("void f() { use(x, y); call(z); use(p, q); }", r.plan(rules)))) == 41
    assert len(tried) == 3
    # one file of sources is dealt out, as it would be one task
    texts = spark.range(0, 40, 1, 1).selectExpr("id", "if(id % 2 = 0, concat('class A { void f() { use(x', id, ', y); } }'), null) AS t")
    found = r.matches(texts, "t", rules, ("id",), context=True)
    assert found.rdd.getNumPartitions() > 1
    assert {(x["id"], x["rule"], x["rule_name"], x["kind"], x["bindings"]["$a"][0], x["method_text"]) for x in found.collect()} == {(k, i, f"r{i}", "METHOD_CALL", f"x{k}", f"void f() {{ use(x{k}, y); }}") for k in range(0, 40, 2) for i in range(20)}


def test_commit_diffs_of_many_files(spark):
    rows = spark.range(60).selectExpr("if(id < 3, 'few', 'many') AS commit", "concat('f', id) AS path", "concat('old ', id) AS text")
    out = d.commit_diffs(rows, rows.withColumn("text", F.concat(F.lit("new "), "path")))
    got = {r["commit"]: r["diff"] for r in out.collect()}
    assert got["many"] == "" and got["few"].count("--- a/") == 3 and len(got) == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftAnti" in plan
    nameless = spark.range(3).selectExpr("CAST(null AS STRING) AS commit", "concat('f', id) AS path", "'x' AS text")
    assert [r["diff"] for r in d.commit_diffs(nameless.limit(0), nameless, max_files=2).collect()] == [""]


def test_commit_diffs_tells_every_file(spark, tmp_path):
    from gritmill.queries.functions import sources
    from gritmill.queries.rules import commit_diffs

    # all parts in one commit, of more files than the operator's own limit
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_partkey", F.col("p_partkey") * 50).write.parquet(str(tmp_path / "part.parquet"))
    files = sorted((r["path"], r["text"].splitlines()) for r in sources(spark, str(tmp_path)).collect())
    told = ["\n".join([f"--- a/{p}", f"+++ b/{p}", "@@ -4,6 +4,6 @@", *(f" {x}" for x in t[3:6]), f"-{t[6]}", f"+{t[6].replace('int n', 'long n')}", *(f" {x}" for x in t[7:])]) for p, t in files]
    assert len(told) > 50 and [tuple(r) for r in commit_diffs(spark, str(tmp_path)).collect()] == [("0", "\n".join(told))]
    # long files and lines are whole, and so is a commit without a name
    lines = [f"{i} {'x' * 700}" for i in range(600)]
    rows = spark.createDataFrame([(None, "f", "\n".join(lines))], "commit string, path string, text string")
    got = [r["diff"] for r in d.commit_diffs(rows.limit(0), rows, max_files=None).collect()]
    assert got == ["\n".join(["--- /dev/null", "+++ b/f", "@@ -0,0 +1,600 @@", *(f"+{x}" for x in lines)])]
    # of copies that move, the first gives the name and the others are removals
    copies = [spark.createDataFrame([("c", f"{side}/{i}", "same") for i in range(3)], "commit string, path string, text string") for side in "ab"]
    removed = [f"--- a/a/{i}\n+++ /dev/null\n@@ -1 +0,0 @@\n-same" for i in (1, 2)]
    assert [r["diff"] for r in d.commit_diffs(*copies, max_files=None).collect()] == ["\n".join(removed + [f"rename from a/0\nrename to b/{i}" for i in range(3)])]
