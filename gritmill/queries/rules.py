"""Rules, guards and statement windows."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.functions.guards import decide, parse_guard
from gritmill.operators import mining as m
from gritmill.plans import rules as r
from gritmill.queries.functions import sources
from gritmill.sources.readers import tables

#: A rule file over the made-up compilation units.
RULES = """
<!name: shop>
@id: print-to-log
"Use a logger":
System.out.println($msg) :: isStringLiteral($msg)
=> LOG.info($msg)
;;
@id: size-call
$recv.size() :: matchesAny($recv)
=> $recv.length() :: matchesNone($recv, "xs")
=> count($recv) :: otherwise
;;
@id: any-call
new $t($args$)
=> create($args$)
;;
@id: deprecated
@Deprecated
;;
"""

#: Keyword rules over texts, as patterns.
KEYWORD_RULES = {"license": "[Ll]icense", "secret": 'token = "[0-9a-f]+"', "symbols": "[#*$%&]{3}", "mail": "@mail[0-9]"}


def rules():
    return r.parse_rules(RULES, "shop.hint")


def found(spark, d):
    return r.matches(sources(spark, d), "text", rules(), ("p_partkey", "path"))


#: Where the rules match in a unit of `sources`, by line from 1: rule, text, replacement.
_FOUND = """SELECT p_partkey, 'shop/src/p/Part' || p_partkey || '.java' AS path, r.* FROM part, LATERAL (VALUES
('print-to-log', 8, 'System.out.println("hello world")', 'LOG.info("hello world")', '{"$msg":["\\"hello world\\""]}'), ('size-call', 7, 'xs.size()', 'count(xs)', '{"$recv":["xs"]}'),
('any-call', 8, 'new Part' || p_partkey || '()', 'create()', '{"$t":["Part' || p_partkey || '"],"$args$":[]}'), ('deprecated', 7, '@Deprecated', NULL, '{}')) r(rule_name, line, matched, replacement, bindings)"""


@register("rule_match", f"SELECT p_partkey, path, rule_name, line, matched, bindings FROM ({_FOUND})")
def rule_match(spark, d):
    return found(spark, d).withColumn("bindings", F.to_json("bindings")).select("p_partkey", "path", "rule_name", "line", "matched", "bindings")


@register("rule_report", f"SELECT path, rule_name, line, matched, replacement, 'match' AS outcome FROM ({_FOUND})")
def rule_report(spark, d):
    return r.report(found(spark, d), rules()).select("path", "rule_name", "line", "matched", "replacement", "outcome")


_HITS = "SELECT doc_id, source, r.name AS rule_name, len(regexp_extract_all(text, r.pattern)) AS hits FROM documents, (VALUES " + ", ".join("('{}', '{}')".format(k, v) for k, v in KEYWORD_RULES.items()) + ") r(name, pattern) WHERE regexp_matches(text, r.pattern)"


def _hits(spark, d):
    """All rules in one scan: a literal array of (rule, hits) per text, exploded where there are hits."""
    each = F.array(*(F.struct(F.lit(k).alias("rule_name"), F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long").alias("hits")) for k, p in KEYWORD_RULES.items()))
    return tables(spark, d, "documents").select("doc_id", "source", F.explode(F.filter(each, lambda x: x["hits"] > 0)).alias("x")).select("doc_id", "source", "x.*")


@register("rule_scan", _HITS)
def rule_scan(spark, d):
    return _hits(spark, d)


@register("match_report", f"SELECT source, count(DISTINCT doc_id) AS files, sum(hits)::BIGINT AS matches, count(DISTINCT rule_name) AS rules FROM ({_HITS}) GROUP BY source")
def match_report(spark, d):
    return _hits(spark, d).groupBy("source").agg(F.countDistinct("doc_id").alias("files"), F.sum("hits").alias("matches"), F.countDistinct("rule_name").alias("rules"))


@register("rule_usage", f"SELECT r.name AS rule_name, count(h.rule_name) AS uses, CASE WHEN count(h.rule_name) = 0 THEN 'REMOVE' WHEN count(h.rule_name) >= 5 THEN 'PROMOTE' ELSE 'KEEP' END AS advice FROM (VALUES ('license'), ('secret'), ('symbols'), ('mail'), ('never')) r(name) LEFT JOIN ({_HITS}) h ON h.rule_name = r.name GROUP BY r.name")
def rule_usage(spark, d):
    return m.rule_usage(spark.createDataFrame([(x,) for x in [*KEYWORD_RULES, "never"]], "rule_name string"), _hits(spark, d))


_GROUPED = "'#0#.' || lower(split_part(p_type, ' ', 1)) || '(#1#)'"


@register("rule_groups", f"SELECT pattern, count(*) AS size, round(least(1.0, max(c) + least(0.1, 0.02 * (count(*) - 1))), 6) AS confidence FROM (SELECT {_GROUPED} AS pattern, p_size / 60 AS c FROM part) GROUP BY pattern")
def rule_groups(spark, d):
    p = tables(spark, d, "part")
    pattern = F.concat(F.lit("$"), F.lower(F.substring_index("p_brand", "#", 1)), F.lit("."), F.lower(F.substring_index("p_type", " ", 1)), F.lit("($"), F.lower(F.substring_index("p_brand", "#", 1)), F.lit("1)"))
    return m.rule_groups(p.select(pattern.alias("pattern"), (F.col("p_size") / 60).alias("c")), "pattern", "c").withColumn("confidence", F.round("confidence", 6))


_L = "CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END"
_R = "CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"


def _kleene(spark, d):
    return tables(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_L).alias("l"), F.expr(_R).alias("r"))


@register("guard_kleene", f"SELECT l_orderkey, l_linenumber, l_partkey, l AND r AS both, l OR r AS either, NOT l AS neither FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_L} AS l, {_R} AS r FROM lineitem)")
def guard_kleene(spark, d):
    return _kleene(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l") & F.col("r")).alias("both"), (F.col("l") | F.col("r")).alias("either"), (~F.col("l")).alias("neither"))


@register("guard_policy", f"SELECT required, outcome, count(*) AS n FROM (SELECT true AS required, CASE WHEN l AND r THEN 'match' WHEN NOT (l AND r) THEN 'no_match' ELSE 'unknown' END AS outcome FROM (SELECT {_L} AS l, {_R} AS r FROM lineitem) UNION ALL SELECT false, CASE WHEN coalesce(l AND r, true) THEN 'match' ELSE 'no_match' END FROM (SELECT {_L} AS l, {_R} AS r FROM lineitem)) GROUP BY required, outcome")
def guard_policy(spark, d):
    k = _kleene(spark, d)
    strict = k.select(F.lit(True).alias("required"), decide(F.col("l") & F.col("r"), F.lit(True), True).alias("outcome"))
    return strict.union(k.select(F.lit(False), decide(F.col("l") & F.col("r"), F.lit(True), False))).groupBy("required", "outcome").agg(F.count("*").alias("n"))


@register("guard_call", "SELECT p_partkey, (p_type LIKE '%STEEL%' OR p_size >= 30) AND NOT p_name IN ('x', 'y') AS ok FROM part")
def guard_call(spark, d):
    rows = tables(spark, d, "part").select("p_partkey", F.create_map(F.lit("$n"), F.array("p_name")).alias("bindings"), F.col("p_type").alias("method_text"), F.col("p_size").alias("source_version"))
    return rows.select("p_partkey", parse_guard('(contains("STEEL") || sourceVersionGE(30)) && !matchesAny($n, "x", "y")').alias("ok"))


def _calls(spark, d, text):
    return tables(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("source_version"), F.concat(F.lit("f("), text, F.lit(");")).alias("text"))


#: The first alternative whose condition holds is taken.
ALTERNATIVES = """
@id: pick
f($n)
=> big($n) :: sourceVersionGE(41)
=> eleven($n) :: matchesAny($n, "Brand11")
=> other($n) :: otherwise
;;
"""


@register("first_alternative", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'big' END, CASE WHEN p_brand = 'Brand#11' THEN 'eleven' END, 'other') || '(' || replace(p_brand, '#', '') || ')' AS pick FROM part")
def first_alternative(spark, d):
    rules = r.parse_rules(ALTERNATIVES)
    found = r.matches(_calls(spark, d, F.replace("p_brand", F.lit("#"), F.lit(""))), "text", rules, ("p_partkey", "source_version"))
    return r.report(found, rules).select("p_partkey", F.col("replacement").alias("pick"))


@register("stmt_window", "SELECT conv_id, turn AS first, [role, r2, r3] AS items FROM (SELECT conv_id, turn, role, lead(role, 1) OVER w AS r2, lead(role, 2) OVER w AS r3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE r3 IS NOT NULL")
def stmt_window(spark, d):
    return r.windows(tables(spark, d, "conversations"), "conv_id", "turn", "role", 3)


_LISTED = "string_split(p_name || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_type ELSE ' ' || p_type || ' x y' END, ' ')"


@register("variadic", f"SELECT p_partkey, w[1] AS a, w[2:len(w) - 1] AS rest, w[len(w)] AS z FROM (SELECT p_partkey, {_LISTED} AS w FROM part)")
def variadic(spark, d):
    more = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), "p_type")).otherwise(F.concat(F.lit(" "), "p_type", F.lit(" x y")))
    found = r.matches(_calls(spark, d, F.replace(F.concat("p_name", more), F.lit(" "), F.lit(", "))), "text", r.parse_rules("f($a, $rest$, $z)\n;;\n"), ("p_partkey",))
    b = F.col("bindings")
    return found.select("p_partkey", b["$a"][0].alias("a"), b["$rest$"].alias("rest"), b["$z"][0].alias("z"))


@register("rule_fqn", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'java.nio.file.Paths.get(a)' ELSE 'Paths.get(a)' END AS matched, 'Path.of(a)' AS replacement FROM part WHERE p_size % 5 < 4")
def rule_fqn(spark, d):
    """A qualified pattern, against sources that name the type in full, import it, import its package, lie in it, or know another one."""
    kinds = ("class A { Path p = java.nio.file.Paths.get(a); }", "import java.nio.file.Paths;\nclass A { Path p = Paths.get(a); }", "import java.nio.file.*;\nclass A { Path p = Paths.get(a); }", "package java.nio.file;\nclass A { Path p = Paths.get(a); }", "import other.Paths;\nclass A { Path p = Paths.get(a); }")
    p = tables(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 5 + 1).cast("int")).alias("text"))
    rules = r.parse_rules("@id: paths\njava.nio.file.Paths.get($x)\n=> Path.of($x)\n;;\n")
    return r.report(r.matches(p, "text", rules, ("p_partkey",)), rules).select("p_partkey", "matched", "replacement")


@register("rule_suppressed", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0")
def rule_suppressed(spark, d):
    """Matches of a rule, without those in methods that suppress it."""
    rules = r.parse_rules("@id: unused\nuse($f, $p, $l)\n;;\n")
    found = r.matches(surroundings(spark, d), "text", rules, ("p_partkey",), context=True)
    return r.report(found, rules, suppress="rule_name").select("p_partkey")


#: Guards about a match's surroundings, one a rule, and when each holds for the units of `surroundings`.
SURROUNDINGS = {
    "loop": ("isInLoop()", "p_partkey % 3 <> 2"),
    "no_loop": ("!isInLoop()", "p_partkey % 3 = 2"),
    "static": ("isStatic($f)", "p_partkey % 3 = 0"),
    "final": ('hasModifier($f, "final")', "p_partkey % 3 = 0"),
    "protected": ("isProtected($f)", "p_partkey % 3 <> 0"),
    "kinds": ("isField($f) && isParameter($p) && !isLocalVariable($p)", "true"),
    "kind": ('elementKindMatches($l, "PARAMETER")', "true"),
    "type": ('$l instanceof List', "p_partkey % 2 = 0"),
    "subtype": ('subtypeOf($l, "Set")', "p_partkey % 2 = 1"),
    "extends": ('enclosingClassExtends("Base")', "p_partkey % 2 = 0"),
    "serial": ("inSerializableClass()", "p_partkey % 2 = 0"),
    "throws": ('throwsException("IOException")', "p_partkey % 4 = 0"),
    "throws_any": ("throwsException()", "p_partkey % 4 = 0"),
    "returns": ('hasReturnType("int")', "p_partkey % 5 <> 0"),
    "package": ('inPackage("shop.p3")', "p_partkey % 7 = 3"),
    "class": ('inClass("Part11")', "p_partkey = 11"),
    "annotated": ('containsAnnotation("Deprecated")', "p_partkey % 5 <> 0"),
    "suppressed": ('hasSuppressWarnings("unused")', "p_partkey % 5 = 0"),
    "deprecated": ("isDeprecated($f)", "p_partkey % 4 = 1"),
    "params": ("paramCount(2)", "true"),
    "method": ('contains("while")', "p_partkey % 3 = 1"),
    "no_method": ('notContains("while")', "p_partkey % 3 <> 1"),
    "field": ('hasField("NAME") && !hasField("OTHER")', "true"),
    "members": ('classOverrides("m")', "true"),
    "constructor": ("isInConstructor()", "false"),
    "resource": ("isInTryWithResourceBlock()", "false"),
    "version": ("sourceVersionGE(11) && sourceVersionLE(40)", "p_size BETWEEN 11 AND 40"),
    "between": ("sourceVersionBetween(11, 20)", "p_size BETWEEN 11 AND 20"),
    "mode": ('mode("strict")', "false"),
    "planned": ('plannedRole("x") || plannedValue("a", "b") || plannedRelation("r")', "false"),
    "parent": ('parentMatches("NAME")', "true"),
}


def surroundings(spark, d):
    """Compilation units whose surroundings differ, one a part."""
    k, pick = F.col("p_partkey"), lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    code = F.format_string(
        'package shop.p%d;\nclass Part%d %s {\n  %s String NAME = "a";\n  %s m(int a, %s xs) %s {\n    %s { use(NAME, a, xs); }\n    int got = call(a);\n  }\n}\n',
        k % 7, k, pick(2, "extends Base implements Serializable", ""), F.concat(pick(4, "", "@Deprecated ", "", ""), pick(3, "private static final", "protected", "protected")),
        pick(5, '@SuppressWarnings("unused") void', *['@Deprecated int'] * 4), pick(2, "List<String>", "java.util.Set<String>"), pick(4, "throws IOException", "", "", ""), pick(3, "for (String s : xs)", "while (a > 0)", "synchronized (this)"),
    )
    return tables(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("source_version"), code.alias("text"))


_SURROUNDING_RULES = "".join(f"@id: {name}\nuse($f, $p, $l) :: {guard}\n;;\n" for name, (guard, _) in SURROUNDINGS.items()) + "@id: assigned\ncall($a) :: isAssignedToLocalVariable()\n;;\n"


@register("guard_context", "SELECT p_partkey, name AS rule_name FROM part, (VALUES " + ", ".join(f"('{k}')" for k in [*SURROUNDINGS, "assigned"]) + ") r(name) WHERE CASE name " + " ".join(f"WHEN '{k}' THEN {when}" for k, (_, when) in SURROUNDINGS.items()) + " ELSE true END")
def guard_context(spark, d):
    rules = r.parse_rules(_SURROUNDING_RULES)
    found = r.matches(surroundings(spark, d), "text", rules, ("p_partkey", "source_version"))
    return r.report(found, rules).where("outcome = 'match'").select("p_partkey", "rule_name")


@register("overlapping_lines", "SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, o_custkey % 5 AS a, o_custkey % 5 + 1 AS z FROM orders) o JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN a AND z")
def overlapping_lines(spark, d):
    o = tables(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("a"), (F.col("o_custkey") % 5 + 1).alias("z"))
    return o.join(tables(spark, d, "lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_linenumber").between(F.col("a"), F.col("z"))).select("o_orderkey", "l_linenumber")


@register("ast_nodes")
def ast_nodes(spark, d):
    from gritmill.plans.nodes import nodes

    return nodes(sources(spark, d), "p_partkey", "text")


@register("ast_calls_outside_main", "SELECT p_partkey, 'size' AS name, 7 AS line FROM part")
def ast_calls_outside_main(spark, d):
    from gritmill.plans.nodes import NodeQuery, named, nodes

    return NodeQuery(nodes(sources(spark, d), "p_partkey", "text"), "p_partkey").on("METHOD_CALL").not_inside("METHOD_DECLARATION", when=named("main")).df.select("p_partkey", "name", "line")


@register("ast_methods_with_call", "SELECT p_partkey, 'main' AS name, 8 AS line FROM part")
def ast_methods_with_call(spark, d):
    from gritmill.plans.nodes import NodeQuery, named, nodes

    q = NodeQuery(nodes(sources(spark, d), "p_partkey", "text"), "p_partkey")
    return q.on("METHOD_DECLARATION").containing(q.on("METHOD_CALL").when(named("println")).df).df.select("p_partkey", "name", "line")


@register("commit_diffs")
def commit_diffs(spark, d):
    from gritmill.operators.diffs import commit_diffs as diffs

    s = sources(spark, d).select((F.col("p_partkey") % 50).cast("string").alias("commit"), "path", "text")
    return diffs(s, s.withColumn("text", F.regexp_replace("text", "int n", "long n")), max_files=None)


@register("infer_rules", "SELECT p_partkey, 'new Integer(x' || p_size || ')' AS before, 'Integer.valueOf(x' || p_size || ')' AS after, 'new $v($v1)' AS pattern, '$v.valueOf($v1)' AS replacement, round(0.5 + 0.4 * 4 / 6, 6) AS confidence FROM part")
def infer_rules(spark, d):
    from gritmill.operators.diffs import inferred_rules

    p = tables(spark, d, "part").select("p_partkey", F.format_string("new Integer(x%d)", F.col("p_size")).alias("before"), F.format_string("Integer.valueOf(x%d)", F.col("p_size")).alias("after"))
    return inferred_rules(p)


@register("equal_sequences", "SELECT count(*) AS n FROM part")
def equal_sequences(spark, d):
    from gritmill.operators.diffs import canonical_sequence

    p = tables(spark, d, "part").select("p_partkey", F.format_string("int a%d = b; f(a%d, b);", F.col("p_size"), F.col("p_size")).alias("t"))
    return p.groupBy(canonical_sequence("t").alias("sequence")).agg(F.count("*").alias("n")).select("n")


@register("nullness_stages", "SELECT p_partkey, CASE WHEN k = 0 THEN 'NON_NULL' WHEN k = 1 THEN 'NULLABLE' WHEN p_size % 2 = 0 THEN 'NULLABLE' ELSE 'UNKNOWN' END AS status, CASE WHEN k = 0 THEN 'structural child' WHEN k = 1 THEN 'Map.get may return null' WHEN p_size % 2 = 0 THEN 'initialised with null' ELSE 'getter' END AS reason FROM (SELECT *, p_size % 3 AS k FROM part)")
def nullness_stages(spark, d):
    from gritmill.operators.diffs import nullness

    p = tables(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "new A()").when(F.col("p_size") % 3 == 1, "m.get(k)").otherwise("v").alias("e"), F.when(F.col("p_size") % 2 == 0, "null").alias("i"), F.lit("").alias("c"), F.array().cast("array<string>").alias("a"))
    return p.select("p_partkey", nullness("e", "i", "c", "a").alias("x")).select("p_partkey", "x.*")
