"""Scalar functions and extractors."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.functions import scalars as s
from gritmill.sources import extract
from gritmill.sources.readers import tables


@register("camel_split", "SELECT p_partkey, string_split(regexp_replace(replace(initcap_, ' ', ''), '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM (SELECT p_partkey, p_brand || 'NameOf' || p_type AS initcap_ FROM part)")
def camel_split(spark, d):
    return tables(spark, d, "part").select("p_partkey", s.camel_split(F.regexp_replace(F.concat("p_brand", F.lit("NameOf"), "p_type"), " ", "")).alias("parts"))


@register("fn_lines", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents")
def fn_lines(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.line_count("text").alias("lines"))


@register("fn_file_type", "SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '[^.]*$')) ELSE 'unknown' END AS t FROM pages")
def fn_file_type(spark, d):
    return tables(spark, d, "pages").select("page_id", s.file_type("url").alias("t"))


@register("fn_fqn_scan", "SELECT page_id, regexp_extract_all(html, '[a-z][a-z0-9]*(?:\\.[a-z][a-z0-9]*)*\\.[A-Z]\\w*', 0) AS names FROM pages")
def fn_fqn_scan(spark, d):
    return tables(spark, d, "pages").select("page_id", s.fqns("html").alias("names"))


_NORM = "array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@register("fn_normalise", f"SELECT doc_id, {_NORM} AS t FROM documents")
def fn_normalise(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.normalise_rule("text").alias("t"))


@register("fn_fingerprint", f"SELECT doc_id, 'sha256:' || sha256({_NORM}) AS f FROM documents")
def fn_fingerprint(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.fingerprint("text").alias("f"))


@register("fn_candidate_id", "SELECT c_custkey, sha256(concat(c_name, chr(10), c_nationkey::VARCHAR, chr(10), c_mktsegment, chr(10), '', chr(10), 'x')) AS id FROM customer")
def fn_candidate_id(spark, d):
    return tables(spark, d, "customer").select("c_custkey", s.candidate_id("c_name", "c_nationkey", "c_mktsegment", F.lit(None), F.lit("x")).alias("id"))


_PATH = "concat(c_mktsegment, '/', CASE WHEN c_custkey % 3 = 0 THEN 'src' WHEN c_custkey % 3 = 1 THEN 'tst' ELSE 'lib' END, '/a/', c_name, '.java')"


def _paths(spark, d):
    kind = F.when(F.col("c_custkey") % 3 == 0, "src").when(F.col("c_custkey") % 3 == 1, "tst").otherwise("lib")
    return tables(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("/"), kind, F.lit("/a/"), "c_name", F.lit(".java")).alias("p"))


@register("fn_project", f"SELECT c_custkey, CASE WHEN strpos(p, '/src/') > 1 THEN regexp_extract(p, '([^/]*)/src/', 1) WHEN strpos(p, '/tst/') > 1 THEN regexp_extract(p, '([^/]*)/tst/', 1) END AS project FROM (SELECT c_custkey, {_PATH} AS p FROM customer)")
def fn_project(spark, d):
    return _paths(spark, d).select("c_custkey", s.project_name("p").alias("project"))


@register("fn_simple_class", "SELECT c_custkey, c_name AS name FROM customer")
def fn_simple_class(spark, d):
    return _paths(spark, d).select("c_custkey", s.simple_class("p").alias("name"))


@register("fn_visibility", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE 'package' END || CASE WHEN p_size % 5 = 0 THEN ' abstract' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN ' final' ELSE '' END AS v FROM part")
def fn_visibility(spark, d):
    n = F.col("p_size")
    return tables(spark, d, "part").select("p_partkey", s.visibility(n % 4 == 0, n % 4 == 1, n % 4 == 2, n % 5 == 0, n % 7 == 0).alias("v"))


@register("fn_inline", "SELECT doc_id, CASE WHEN length(l) > 80 THEN left(l, 80) || '…' ELSE l END AS t FROM (SELECT doc_id, replace(string_split(text, chr(10))[1], '`', chr(39)) AS l FROM documents)")
def fn_inline(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.inline("text").alias("t"))


@register("fn_markdown", "SELECT doc_id, CASE WHEN length(l) > 60 THEN left(l, 57) || '...' ELSE l END AS t FROM (SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), ' ') AS l FROM documents)")
def fn_markdown(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.markdown_cell("text", 60).alias("t"))


@register("fn_truncate", "SELECT doc_id, length(left(text, 2048)) AS n FROM documents")
def fn_truncate(spark, d):
    return tables(spark, d, "documents").select("doc_id", F.length(s.truncate("text", 2048)).alias("n"))


@register("fn_doc_clean", "SELECT page_id, left(trim(regexp_replace(html, '/\\*\\*|\\*/|\\*', '', 'g'), ' '), 2000) AS t FROM pages")
def fn_doc_clean(spark, d):
    return tables(spark, d, "pages").select("page_id", s.clean_doc("html").alias("t"))


@register("fn_binary_name", "SELECT page_id, contains(url, '.') AND lower(regexp_extract(url, '[^.]*$')) IN ('class', 'jar', 'png', 'jpg', 'jpeg', 'gif', 'zip', 'tar', 'gz', 'bz2', 'pdf', 'so', 'dll', 'exe', 'ico', 'war', 'ear') AS b FROM pages")
def fn_binary_name(spark, d):
    return tables(spark, d, "pages").select("page_id", s.is_binary_name("url").alias("b"))


@register("fn_method_sig", "SELECT o_custkey, 'm' || o_custkey || '(' || array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') || ')' AS sig FROM orders GROUP BY o_custkey")
def fn_method_sig(spark, d):
    return tables(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("t")).select("o_custkey", s.method_signature(F.concat(F.lit("m"), F.col("o_custkey").cast("string")), "t").alias("sig"))


@register("fn_dsl_error", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'xml|<trigger|<import|syntax|parse') THEN 'DSL_SYNTAX' WHEN regexp_matches(lower(text), 'istype|guard') THEN 'GUARD_WISSEN' ELSE 'INVALID_DSL_RULE' END AS e FROM documents")
def fn_dsl_error(spark, d):
    return tables(spark, d, "documents").select("doc_id", s.dsl_error("text").alias("e"))


_STATUS = "CASE p_size % 4 WHEN 0 THEN 'NON_NULL' WHEN 1 THEN 'NULLABLE' WHEN 2 THEN 'POTENTIALLY_NULLABLE' ELSE 'UNKNOWN' END"
_REASON = "CASE p_partkey % 6 WHEN 0 THEN 'a structural child' WHEN 1 THEN 'check after usage' WHEN 2 THEN '@Nullable' WHEN 3 THEN 'Map.get' WHEN 4 THEN 'a field' ELSE 'a getter' END"


@register("null_score", f"SELECT p_partkey, CASE WHEN s = 'NON_NULL' THEN CASE WHEN contains(r, 'structural child') THEN 1 ELSE 0 END WHEN s = 'NULLABLE' THEN CASE WHEN contains(r, 'after usage') THEN 10 WHEN contains(r, '@Nullable') THEN 10 WHEN contains(r, 'Map.get') THEN 8 ELSE 9 END WHEN s = 'POTENTIALLY_NULLABLE' THEN 5 ELSE CASE WHEN contains(r, 'parameter') THEN 3 WHEN contains(r, 'field') THEN 5 WHEN contains(r, 'getter') THEN 4 ELSE 3 END END AS score, CASE WHEN s = 'NON_NULL' THEN CASE WHEN contains(r, 'structural child') THEN 'INFO' ELSE 'IGNORE' END WHEN s = 'NULLABLE' THEN CASE WHEN contains(r, 'after usage') THEN 'WARNING' WHEN contains(r, '@Nullable') OR contains(r, 'Map.get') THEN 'CLEANUP' ELSE 'WARNING' END ELSE 'QUICKASSIST' END AS severity FROM (SELECT p_partkey, {_STATUS} AS s, {_REASON} AS r FROM part)")
def null_score(spark, d):
    rows = tables(spark, d, "part").select("p_partkey", F.expr(_STATUS).alias("s"), F.expr(_REASON).alias("r"))
    return rows.select("p_partkey", s.null_score("s", "r").alias("x")).select("p_partkey", "x.*")


@register("fn_import_diff", "SELECT o_custkey, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 1), []) AS b FROM orders GROUP BY 1)")
def fn_import_diff(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    rows = tables(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(even, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(~even, F.col("o_orderpriority"))).alias("b"))
    return rows.select("o_custkey", s.import_diff("a", "b").alias("x")).select("o_custkey", F.sort_array("x.added").alias("added"), F.sort_array("x.removed").alias("removed"))


@register("fn_line_at", "SELECT doc_id, len(string_split(left(text, 500), chr(10))) AS line FROM documents WHERE text IS NOT NULL")
def fn_line_at(spark, d):
    return tables(spark, d, "documents").where("text is not null").select("doc_id", s.line_at("text", F.lit(500)).alias("line"))


@register("fn_suggest_name", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'intArray' || cap WHEN 1 THEN 'stringList' || cap WHEN 2 THEN 'widget' || cap ELSE low END AS n FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS low, upper(left(p_name, 1)) || substr(lower(split_part(p_name, ' ', 1)), 2) AS cap FROM part)")
def fn_suggest_name(spark, d):
    kinds = F.array(F.lit("int[]"), F.lit("List<String>"), F.lit("Widget"), F.lit(None).cast("string"))
    return tables(spark, d, "part").select("p_partkey", s.suggest_name(F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")), F.lower(F.substring_index("p_name", " ", 1))).alias("n"))


@register("gap_action", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in s.GAP_ACTIONS.items()) + ") AS t(category, action)")
def gap_action(spark, d):
    return spark.createDataFrame([(k,) for k in s.GAP_ACTIONS], "category string").withColumn("action", s.gap_action("category"))


_NS = "xmlns(?::\\w+)?\\s*=\\s*[\"'']([^\"'']+)[\"'']"


@register("extract_html", f"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '{_NS}', 1))) AS fqns, list_sort(list_distinct(regexp_extract_all(html, '<([A-Za-z][\\w:.-]*)', 1))) AS types FROM pages")
def extract_html(spark, d):
    return tables(spark, d, "pages").select("page_id", extract.xml("html").alias("x")).select("page_id", F.sort_array("x.fqns").alias("fqns"), F.sort_array("x.types").alias("types"))


@register("extract_plugin_xml", "SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '\\bclass\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))) AS types FROM pages")
def extract_plugin_xml(spark, d):
    return tables(spark, d, "pages").select("page_id", F.sort_array(extract.plugin_xml("html")["types"]).alias("types"))


@register("extract_strategy", "SELECT page_id, CASE WHEN n = 'pom.xml' THEN 'pom' WHEN n IN ('plugin.xml', 'fragment.xml') THEN 'pluginxml' WHEN n = 'manifest.mf' THEN 'manifest' WHEN e = 'java' THEN 'java' WHEN e IN ('xml', 'exsd', 'xsd', 'xhtml', 'html') THEN 'xml' WHEN e = 'properties' THEN 'properties' ELSE 'text' END AS s FROM (SELECT page_id, lower(regexp_extract(url, '[^/]*$')) AS n, regexp_extract(lower(regexp_extract(url, '[^/]*$')), '[^.]*$') AS e FROM pages)")
def extract_strategy(spark, d):
    return tables(spark, d, "pages").select("page_id", extract.strategy("url").alias("s"))


def sources(spark, d):
    """Compilation units made of the parts table, one a row."""
    p = tables(spark, d, "part")
    code = F.format_string('package shop.p%d;\nimport java.util.List;\nimport java.util.Map;\n/** Part %s. */\npublic final class Part%d extends Base implements Comparable<Part%d> {\n  private static final String NAME = "%s";\n  @Deprecated public int size(List<String> xs, int n) { return xs.size() + %d; }\n  public static void main(String[] args) { new Part%d().size(null, 1); System.out.println("hello world"); }\n}\n', F.col("p_partkey") % 7, "p_type", "p_partkey", "p_partkey", "p_name", "p_size", "p_partkey")
    return p.select("p_partkey", F.concat(F.lit("shop/src/p/Part"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("path"), code.alias("text"))


@register("extract_java")
def extract_java(spark, d):
    return sources(spark, d).select("p_partkey", extract.java("text").alias("x")).select("p_partkey", "x.*")


@register("index_java")
def index_java(spark, d):
    return extract.index_java(sources(spark, d), "shop", "c1")


@register("tokens_java")
def tokens_java(spark, d):
    return extract.java_tokens(sources(spark, d), "p_partkey", "text")
