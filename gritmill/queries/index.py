"""Index queries: filters, aggregates, joins, pages."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.operators import index_queries as q
from gritmill.sources.readers import tables


def words(text="text"):
    """Import lists stand for the words of a text."""
    return F.split(F.lower(text), r"[,\s]+", -1)


WORDS = r"string_split_regex(lower(text), '[,\s]+')"


@register("author_stats", "SELECT event_type, user_id, count(*) AS commits FROM events GROUP BY event_type, user_id")
def author_stats(spark, d):
    return q.counts(tables(spark, d, "events"), "event_type", "user_id", name="commits")


@register("author_type_stats", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def author_type_stats(spark, d):
    return q.counts(tables(spark, d, "documents"), "source", "lang")


@register("complexity_trend", "SELECT o_orderdate, round(avg(o_totalprice), 6) AS average FROM orders GROUP BY o_orderdate")
def complexity_trend(spark, d):
    return q.trend(tables(spark, d, "orders"), "o_orderdate", "o_totalprice").withColumn("average", F.round("average", 6))


@register("complexity_trend_prefix", "SELECT l_shipdate, round(avg(l_quantity), 6) AS average FROM lineitem WHERE l_returnflag LIKE 'R%' GROUP BY l_shipdate")
def complexity_trend_prefix(spark, d):
    return q.trend(tables(spark, d, "lineitem").where(F.col("l_returnflag").startswith("R")), "l_shipdate", "l_quantity").withColumn("average", F.round("average", 6))


@register("count_by_type", "SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem")
def count_by_type(spark, d):
    return q.counts_by_type(tables(spark, d, "lineitem"), "l_returnflag", {"a": "A", "n": "N", "r": "R"})


@register("count_distinct_packs", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def count_distinct_packs(spark, d):
    return tables(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("n"))


@register("total_size", "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM lineitem WHERE l_returnflag = 'R'")
def total_size(spark, d):
    return tables(spark, d, "lineitem").where("l_returnflag = 'R'").agg(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("total"))


@register("total_size_empty", "SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS total FROM lineitem WHERE l_returnflag = 'none'")
def total_size_empty(spark, d):
    return tables(spark, d, "lineitem").where("l_returnflag = 'none'").agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("total"))


@register("approx_count", "SELECT count(*) AS n FROM documents WHERE source = 'src0'")
def approx_count(spark, d):
    return q.count_where(tables(spark, d, "documents"), "source = 'src0'")


@register("scan_objects", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src1'")
def scan_objects(spark, d):
    return q.scan(tables(spark, d, "documents"), "source = 'src1'", "doc_id", "lang", "n_chars")


@register("scan_packs", "SELECT l_orderkey, list_sort(list(DISTINCT l_linestatus)) AS extensions FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey")
def scan_packs(spark, d):
    return q.packs(tables(spark, d, "lineitem"), "l_returnflag = 'A'", "l_orderkey", "l_linestatus")


@register("pack_read", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1 ORDER BY l_partkey LIMIT 1")
def pack_read(spark, d):
    return q.first_row(tables(spark, d, "lineitem"), "l_orderkey = 7 and l_linenumber = 1", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@register("import_frequency", f"SELECT count(*) AS n FROM documents WHERE len(list_filter({WORDS}, lambda x: starts_with(x, 'tion'))) > 0")
def import_frequency(spark, d):
    return tables(spark, d, "documents").where(q.any_prefix(words(), "tion")).agg(F.count("*").alias("n"))


@register("multi_import", f"SELECT doc_id FROM documents WHERE len(list_filter({WORDS}, lambda x: starts_with(x, 'tion') OR starts_with(x, 'cher'))) > 0")
def multi_import(spark, d):
    return tables(spark, d, "documents").where(q.any_prefix(words(), "tion", " ", "cher")).select("doc_id")


@register("multi_import_none", "SELECT doc_id FROM documents WHERE false")
def multi_import_none(spark, d):
    return tables(spark, d, "documents").where(q.any_prefix(words())).select("doc_id")


@register("migration_impact", f"SELECT doc_id, source FROM documents WHERE len(list_filter({WORDS}, lambda x: starts_with(x, 'erth'))) > 0 ORDER BY doc_id LIMIT 50 OFFSET 5")
def migration_impact(spark, d):
    return q.page(tables(spark, d, "documents").where(q.any_prefix(words(), "erth")).select("doc_id", "source"), "doc_id", offset=5, limit=50)


@register("migration_summary", f"SELECT count(*) AS affected, count(DISTINCT source) AS packages, count(DISTINCT lang) AS authors, min(n_chars) AS first_at, max(n_chars) AS last_at FROM documents WHERE len(list_filter({WORDS}, lambda x: starts_with(x, 'tion'))) > 0")
def migration_summary(spark, d):
    return q.migration_summary(tables(spark, d, "documents"), q.any_prefix(words(), "tion"), "source", "lang", "n_chars")


@register("migration_candidates", f"SELECT doc_id, p AS prefix FROM (SELECT doc_id, {WORDS} AS w, unnest(['tion', 'erth', 'zzz']) AS p FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, p))) > 0")
def migration_candidates(spark, d):
    return q.migration_candidates(tables(spark, d, "documents").withColumn("w", words()), ["tion", "erth", "zzz"], "w", "doc_id")


@register("commits_between_times", "SELECT event_id FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 6 HOUR")
def commits_between_times(spark, d):
    e = tables(spark, d, "events")
    first = e.agg(F.min("ts").alias("t0"))
    return e.join(F.broadcast(first)).where(F.col("ts").between(F.col("t0"), F.col("t0") + F.expr("INTERVAL 6 HOURS"))).select("event_id")


@register("refs_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'")
def refs_since(spark, d):
    return q.since(tables(spark, d, "orders"), "o_orderdate", F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00'")).select("o_orderkey")


@register("distinct_repos", "SELECT DISTINCT event_type FROM events WHERE user_id = 7")
def distinct_repos(spark, d):
    return q.distinct_where(tables(spark, d, "events"), "user_id = 7", "event_type")


@register("token_member", f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the')")
def token_member(spark, d):
    return tables(spark, d, "documents").where(q.member(words(), "the")).select("doc_id")


@register("fqn_history", f"SELECT doc_id, n_chars FROM documents WHERE list_contains({WORDS}, 'tion') ORDER BY n_chars, doc_id LIMIT 40")
def fqn_history(spark, d):
    return q.page(tables(spark, d, "documents").where(q.member(words(), "tion")).select("doc_id", "n_chars"), "n_chars", "doc_id", limit=40)


@register("monster_docs", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 5000 ORDER BY n_chars DESC, doc_id LIMIT 20")
def monster_docs(spark, d):
    return q.large(tables(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 5000, "doc_id")


@register("prefix_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def prefix_filter(spark, d):
    return tables(spark, d, "part").where(q.prefix("p_name", "red")).select("p_partkey", "p_name")


@register("file_history", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 10")
def file_history(spark, d):
    return q.page(tables(spark, d, "conversations").where("conv_id = 3").select("conv_id", "turn", "role"), F.col("turn").desc(), "role", limit=10)


@register("reflog", "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 25")
def reflog(spark, d):
    return q.page(tables(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id"), F.col("event_id").desc(), limit=25)


@register("deprecation_timeline", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 10")
def deprecation_timeline(spark, d):
    return q.page(tables(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", offset=10, limit=30)


@register("orphans", "SELECT DISTINCT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def orphans(spark, d):
    return q.orphans(tables(spark, d, "customer"), tables(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_DIFF = """WITH a AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00' AND o_custkey IS NOT NULL GROUP BY 1),
b AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_custkey IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'changed' END AS change,
CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN '' ELSE concat_ws(', ', CASE WHEN a.s IS DISTINCT FROM b.s THEN 'status' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'priority' END) END AS detail,
a.s AS a_o_orderstatus, a.p AS a_o_orderpriority, b.s AS b_o_orderstatus, b.p AS b_o_orderpriority FROM a FULL JOIN b ON a.o_custkey = b.o_custkey) WHERE change IS NOT NULL"""


def _diff(spark, d):
    o = tables(spark, d, "orders")
    late = F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")
    return q.api_diff(o.where(~late), o.where(late), "o_custkey", "o_orderkey", {"o_orderstatus": "status", "o_orderpriority": "priority"})


@register("api_diff", _DIFF)
def api_diff(spark, d):
    return _diff(spark, d)


@register("public_api_diff", f"SELECT o_custkey, change FROM ({_DIFF}) WHERE coalesce(a_o_orderpriority LIKE '%URGENT%', false) OR coalesce(b_o_orderpriority LIKE '%URGENT%', false)")
def public_api_diff(spark, d):
    return q.public_only(_diff(spark, d), "o_orderpriority", "URGENT").select("o_custkey", "change")


@register("dead_code", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def dead_code(spark, d):
    none = F.array().cast("array<string>")
    declared = tables(spark, d, "part").select("p_partkey", F.array(F.col("p_partkey").cast("string")).alias("names"), none.alias("imports"))
    used = tables(spark, d, "lineitem").where("l_quantity > 40").select(F.lit(None).cast("long").alias("p_partkey"), none.alias("names"), F.array(F.col("l_partkey").cast("string")).alias("imports"))
    return q.dead_code(declared.unionByName(used), "p_partkey", "names", "imports")


_NAMES = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@register(
    "dead_code_text",
    rf"""WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents), names AS (SELECT DISTINCT doc_id, w[1] AS name FROM d WHERE len(w) > 0),
imports AS (SELECT DISTINCT unnest(w[2:]) AS name FROM d WHERE len(w) > 0) SELECT doc_id FROM names WHERE name NOT IN (SELECT name FROM imports) AND NOT (strpos(name, '.') > 1 AND (regexp_replace(name, '\.[^.]*$', '') || '.*') IN (SELECT name FROM imports))""",
)
def dead_code_text(spark, d):
    w = F.filter(F.split("text", r"\s+", -1), lambda x: x != "")
    docs = tables(spark, d, "documents").select("doc_id", w.alias("w")).where("size(w) > 0")
    return q.dead_code(docs.select("doc_id", F.slice("w", 1, 1).alias("names"), F.expr("slice(w, 2, size(w))").alias("imports")), "doc_id", "names", "imports")


@register("test_ratio", "SELECT lang, sum(CASE WHEN text LIKE '%License%' OR text LIKE '%license%' THEN 1 ELSE 0 END)::BIGINT AS tests, count(*) AS total FROM documents GROUP BY lang")
def test_ratio(spark, d):
    return q.ratio_of_tests(tables(spark, d, "documents"), "lang", F.contains(F.col("text"), F.lit("License")) | F.contains(F.col("text"), F.lit("license")))


@register("blob_contains", "SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = c.conv_id AND strlen(t.text) <= 1048576 AND contains(t.text, 'tion'))")
def blob_contains(spark, d):
    c = tables(spark, d, "conversations")
    return q.containing(c.select("conv_id").distinct(), c, "conv_id", "text", F.octet_length("text"), "tion")


@register("skip_indexed", "SELECT DISTINCT text FROM documents WHERE source = 'src0' AND text NOT IN (SELECT text FROM documents WHERE source <> 'src0' AND text IS NOT NULL)")
def skip_indexed(spark, d):
    docs = tables(spark, d, "documents")
    return q.new_only(docs.where("source = 'src0'").select("text"), docs.where("source <> 'src0'"), "text")


@register("commit_exists", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def commit_exists(spark, d):
    return q.new_only(tables(spark, d, "orders").select("o_orderkey"), tables(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@register("delete_before", "SELECT count(*) FILTER (WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01 00:00:00')) AS kept, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00') AS deleted FROM orders")
def delete_before(spark, d):
    kept, gone = q.purge(tables(spark, d, "orders"), F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"))
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(gone))


@register("delete_pack", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey = 1 AND l_linestatus = 'O')")
def delete_pack(spark, d):
    return q.purge(tables(spark, d, "lineitem"), F.expr("l_orderkey = 1 and l_linestatus = 'O'"))[0].select("l_orderkey", "l_linenumber")


@register("next_batch", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 50) ORDER BY ts, event_id LIMIT 40")
def next_batch(spark, d):
    return q.after_anchor(tables(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "event_id", 50, 40).select("event_id", "ts")


@register("next_batch_missing_anchor", "SELECT event_id, ts FROM events WHERE false")
def next_batch_missing_anchor(spark, d):
    return q.after_anchor(tables(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "event_id", -1, 40).select("event_id", "ts")


@register("commit_walk", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) ORDER BY o_orderkey DESC LIMIT 100")
def commit_walk(spark, d):
    o, known = tables(spark, d, "orders").select("o_orderkey"), tables(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(known, "o_orderkey", "left_anti").orderBy(F.col("o_orderkey").desc()).limit(100)


@register("known_vs_new", "SELECT c_custkey, c_mktsegment, NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS is_new FROM customer")
def known_vs_new(spark, d):
    from gritmill.operators.mining import delta

    return delta(tables(spark, d, "customer").select("c_custkey", "c_mktsegment"), tables(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("import_delta", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def import_delta(spark, d):
    o = tables(spark, d, "orders")
    a, b = (o.where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("k")) for s in "FP")
    return q.import_delta(a, b)
