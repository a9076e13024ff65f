"""Mining statistics, comparison, candidates, and reports (2.1 sinks)."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.functions.scalars import fingerprint
from gritmill.operators import mining as m
from gritmill.sources import sinks
from gritmill.sources.readers import tables

#: Evaluations made of labels and documents: the same expressions for both engines.
_EVAL = {
    "relevant": "quality = 1",
    "duplicate": "doc_id % 11 = 0",
    "light": "CASE doc_id % 4 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' WHEN 2 THEN 'RED' END",
    "reason": "CASE WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'too small' ELSE 'merge' END END",
    "category": "CASE WHEN toxic = 1 THEN 'toxic' WHEN doc_id % 7 = 0 THEN NULL ELSE 'clean' END",
    "rule": "CASE WHEN doc_id % 3 = 0 THEN '$x => $y' WHEN doc_id % 3 = 1 THEN ' ' END",
    "validation": "CASE doc_id % 5 WHEN 0 THEN 'VALID' WHEN 1 THEN 'bad guard' WHEN 2 THEN 'XML expected' WHEN 3 THEN 'other' END",
}
_EVAL_SQL = "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _EVAL.items()) + " FROM labels"


def evaluations(spark, d):
    return tables(spark, d, "labels").select("doc_id", *(F.expr(v).alias(k) for k, v in _EVAL.items()))


_STATS = "count(*) AS total, count(*) FILTER (WHERE relevant) AS n_relevant, count(*) FILTER (WHERE NOT relevant) AS n_irrelevant, count(*) FILTER (WHERE duplicate) AS n_duplicate, count(*) FILTER (WHERE relevant AND light = 'GREEN') AS green, count(*) FILTER (WHERE relevant AND light = 'YELLOW') AS yellow, count(*) FILTER (WHERE relevant AND light = 'RED') AS red"


@register("stats_overall", f"SELECT {_STATS} FROM ({_EVAL_SQL})")
def stats_overall(spark, d):
    return m.statistics(evaluations(spark, d))


@register("stats_repo", f"SELECT source, {_STATS} FROM ({_EVAL_SQL}) e JOIN documents USING (doc_id) GROUP BY source")
def stats_repo(spark, d):
    return m.statistics(evaluations(spark, d).join(tables(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source")


@register("stats_reasons", f"SELECT reason, count(*) AS n FROM ({_EVAL_SQL}) WHERE NOT relevant AND reason IS NOT NULL GROUP BY reason")
def stats_reasons(spark, d):
    return m.reasons(evaluations(spark, d))


@register("stats_daily", "SELECT ts::DATE AS day, count(*) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stats_daily(spark, d):
    return tables(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.countDistinct("user_id").alias("users"))


@register("stats_window", "SELECT min(l_shipdate) AS first_evaluated, max(l_shipdate) AS last_evaluated, min(o_orderdate) AS first_commit, max(o_orderdate) AS last_commit FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stats_window(spark, d):
    both = tables(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(tables(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return m.time_window(both, "l_shipdate", "o_orderdate")


@register("group_repo", "SELECT n_regionkey, list_sort(list(n_name)) AS items FROM nation GROUP BY n_regionkey")
def group_repo(spark, d):
    return m.grouped(tables(spark, d, "nation"), "n_regionkey", "n_name")


@register("group_category", f"SELECT category, list_sort(list(doc_id)) AS items FROM ({_EVAL_SQL}) WHERE category IS NOT NULL GROUP BY category")
def group_category(spark, d):
    return m.grouped(evaluations(spark, d), "category", "doc_id", drop_null=True)


@register("group_light", f"SELECT light, list_sort(list(doc_id)) AS items FROM ({_EVAL_SQL}) GROUP BY light")
def group_light(spark, d):
    return m.grouped(evaluations(spark, d), "light", "doc_id")


@register("relevant_only", f"SELECT doc_id, light FROM ({_EVAL_SQL}) WHERE relevant")
def relevant_only(spark, d):
    return evaluations(spark, d).where("relevant").select("doc_id", "light")


_MINED = {
    "relevant": "n_chars > 600",
    "light": "CASE WHEN n_chars % 4 = 0 THEN 'GREEN' WHEN n_chars % 4 = 1 THEN 'YELLOW' WHEN n_chars % 4 = 2 THEN 'RED' END",
    "rule": "CASE WHEN n_chars % 2 = 0 THEN '$a => $b' END",
    "validation": "CASE n_chars % 5 WHEN 0 THEN 'VALID' WHEN 1 THEN 'bad guard' WHEN 2 THEN 'XML expected' WHEN 3 THEN 'other' END",
    "category": "CASE WHEN lang = 'en' THEN 'clean' WHEN lang = 'de' THEN 'toxic' END",
}
_MINED_SQL = "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _MINED.items()) + " FROM documents WHERE lang <> 'es'"
_ERROR = "CASE WHEN regexp_matches(lower(m.validation), 'xml|<trigger|<import|syntax|parse') THEN 'DSL_SYNTAX' WHEN regexp_matches(lower(m.validation), 'istype|guard') THEN 'GUARD_WISSEN' ELSE 'INVALID_DSL_RULE' END"
_BOTH = f"({_EVAL_SQL}) r LEFT JOIN ({_MINED_SQL}) m USING (doc_id)"
_GO = "m.relevant IS NOT NULL AND NOT (r.relevant AND NOT m.relevant)"
_COMPARE = " UNION ALL ".join(
    (
        f"SELECT doc_id AS hash, 'MISSED_RELEVANT' AS gap, NULL AS mined_value, r.light AS reference_value FROM {_BOTH} WHERE m.relevant IS NULL AND r.relevant",
        f"SELECT doc_id, 'MISSED_RELEVANT', 'irrelevant', 'relevant' FROM {_BOTH} WHERE r.relevant AND NOT m.relevant",
        f"SELECT doc_id, 'WRONG_TRAFFIC_LIGHT', m.light, r.light FROM {_BOTH} WHERE {_GO} AND r.light <> m.light",
        f"SELECT doc_id, 'MISSING_DSL_RULE', NULL, r.rule FROM {_BOTH} WHERE {_GO} AND coalesce(trim(r.rule), '') <> '' AND coalesce(trim(m.rule), '') = ''",
        f"SELECT doc_id, {_ERROR}, m.validation, r.rule FROM {_BOTH} WHERE {_GO} AND coalesce(trim(r.rule), '') <> '' AND coalesce(trim(m.rule), '') <> '' AND m.validation <> 'VALID'",
        f"SELECT doc_id, 'CATEGORY_MISMATCH', m.category, r.category FROM {_BOTH} WHERE {_GO} AND r.category <> m.category",
    )
)


def _compared(spark, d):
    mined = tables(spark, d, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("hash"), F.col("doc_id").alias("ord"), *(F.expr(v).alias(k) for k, v in _MINED.items()))
    return m.compare(evaluations(spark, d).withColumnRenamed("doc_id", "hash"), mined)


@register("compare_eval", _COMPARE)
def compare_eval(spark, d):
    return _compared(spark, d)


@register("gap_summary", f"SELECT gap, count(*) AS n FROM ({_COMPARE}) GROUP BY gap")
def gap_summary(spark, d):
    return _compared(spark, d).groupBy("gap").agg(F.count("*").alias("n"))


@register("error_hist", f"SELECT {_ERROR} AS error, count(*) AS n FROM ({_EVAL_SQL}) m WHERE validation IS NOT NULL AND validation <> 'VALID' GROUP BY 1")
def error_hist(spark, d):
    from gritmill.functions.scalars import dsl_error

    return evaluations(spark, d).where("validation <> 'VALID'").groupBy(dsl_error("validation").alias("error")).agg(F.count("*").alias("n"))


@register("limitation_groups", "SELECT p_type AS limitation, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def limitation_groups(spark, d):
    return tables(spark, d, "part").groupBy(F.col("p_type").alias("limitation")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "limitation")


_PLAIN = [k for k in m.KEYWORDS if not any(x in k for x in (".*", ".+", "[", "("))]
_PATTERNS = [k for k in m.KEYWORDS if k not in _PLAIN]
_KEYWORD_SQL = "coalesce(trim({c}) <> '' AND (" + " OR ".join([*(f"contains(lower({{c}}), '{k}')" for k in _PLAIN), *(f"regexp_matches(lower({{c}}), '{k}')" for k in _PATTERNS)]) + "), false)"


@register("keyword_filter", "SELECT page_id, " + _KEYWORD_SQL.format(c="html") + " AS hit FROM pages")
def keyword_filter(spark, d):
    return tables(spark, d, "pages").select("page_id", m.relevant_message("html").alias("hit"))


@register("classify_commits", "SELECT doc_id, CASE WHEN NOT (" + _KEYWORD_SQL.format(c="text") + ") OR coalesce(trim(text), '') = '' OR len(string_split(text, chr(10))) < 2 THEN 'SKIP' WHEN len(string_split(text, chr(10))) > 6 THEN 'DEFER' ELSE 'EVALUATE' END AS c FROM documents")
def classify_commits(spark, d):
    return tables(spark, d, "documents").select("doc_id", m.classify("text", "text", 2, 6).alias("c"))


@register("learn_limit", "SELECT least(5000, floor(max(len(string_split(text, chr(10)))) * 0.8))::BIGINT AS new_limit FROM documents")
def learn_limit(spark, d):
    return m.learned_limit(tables(spark, d, "documents").select(F.size(F.split("text", "\n", -1)).alias("n")), "n", 5000)


_TYPE = {k: v.replace("'", "''") for k, v in m.TYPE_CONTEXT.items()}


@register("type_context", f"SELECT p_partkey, list_concat(CASE WHEN p_size % 2 = 0 THEN ['{_TYPE['Job']}'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['{_TYPE['Shell']}', '{_TYPE['Display']}'] ELSE [] END) AS context FROM part")
def type_context(spark, d):
    p = tables(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "a Job"), F.when(F.col("p_size") % 3 == 0, "in a Shell of Display"), F.lit("JobX")).alias("t"))
    return p.select("p_partkey", m.type_context("t").alias("context"))


@register("report_filter", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_type <> 'NON_NULL'")
def report_filter(spark, d):
    rows = tables(spark, d, "part").select("p_partkey", F.col("p_size").alias("trivial_change"), F.col("p_brand").alias("severity"), F.col("p_type").alias("null_status"))
    return m.report_filter(rows, 10, ["Brand#11", "Brand#22", "Brand#33"], True).select("p_partkey")


_CONF = "CASE WHEN n = 0 THEN 0.0 WHEN NOT ok THEN CASE WHEN i + x > 0 THEN greatest(0.1, 0.5 * s / n) ELSE 0.3 END WHEN s = n THEN 1.0 WHEN leaf THEN 0.8 + 0.15 * s / n ELSE 0.5 + 0.4 * s / n END"
_COUNTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 4 AS s, l_suppkey % 3 AS mo, l_linenumber % 2 AS i, l_orderkey % 2 AS x, l_partkey % 5 > 0 AS ok, l_suppkey % 2 = 0 AS leaf FROM lineitem"


@register("confidence", f"SELECT l_orderkey, l_linenumber, l_partkey, round(({_CONF})::DOUBLE, 6) AS c FROM (SELECT *, s + mo + i + x AS n FROM ({_COUNTS}))")
def confidence(spark, d):
    tables(spark, d, "lineitem").createOrReplaceTempView("lineitem_confidence")
    rows = spark.sql(_COUNTS.replace("FROM lineitem", "FROM lineitem_confidence"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(m.confidence("s", "mo", "i", "x", "leaf", "ok"), 6).alias("c"))


_LIFE = [*m.LIFE, *m.ENDS]


@register("candidate_status", "SELECT a.s AS source, b.s AS target, (a.s, b.s) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in zip(m.LIFE, m.LIFE[1:], strict=False)) + ") OR (b.s IN ('REJECTED', 'DUPLICATE', 'SUPERSEDED') AND a.s NOT IN ('PROMOTED', 'REJECTED', 'DUPLICATE', 'SUPERSEDED')) AS allowed FROM (VALUES " + ", ".join(f"('{s}')" for s in _LIFE) + ") a(s), (VALUES " + ", ".join(f"('{s}')" for s in _LIFE) + ") b(s)")
def candidate_status(spark, d):
    pairs = spark.createDataFrame([(a, b) for a in _LIFE for b in _LIFE], "source string, target string")
    return pairs.withColumn("allowed", m.may_follow("source", "target"))


_STORED = "SELECT o_custkey AS id, max(o_orderkey % 4) AS revision, min(o_orderpriority) AS fingerprint, CASE WHEN o_custkey % 10 = 0 THEN 'PROMOTED' ELSE 'DSL_VALID' END AS status FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"
_NEW = "SELECT o_custkey AS id, max(o_orderkey % 6) AS revision, max(o_orderpriority) AS fingerprint, 'DISCOVERED' AS status FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey"


@register(
    "candidate_upsert",
    f"""SELECT id, CASE WHEN o IS NULL THEN nr WHEN n IS NULL OR (f AND os = 'PROMOTED') THEN r WHEN f THEN greatest(r + 1, nr) ELSE greatest(r, nr) END AS revision,
CASE WHEN o IS NULL THEN nf WHEN n IS NULL OR (f AND os = 'PROMOTED') THEN ofp WHEN f THEN nf ELSE ofp END AS fingerprint,
CASE WHEN o IS NULL THEN ns WHEN n IS NULL OR (f AND os = 'PROMOTED') THEN os WHEN f THEN 'DISCOVERED' ELSE os END AS status, coalesce(o AND n AND f AND os = 'PROMOTED', false) AS error
FROM (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL OR NULL AS o, b.id IS NOT NULL OR NULL AS n, a.revision AS r, b.revision AS nr, a.fingerprint AS ofp, b.fingerprint AS nf, a.status AS os, b.status AS ns, a.fingerprint IS DISTINCT FROM b.fingerprint AS f FROM ({_STORED}) a FULL JOIN ({_NEW}) b ON a.id = b.id)""",
)
def candidate_upsert(spark, d):
    o = tables(spark, d, "orders")
    stored = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderkey") % 4).alias("revision"), F.min("o_orderpriority").alias("fingerprint")).withColumn("status", F.when(F.col("id") % 10 == 0, "PROMOTED").otherwise("DSL_VALID"))
    new = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderkey") % 6).alias("revision"), F.max("o_orderpriority").alias("fingerprint")).withColumn("status", F.lit("DISCOVERED"))
    return m.upsert_revisions(stored, new)


@register("candidate_dedupe", "SELECT text, lang FROM documents GROUP BY text, lang")
def candidate_dedupe(spark, d):
    return tables(spark, d, "documents").select("text", "lang").dropDuplicates(["text", "lang"])


@register("candidate_verify", "SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'SCHEMA' WHEN p_size % 7 = 0 THEN 'DSL_VALIDATION' WHEN p_retailprice <= 1000 THEN 'DSL_PARSE' END AS failed FROM part")
def candidate_verify(spark, d):
    return tables(spark, d, "part").select("p_partkey", m.first_failure(F.col("p_size") > 3, F.col("p_size") % 7 != 0, F.col("p_retailprice") > 1000).alias("failed"))


@register("candidate_stage", f"SELECT doc_id, 'sha256:' || sha256(doc_id::VARCHAR) AS fingerprint, 'DSL_VALID' AS status FROM ({_EVAL_SQL}) WHERE light = 'GREEN' AND validation = 'VALID' AND doc_id % 3 = 1")
def candidate_stage(spark, d):
    e = evaluations(spark, d).withColumn("rule", F.concat("rule", F.col("doc_id").cast("string")))
    stored = e.where("doc_id % 3 = 0").select(fingerprint("rule").alias("fingerprint"))
    return m.stage_candidates(e, stored).select("doc_id", "fingerprint", "status")


@register("partial_batch", "SELECT max(doc_id) AS anchor FROM labels WHERE quality = 0 AND doc_id < coalesce((SELECT min(doc_id) FROM labels WHERE NOT (quality = 0)), 1e18)")
def partial_batch(spark, d):
    rows = tables(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("skipped"), (F.col("toxic") == 1).alias("evaluated"))
    return m.partial_batch(rows, "doc_id", "skipped", "evaluated")[0]


@register("deferred", "SELECT doc_id FROM labels WHERE NOT (quality = 0) AND NOT (toxic = 1)")
def deferred(spark, d):
    rows = tables(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("skipped"), (F.col("toxic") == 1).alias("evaluated"))
    return m.partial_batch(rows, "doc_id", "skipped", "evaluated")[1].select("doc_id")


@register("retry_limit", "SELECT user_id AS hash, count(*) AS tries, count(*) > 3 AS skipped FROM events WHERE event_type = 'click' GROUP BY user_id")
def retry_limit(spark, d):
    e = tables(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("hash"), F.lit(1).alias("tries"))
    return m.defer(e.limit(0), e)


@register("category_counts", f"SELECT list_sort(list(struct_pack(category := category, n := n))) AS hits FROM (SELECT category, count(*) AS n FROM ({_EVAL_SQL}) WHERE category IS NOT NULL GROUP BY category)")
def category_counts(spark, d):
    counted = evaluations(spark, d).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    return counted.agg(F.sort_array(F.collect_list(F.struct("category", "n"))).alias("hits"))


_FIELD = "CASE WHEN regexp_matches(coalesce({c}, ''), '[,\"\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"


@register("sink_csv", "SELECT " + " || ',' || ".join(_FIELD.format(c=c) for c in ("conv_id::VARCHAR", "role", "text")) + " AS value FROM conversations")
def sink_csv(spark, d):
    return sinks.csv_lines(tables(spark, d, "conversations").select("conv_id", "role", "text"))


@register("sink_text", "SELECT n_nationkey || ': ' || n_name || ' in ' || n_regionkey AS value FROM nation")
def sink_text(spark, d):
    return sinks.text_lines(tables(spark, d, "nation"), "%d: %s in %d", "n_nationkey", "n_name", "n_regionkey")


@register("sink_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def sink_json(spark, d):
    return sinks.json_lines(tables(spark, d, "nation"))
