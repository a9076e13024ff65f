"""State of mining runs, and reports of matches."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.operators import mining_state as st
from gritmill.plans import rules as r
from gritmill.queries.functions import sources
from gritmill.queries.rules import RULES
from gritmill.sources import reports
from gritmill.sources.readers import tables


@register("allow_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def allow_list(spark, d):
    listed = tables(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hash"))
    return st.allowed(tables(spark, d, "events").where("event_type in ('click', 'error')").select(F.col("event_id").alias("hash")), listed).select(F.col("hash").alias("event_id"))


@register("merge_reports", "SELECT coalesce(f.repo, e.repo) AS repo, f.files, e.error FROM (SELECT o_custkey AS repo, sum(o_orderkey % 7)::BIGINT AS files FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) f FULL JOIN (SELECT o_custkey AS repo, arg_min(o_orderpriority, o_orderkey) AS error FROM orders WHERE o_totalprice > 400000 GROUP BY 1) e ON f.repo = e.repo")
def merge_reports(spark, d):
    o = tables(spark, d, "orders").withColumn("repo", F.col("o_custkey"))
    return st.merge_reports(o.where("o_orderstatus <> 'P'").select("repo", (F.col("o_orderkey") % 7).alias("files")), o.where("o_totalprice > 400000").select("repo", F.col("o_orderkey").alias("part"), F.col("o_orderpriority").alias("error")))


@register("hash_index", "SELECT p_brand AS commit, arg_max(p_partkey, p_partkey) AS rule FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand")
def hash_index(spark, d):
    p = tables(spark, d, "part").select(F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).alias("commit"), F.col("p_partkey").alias("rule"), F.col("p_partkey").alias("ord"))
    return st.hash_index(p)


@register("curated_duplicates", "SELECT p_partkey, c.duplicate_of FROM part LEFT JOIN (SELECT p_name, min(p_brand) AS duplicate_of FROM part WHERE p_size > 45 GROUP BY p_name) c USING (p_name)")
def curated_duplicates(spark, d):
    p = tables(spark, d, "part")
    curated = p.where("p_size > 45").select(F.col("p_name").alias("fingerprint"), F.col("p_brand").alias("reference"))
    return st.curated_duplicates(p.select("p_partkey", F.col("p_name").alias("fingerprint")), curated).select("p_partkey", "duplicate_of")


@register("behaviour_fingerprint", "SELECT p_partkey, 'sha256:' || sha256(p_name || chr(10) || p_type || '  x' || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END) AS f FROM part")
def behaviour_fingerprint(spark, d):
    p = tables(spark, d, "part")
    return p.select("p_partkey", st.behaviour_fingerprint(F.concat(F.lit("\r\n "), "p_name", F.lit(" \r")), F.concat("p_type", F.lit("  x")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("f"))


_FROM = "['DISCOVERED', 'DSL_VALID', 'READY_FOR_REVIEW', 'PROMOTED', 'REJECTED'][p_size % 5 + 1]"
_TO = "['DSL_VALID', 'BEHAVIOR_VALID', 'REJECTED'][p_partkey % 3 + 1]"
_MAY = f"(({_TO} = 'REJECTED' AND p_size % 5 < 3) OR ({_TO} = 'DSL_VALID' AND p_size % 5 = 0) OR ({_TO} = 'BEHAVIOR_VALID' AND p_size % 5 = 1))"


@register("transition_log", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 AND {_MAY} THEN {_TO} ELSE {_FROM} END AS status, CASE WHEN p_partkey % 4 > 0 AND {_MAY} THEN [{_FROM} || '>' || {_TO} || ':me:why'] ELSE [] END AS log, CASE WHEN p_partkey % 4 > 0 AND {_MAY} AND {_TO} = 'REJECTED' THEN 'why' END AS rejection_reason, p_partkey % 4 > 0 AND NOT {_MAY} AS error FROM part")
def transition_log(spark, d):
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    p = tables(spark, d, "part")
    now = p.select(F.col("p_partkey").alias("id"), pick(("DISCOVERED", "DSL_VALID", "READY_FOR_REVIEW", "PROMOTED", "REJECTED"), F.col("p_size") % 5).alias("status"), F.array().alias("transitions"))
    moves = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("id"), pick(("DSL_VALID", "BEHAVIOR_VALID", "REJECTED"), F.col("p_partkey") % 3).alias("target"), F.lit("me").alias("actor"), F.lit("why").alias("reason"), F.lit("t").alias("at"))
    out = st.transition(now, moves)
    return out.select("id", "status", F.transform("transitions", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["actor"], F.lit(":"), x["reason"])).alias("log"), "rejection_reason", "error")


@register("enrich", "SELECT l_orderkey, l_linenumber, o.o_orderdate AS commit_date, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN s.s_name IS NULL THEN 'VALID' ELSE s.s_name END AS validation FROM lineitem LEFT JOIN orders o ON o.o_orderkey = l_orderkey AND o.o_orderstatus <> 'P' LEFT JOIN supplier s ON s.s_suppkey = l_orderkey")
def enrich(spark, d):
    e = tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise("rule").alias("rule"))
    commits = tables(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("commit_date"))
    out = st.enrich(e, commits, tables(spark, d, "supplier").select(F.col("s_suppkey").alias("hash"), F.col("s_name").alias("message")))
    return out.select(F.col("hash").alias("l_orderkey"), "l_linenumber", "commit_date", "validation")


@register("register_categories", "SELECT category FROM (VALUES ('economy'), ('Large')) k(category) UNION ALL SELECT CASE WHEN p % 2 = 0 THEN t ELSE lower(t) END FROM (SELECT p_type AS t, min(p_partkey) AS p FROM part WHERE p_type NOT IN ('ECONOMY', 'LARGE') GROUP BY p_type)")
def register_categories(spark, d):
    known = spark.createDataFrame([("economy",), ("Large",)], "category string")
    e = tables(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.lower("p_type"))).alias("category"), F.lit(True).alias("is_new"))
    return st.register_categories(known, e, "p_partkey")


@register("epoch_windows", "SELECT c_custkey AS repo, c_nationkey AS epoch, CASE c_nationkey WHEN 0 THEN '2020' WHEN 1 THEN '2021' ELSE '2022' END AS start FROM customer WHERE c_nationkey < 3")
def epoch_windows(spark, d):
    repos = tables(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_nationkey").alias("epoch"))
    return st.epoch_windows(repos, [("2020", "2021"), ("2021", "2022"), ("2022", "2023")]).select("repo", "epoch", "start")


@register("next_epoch", "SELECT c_custkey AS repo, c_nationkey + (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))::INT AS epoch, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN c_name END AS last_commit, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'EPOCH_COMPLETE' ELSE 'RUNNING' END AS status FROM customer")
def next_epoch(spark, d):
    state = tables(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_nationkey").alias("epoch"), F.col("c_name").alias("last_commit"), F.lit("RUNNING").alias("status"))
    return st.next_epoch(state, tables(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("repo")).distinct())


_INFERRED = "SELECT 'inferred:' || coalesce(c, 'here') AS id, arg_max('f($x, ' || p_partkey || ')', p_partkey) AS rule, ['ai-inferred', 'here', coalesce(c, 'here')] AS tags, 'INFO' AS severity, arg_max(p_name, p_partkey) AS description FROM (SELECT *, CASE WHEN p_brand <> 'Brand#3' THEN p_brand END AS c FROM part WHERE p_size % 2 = 0) GROUP BY c"


def _inferred(spark, d):
    p = tables(spark, d, "part")
    rule = F.when(F.col("p_size") % 4 < 3, F.concat(F.lit("f($x, "), F.col("p_partkey").cast("string"), F.lit(")\n;;\n")))
    e = p.select(F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).alias("hash"), (F.col("p_size") % 2 == 0).alias("relevant"), rule.alias("rule"), F.col("p_name").alias("summary"), F.col("p_partkey").alias("ord"))
    return st.register_inferred(e, "here", "ord").withColumn("rule", F.substring_index("rule", "\n", 1))


@register("register_inferred", _INFERRED)
def register_inferred(spark, d):
    return _inferred(spark, d)


@register("promote_rules", f"SELECT CASE WHEN id IN ('inferred:Brand#1', 'inferred:Brand#2') THEN replace(id, 'inferred:', 'manual:') ELSE id END AS id, rule FROM ({_INFERRED})")
def promote_rules(spark, d):
    return st.promote(_inferred(spark, d), spark.createDataFrame([("inferred:Brand#1",), ("inferred:Brand#2",), ("inferred:none",)], "id string")).select("id", "rule")


@register("saved_state", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 2")
def saved_state(spark, d):
    import uuid

    from gritmill.checkpoints import shared_dir

    path, c = f"{shared_dir(spark)}/gritmill-state-{uuid.uuid4().hex}", tables(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    for nation in (1, 2):
        st.save_state(c.where(F.col("c_nationkey") == nation).drop("c_nationkey"), path)
    return st.load_state(spark, path, "c_custkey long, c_name string, c_acctbal double")


#: Candidates that fail at each gate in turn, by part number modulo 11; the last passes.
_CASES = [
    ("", "a", "b", "c"), ("<trigger>x</trigger>", "a", "b", "c"), ("f($x)\n;;\ng($x)\n;;\n", "a", "b", "c"), ("f($x) :: noSuchGuard($x)\n=> g($x)\n;;\n", "a", "b", "c"), ("f($x)\n=> g($x)\n;;\n", "f(1", "g(1)", "c"), ("f($x)\n=> g($x)\n;;\n", "f(1)", "g(1", "c"),
    ("f($x)\n=> g($x)\n;;\n", "h(1)", "g(1)", "c"), ("f($x)\n=> g($x)\n;;\n", "f(1)", "g(2)", "c"), ("f($x)\n=> g($x)\n;;\n", "f(1)", "g(1)", "c("), ("f($x)\n=> g($x)\n;;\n", "f(1)", "g(1)", "f(2)"), ("f($x)\n=> g($x)\n;;\n", "a = f(1);", "a = g( 1 );", "h(2)"),
]
_GATES = "['SCHEMA', 'DSL_VALIDATION', 'DSL_PARSE', 'GUARD_RESOLUTION', 'BEFORE_PARSE', 'AFTER_PARSE', 'BEFORE_MATCH', 'AFTER_REWRITE', 'NEGATIVE_PARSE', 'NEGATIVE_MATCH', NULL]"


@register("candidate_gates", f"SELECT p_partkey, {_GATES}[p_partkey % 11 + 1] AS failed FROM part")
def candidate_gates(spark, d):
    cases = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("rule", "before", "after", "negative"), c, strict=True))) for c in _CASES))
    return st.verified(tables(spark, d, "part").select("p_partkey", F.element_at(cases, (F.col("p_partkey") % 11 + 1).cast("int")).alias("c")).select("p_partkey", "c.*")).select("p_partkey", "failed")


_DRY = """SELECT p_partkey, r.* FROM part, LATERAL (VALUES (8, 'System.out.println("hello world")', 'LOG.info("hello world")', 'Use a logger', 'System.out.println($msg)'), (7, 'xs.size()', 'count(xs)', NULL, '$recv.size()'),
(8, 'new Part' || p_partkey || '()', 'create()', NULL, 'new $t($args$)'), (7, '@Deprecated', NULL, NULL, '@Deprecated')) r(line, matched, replacement, description, pattern)"""


@register("dry_run", f"SELECT p_partkey, line, length(matched)::INT AS length, matched, replacement, description, 'info' AS severity, pattern FROM ({_DRY})")
def dry_run(spark, d):
    return reports.dry_run(sources(spark, d), "text", r.parse_rules(RULES, "shop.hint"), ("p_partkey",)).drop("offset")


def _scored(spark, d):
    p = tables(spark, d, "part")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    reason = pick(("enum constant", "after usage", "new object", "plain"), F.col("p_partkey") % 4)
    score = F.struct(F.col("p_size").alias("trivial_change"), F.lit("UNKNOWN").alias("null_status"), pick(("IGNORE", "WARNING", "INFO"), F.col("p_size") % 3).alias("severity"), reason.alias("reason"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array()).alias("evidence"))
    return p.select(F.col("p_brand").alias("repo"), F.lit("h").alias("hint_file"), F.col("p_type").alias("rule_name"), F.col("p_name").alias("file_path"), F.col("p_partkey").cast("int").alias("line"), F.col("p_name").alias("matched_code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("suggested_replacement"), score.alias("score"))


_REASON = "['enum constant', 'after usage', 'new object', 'plain'][p_partkey % 4 + 1]"
_SEVERITY = "['IGNORE', 'WARNING', 'INFO'][p_size % 3 + 1]"


@register("scored_json", f"""SELECT '{{"repository":"' || p_brand || '","rule":"' || p_type || '","file":"' || p_name || '","line":' || p_partkey || ',"matchedCode":"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"suggestedReplacement":"' || p_type || '"' ELSE '' END || ',"score":{{"trivialChange":' || p_size || ',"nullStatus":"UNKNOWN","severity":"' || {_SEVERITY} || '","reason":"' || {_REASON} || '"' || CASE WHEN p_size % 2 = 0 THEN ',"evidence":["' || p_brand || '"]' ELSE '' END || '}}}}' AS value FROM part""")
def scored_json(spark, d):
    return reports.scored_json(_scored(spark, d))


@register("scored_lines", f"""SELECT {_SEVERITY} AS section, '- `' || p_name || ':' || p_partkey || '` — `' || p_name || '` — ' || {_REASON} || CASE WHEN p_partkey % 2 = 0 THEN ' → `' || p_type || '`' ELSE '' END AS value FROM part WHERE p_size % 3 > 0
UNION ALL SELECT 'IGNORE', '- ' || r || ': ' || count(*) || 'x' FROM (SELECT ['Enum.toString()', 'after usage', '''new'' expression', 'plain'][p_partkey % 4 + 1] AS r FROM part WHERE p_size % 3 = 0) GROUP BY r""")
def scored_lines(spark, d):
    return reports.scored_lines(_scored(spark, d)).select("section", "value")


#: Keys of demonstration rows, which a site drops.
DEMO = (10, 20, 30)


@register("site_evaluations", "SELECT doc_id AS \"commitHash\", quality FROM labels WHERE quality = 1 AND doc_id NOT IN (10, 20, 30) UNION ALL SELECT doc_id, min(length(lang)) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (10, 20, 30)) GROUP BY doc_id")
def site_evaluations(spark, d):
    stored = tables(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("commitHash"), "quality")
    new = tables(spark, d, "documents").select(F.col("doc_id").alias("commitHash"), F.length("lang").alias("quality"))
    return reports.site_evaluations(stored, new, demo=DEMO)
