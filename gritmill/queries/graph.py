"""Graphs and trees (SURVEY F rows), and incremental ingest (2.17)."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.operators import graph as g
from gritmill.sources.readers import tables


@register("naming_conflict", "SELECT o_custkey, list_sort(list(DISTINCT coalesce(o_orderstatus, 'unknown'))) AS types FROM orders GROUP BY o_custkey HAVING count(DISTINCT coalesce(o_orderstatus, 'unknown')) > 1")
def naming_conflict(spark, d):
    return g.naming_conflicts(tables(spark, d, "orders"), "o_custkey", "o_orderstatus")


_STATES = "['LOCAL_CLOSED', 'REQUIRES_SCOPE_EXPANSION', 'EXTERNAL_BOUNDARY', 'REJECTED']"


@register("graph_merge", f"SELECT l_partkey AS canonical_id, min(l_returnflag) AS kind, CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'REJECTED' ELSE {_STATES}[max(l_linenumber % 3 + 1)] END AS status FROM lineitem GROUP BY l_partkey")
def graph_merge(spark, d):
    rows = tables(spark, d, "lineitem")
    nodes = rows.select(F.col("l_partkey").alias("canonical_id"), F.col("l_returnflag").alias("kind"), F.lit("n").alias("name"), F.element_at(F.array(*map(F.lit, g.STATES)), F.col("l_linenumber") % 3 + 1).alias("status"))
    return g.merge_nodes(nodes).select("canonical_id", "kind", "status")


@register("graph_edges", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linenumber FROM lineitem)")
def graph_edges(spark, d):
    edges = tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("start"))
    return g.merge_edges(edges).agg(F.count("*").alias("n"))


@register("graph_invalid", "SELECT 'DUPLICATE_NODE' AS problem, n_regionkey::VARCHAR AS id FROM nation GROUP BY n_regionkey HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'UNKNOWN_SOURCE', s_nationkey::VARCHAR FROM supplier WHERE s_nationkey NOT IN (SELECT n_regionkey FROM nation) UNION ALL SELECT DISTINCT 'UNKNOWN_TARGET', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT n_regionkey FROM nation)")
def graph_invalid(spark, d):
    return g.invalid(tables(spark, d, "nation"), tables(spark, d, "supplier"), "n_regionkey", "s_nationkey", "s_suppkey")


@register("graph_outgoing", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 10)")
def graph_outgoing(spark, d):
    return g.outgoing(tables(spark, d, "lineitem"), "l_orderkey", tables(spark, d, "orders").where("o_custkey = 10"), "o_orderkey").select("l_orderkey", "l_partkey")


@register("relation_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS related FROM customer")
def relation_exists(spark, d):
    hit = tables(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("x", F.lit(True))
    return tables(spark, d, "customer").select("c_custkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("related"))


@register("multiset_equal", "SELECT NOT EXISTS (SELECT o_orderstatus FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem) AND NOT EXISTS (SELECT l_linestatus FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders) AS equal")
def multiset_equal(spark, d):
    return g.multiset_equal(tables(spark, d, "orders").select("o_orderstatus"), tables(spark, d, "lineitem").select(F.col("l_linestatus").alias("o_orderstatus")))


@register("multiset_equal_self", "SELECT true AS equal")
def multiset_equal_self(spark, d):
    return g.multiset_equal(tables(spark, d, "orders").select("o_custkey", "o_orderstatus"), tables(spark, d, "orders").repartition(5).select("o_custkey", "o_orderstatus"))


@register("type_widen", "WITH u AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey AS variable, CASE WHEN c_custkey % 3 = 0 THEN 'nation' || c_nationkey ELSE 'region' || n_regionkey END AS widest FROM u WHERE c_custkey % 5 <> 0")
def type_widen(spark, d):
    nation, customer = tables(spark, d, "nation"), tables(spark, d, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    own = nation.select(name("nation", "n_nationkey").alias("type"), name("nation", "n_nationkey").alias("super"), F.lit(0).alias("depth"))
    up = nation.select(name("nation", "n_nationkey").alias("type"), name("region", "n_regionkey").alias("super"), F.lit(1).alias("depth"))
    members = own.select(F.col("type"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("member")).union(up.select(F.col("super").alias("type"), F.lit("a").alias("member")).distinct())
    uses = customer.select(F.col("c_custkey").alias("variable"), name("nation", "c_nationkey").alias("type"), F.when(F.col("c_custkey") % 3 == 0, "b").otherwise("a").alias("member"), (F.col("c_custkey") % 5 == 0).alias("unsafe"))
    return g.widen(uses, own.union(up), members)


@register("scope_search", "SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN 'UNRESOLVED_SEED' END AS rejection FROM supplier LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def scope_search(spark, d):
    seeds = tables(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return g.scope(seeds, tables(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k")), "k").select("s_suppkey", "rejection")


@register("flow_link", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey > 100 THEN 'MISSING_NODE' WHEN l_suppkey % 100 > 50 THEN 'MISSING_TARGET' WHEN l_linenumber = 1 THEN 'BOUNDARY' END AS diagnostic FROM lineitem")
def flow_link(spark, d):
    rows = tables(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("src"), (F.col("l_suppkey") % 100 - 1000).alias("dst"), (F.col("l_linenumber") == 1).alias("boundary"))
    nodes = spark.range(0, 101).select(F.col("id").alias("canonical_id")).union(spark.range(-1000, -949))
    return g.link(rows, nodes).select("l_orderkey", "l_linenumber", "l_partkey", "diagnostic")


@register("name_collision", "SELECT n_regionkey AS owner, list_sort(coalesce(list(n_name) FILTER (WHERE n_nationkey % 3 = 0), [])) AS collisions, count(*) FILTER (WHERE n_nationkey % 3 = 0) = 0 AS available FROM nation GROUP BY n_regionkey")
def name_collision(spark, d):
    n = tables(spark, d, "nation").select(F.col("n_regionkey").alias("owner"), F.col("n_name").alias("name"), "n_nationkey")
    return g.name_collisions(n.select("owner", "name"), n.where("n_nationkey % 3 = 0").select("owner", "name"))


@register("tree_leaves", "SELECT 1 AS tree, c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT c_custkey // 2 FROM customer)")
def tree_leaves(spark, d):
    nodes = tables(spark, d, "customer").select(F.lit(1).alias("tree"), F.col("c_custkey").alias("node"), F.expr("c_custkey div 2").alias("parent"))
    return g.tree_leaves(nodes, "tree", "node", "parent").select("tree", "node")


_ARRAY = "p_size % 2 = 1 AND p_size % 5 <> 0"


_TURNS = "SELECT conv_id, turn AS place, role AS entry FROM conversations"
_MOVED = "SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN last - turn + first ELSE turn END AS place, CASE WHEN conv_id % 3 = 2 AND turn = last THEN 'x' ELSE role END AS entry FROM (SELECT *, max(turn) OVER w AS last, min(turn) OVER w AS first FROM conversations WINDOW w AS (PARTITION BY conv_id))"


def _turns(spark, d):
    from pyspark.sql import Window

    c, w = tables(spark, d, "conversations"), Window.partitionBy("conv_id")
    moved = c.withColumn("last", F.max("turn").over(w)).withColumn("first", F.min("turn").over(w))
    place = F.when(F.col("conv_id") % 3 == 1, F.col("last") - F.col("turn") + F.col("first")).otherwise(F.col("turn"))
    entry = F.when((F.col("conv_id") % 3 == 2) & (F.col("turn") == F.col("last")), "x").otherwise(F.col("role"))
    return c.select("conv_id", F.col("turn").alias("place"), F.col("role").alias("entry")), moved.select("conv_id", place.alias("place"), entry.alias("entry"))


@register("leaves_in_order", f"SELECT conv_id, bool_and(a.entry IS NOT DISTINCT FROM b.entry) AS equal, min(CASE WHEN a.entry IS DISTINCT FROM b.entry THEN place END)::VARCHAR AS at FROM ({_TURNS}) a FULL JOIN ({_MOVED}) b USING (conv_id, place) GROUP BY conv_id")
def leaves_in_order(spark, d):
    return g.compare_leaves(*_turns(spark, d), "conv_id", "place", "entry", True).select("conv_id", "equal", F.col("difference.at").alias("at"))


@register("leaf_multiset", f"SELECT conv_id, bool_and(a = b) AS equal, min(CASE WHEN a <> b THEN entry END) AS at FROM (SELECT conv_id, entry, sum(a) AS a, sum(b) AS b FROM (SELECT conv_id, entry, 1 AS a, 0 AS b FROM ({_TURNS}) UNION ALL SELECT conv_id, entry, 0, 1 FROM ({_MOVED})) GROUP BY conv_id, entry) GROUP BY conv_id")
def leaf_multiset(spark, d):
    return g.compare_leaves(*_turns(spark, d), "conv_id", "place", "entry", False).select("conv_id", "equal", F.col("difference.at").alias("at"))


@register("container_contract", f"""SELECT p_partkey, CASE WHEN {_ARRAY} THEN 'semantic.array.append.sequence' WHEN u THEN 'semantic.sequence.unique.set' END AS rule,
CASE WHEN {_ARRAY} THEN CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN 'HIGH' ELSE 'MEDIUM' END WHEN u THEN 'HIGH' END AS confidence,
CASE WHEN {_ARRAY} THEN CASE WHEN p_partkey % 2 = 0 THEN 'NONE' ELSE 'POSITIONAL' END WHEN u THEN 'ENCOUNTER' END AS ord,
CASE WHEN {_ARRAY} THEN (p_partkey % 7 = 0 OR p_partkey % 4 = 0)::INT + (p_partkey % 11 = 0 OR p_partkey % 4 = 0)::INT + (p_partkey % 4 = 0)::INT WHEN u THEN 0 END AS unproven
FROM (SELECT *, p_size % 2 = 0 AND p_partkey % 3 = 0 AND p_size % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 AS u FROM part)""")
def container_contract(spark, d):
    yes, no = F.lit(True), F.lit(False)
    p = tables(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "LIST").otherwise("ARRAY").alias("shape"), F.when(F.col("p_partkey") % 2 == 0, "UNKNOWN").otherwise("POSITIONAL").alias("ord"), (F.col("p_size") % 5 == 0).alias("ins"), *((F.col("p_partkey") % n == 0).alias(f"m{n}") for n in (3, 4, 7, 11)))
    c = g.contract("shape", "ord", yes, "ins", no, yes, yes, "m3", ~F.col("m7"), ~F.col("m11"), ~F.col("m4"), no)
    return p.withColumn("c", c).select("p_partkey", "c.rule", "c.confidence", F.col("c.order").alias("ord"), F.size(F.filter(F.map_values("c.assessments"), lambda x: x == g.OPEN)).alias("unproven")).withColumn("unproven", F.when(F.col("rule").isNotNull(), F.col("unproven")))


@register("consecutive_groups", "SELECT conv_id, min(turn) AS first, count(*) AS n FROM (SELECT conv_id, turn, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM (SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations)) GROUP BY conv_id, grp")
def consecutive_groups(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(~F.col("role").eqNullSafe(F.lag("role").over(w)), 1).otherwise(0)
    rows = tables(spark, d, "conversations").withColumn("s", new).withColumn("grp", F.sum("s").over(w))
    return rows.groupBy("conv_id", "grp").agg(F.min("turn").alias("first"), F.count("*").alias("n")).drop("grp")


@register("incremental_stream", "SELECT DISTINCT * FROM events")
def incremental_stream(spark, d):
    """The events, ingested by a file stream; equal to the distinct events of a batch."""
    import uuid

    from gritmill.checkpoints import shared_dir
    from gritmill.streaming.incremental import ingest

    base = shared_dir(spark) + f"/stream-{uuid.uuid4().hex}"
    source = tables(spark, d, "events")
    source.write.parquet(f"{base}/in")
    ingest(spark, f"{base}/in", source.schema, f"{base}/out", f"{base}/checkpoint", "event_id")
    return spark.read.schema(source.schema).parquet(f"{base}/out")


@register("event_windows", "SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from gritmill.streaming.incremental import windowed_counts

    return windowed_counts(tables(spark, d, "events"), "ts", "event_type")
