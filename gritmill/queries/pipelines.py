"""The pipeline algebra, one query for each source, operation and terminal."""

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.plans.pipeline import Pipeline
from gritmill.sources.readers import tables


def _of(spark, d, table, column, where="true"):
    return Pipeline.of(tables(spark, d, table).where(where), column)


def _add(name, sql, build):
    register(f"pipeline_{name}", sql)(build)


_add("filter", "SELECT p_size FROM part WHERE p_size > 40", lambda s, d: _of(s, d, "part", "p_size").filter(F.col("p_size") > 40).df)
_add("map", "SELECT p_size * 2 + 1 AS twice FROM part", lambda s, d: _of(s, d, "part", "p_size").map(F.col("p_size") * 2 + 1, "twice", "int").df)
_add("flatmap", "SELECT unnest(string_split(p_type, ' ')) AS word FROM part", lambda s, d: _of(s, d, "part", "p_type").flat_map(F.split("p_type", " "), "word").df)
_add("distinct", "SELECT DISTINCT p_brand FROM part", lambda s, d: _of(s, d, "part", "p_brand").distinct().df)
_add("sorted", "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 15", lambda s, d: _of(s, d, "part", "p_partkey").sorted(F.col("p_partkey").desc()).limit(15).df)
_add("limit", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7", lambda s, d: _of(s, d, "part", "p_partkey").sorted().limit(7).df)
_add("skip", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 5", lambda s, d: _of(s, d, "part", "p_partkey").sorted().skip(5).limit(7).df)
_add("peek", "SELECT p_size FROM part WHERE p_size < 5", lambda s, d: _of(s, d, "part", "p_size").peek("seen", F.count(F.lit(1)).alias("n")).filter(F.col("p_size") < 5).df)
_add("count", "SELECT count(*) AS result FROM part WHERE p_size > 10", lambda s, d: _of(s, d, "part", "p_size").filter(F.col("p_size") > 10).count())
_add("increment", "SELECT count(*) AS result FROM events", lambda s, d: _of(s, d, "events", "event_id").reduce("INCREMENT"))
_add("decrement", "SELECT -count(*) AS result FROM events", lambda s, d: _of(s, d, "events", "event_id").reduce("DECREMENT"))
_add("sum", "SELECT sum(l_linenumber)::BIGINT AS result FROM lineitem", lambda s, d: _of(s, d, "lineitem", "l_linenumber").reduce("SUM"))
_add("sum_empty", "SELECT 0::BIGINT AS result", lambda s, d: _of(s, d, "lineitem", "l_linenumber", "false").reduce("SUM"))
_add("min", "SELECT min(l_extendedprice) AS result FROM lineitem", lambda s, d: _of(s, d, "lineitem", "l_extendedprice").reduce("MIN"))
_add("max", "SELECT max(l_extendedprice) AS result FROM lineitem", lambda s, d: _of(s, d, "lineitem", "l_extendedprice").reduce("MAX"))
_add("product", "SELECT round(product(1 + n_regionkey)) AS result FROM nation WHERE n_nationkey < 12", lambda s, d: _of(s, d, "nation", "n_regionkey", "n_nationkey < 12").map(F.col("n_regionkey") + 1, "x").reduce("PRODUCT").select(F.round("result").alias("result")))
_add("concat", "SELECT string_agg(c_mktsegment, '' ORDER BY c_mktsegment DESC) AS result FROM customer WHERE c_custkey <= 40", lambda s, d: _of(s, d, "customer", "c_mktsegment", "c_custkey <= 40").sorted(F.col("c_mktsegment").desc()).reduce("STRING_CONCAT"))
_add("custom_reduce", "SELECT list_reduce(list(n_nationkey::BIGINT ORDER BY n_nationkey DESC), lambda a, x: (a * 3 + x) % 1000003) AS result FROM nation", lambda s, d: _of(s, d, "nation", "n_nationkey").sorted(F.col("n_nationkey").desc()).reduce("CUSTOM", F.lit(0).cast("bigint"), lambda a, x: (a * 3 + x) % 1000003))
_add("to_list", "SELECT list(c_nationkey ORDER BY c_nationkey DESC) AS result FROM customer WHERE c_custkey <= 60", lambda s, d: _of(s, d, "customer", "c_nationkey", "c_custkey <= 60").sorted(F.col("c_nationkey").desc()).collect("TO_LIST"))
_add("to_list_unsorted", "SELECT list_sort(list(n_name)) AS result FROM nation", lambda s, d: _of(s, d, "nation", "n_name").collect("TO_LIST"))
_add("to_set", "SELECT list_sort(list(DISTINCT n_regionkey)) AS result FROM nation", lambda s, d: _of(s, d, "nation", "n_regionkey").collect("TO_SET"))
_add("to_map", "SELECT list_sort(list(struct_pack(key := n_nationkey, value := n_name))) AS result FROM nation", lambda s, d: Pipeline(tables(s, d, "nation"), "n_name").collect("TO_MAP", key=F.col("n_nationkey")).select(F.array_sort(F.map_entries("result")).alias("result")))
_add("joining", "SELECT string_agg(r_name, ', ' ORDER BY r_name DESC) AS result FROM region", lambda s, d: _of(s, d, "region", "r_name").sorted(F.col("r_name").desc()).collect("JOINING", separator=", "))
_add("grouping", "SELECT n_regionkey AS key, list(n_name ORDER BY n_name DESC) AS items FROM nation GROUP BY n_regionkey", lambda s, d: Pipeline(tables(s, d, "nation"), "n_name").sorted(F.col("n_name").desc()).collect("GROUPING_BY", key=F.col("n_regionkey")))
_add("find", "SELECT p_partkey FROM part WHERE p_size = 11 ORDER BY p_partkey LIMIT 1", lambda s, d: _of(s, d, "part", "p_partkey", "p_size = 11").sorted().find_first())
_add("any", "SELECT coalesce(bool_or(p_size > 49), false) AS result FROM part", lambda s, d: _of(s, d, "part", "p_size").any_match(F.col("p_size") > 49))
_add("all", "SELECT coalesce(bool_and(p_size > 49), true) AS result FROM part", lambda s, d: _of(s, d, "part", "p_size").all_match(F.col("p_size") > 49))
_add("none", "SELECT NOT coalesce(bool_or(p_size > 500), false) AS result FROM part", lambda s, d: _of(s, d, "part", "p_size").none_match(F.col("p_size") > 500))
_add("all_empty", "SELECT true AS result", lambda s, d: _of(s, d, "part", "p_size", "false").all_match(F.col("p_size") > 49))
_add("any_empty", "SELECT false AS result", lambda s, d: _of(s, d, "part", "p_size", "false").any_match(F.col("p_size") > 0))
_add("range", "SELECT unnest(range(3, 40)) AS i", lambda s, d: Pipeline.range(s, "3,40").df)
_add("int_range", "SELECT unnest(range(0, 25)) AS i", lambda s, d: Pipeline.range(s, 25).df)
_add("array", "SELECT unnest(string_split(r_name, 'A')) AS x FROM region", lambda s, d: Pipeline.array(tables(s, d, "region").select(F.split("r_name", "A").alias("a")), "a", "x").df)
_add("union", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", lambda s, d: Pipeline.of(tables(s, d, "nation").select(F.col("n_name").alias("x")), "x").concat(Pipeline.of(tables(s, d, "region"), "r_name")).df)
