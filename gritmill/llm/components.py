"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames alone.

Each step is one aggregation (with map-side combine) and one join of two written tables, which Spark may split where a node
has very many neighbours. Each round is written to the shared folder, so lineage stays short; nothing goes to the driver but two numbers,
nor through it by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import Scratch, sorted_join


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One large-star and one small-star step over distinct edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # an aggregate right below a join would fix how its rows are dealt; written, both sides are dealt anew
    low = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
    large = scratch.save(both.join(sorted_join(low), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
    least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(sorted_join(least), "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
    return small.select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node long, component long): the smallest node reachable, for each node of the edges (a, b).

    Edges may repeat, in either direction; loops and null ends are ignored. No edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(edges, "cc")
    mark = None
    while True:
        after = scratch.save(_stars(now, scratch), "cc")
        told = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h"), F.sum(F.xxhash64("b", "a") % 999_983).alias("k")).collect()[0]
        scratch.drop(now)
        now = after
        if mark == told:
            break
        mark = told
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
