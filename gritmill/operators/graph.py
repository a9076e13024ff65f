"""Graphs and trees: merging fragments, validity, lookups, multisets, naming conflicts, widening of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Closure states by severity.
STATES = ("LOCAL_CLOSED", "REQUIRES_SCOPE_EXPANSION", "EXTERNAL_BOUNDARY", "REJECTED")


def _severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), status)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per canonical id: the gravest status, REJECTED if kinds conflict."""
    worst = F.element_at(F.array(*map(F.lit, STATES)), F.max(_severity(F.col("status"))).cast("int"))
    out = nodes.groupBy("canonical_id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), (F.min("kind") != F.max("kind")).alias("conflict"), worst.alias("status"))
    return out.withColumn("status", F.when(F.col("conflict"), "REJECTED").otherwise(F.col("status")))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["unit", "src", "dst", "kind", "start"])


def invalid(nodes: DataFrame, edges: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """(problem, id): repeated node ids and edge ends without a node."""
    twice = nodes.groupBy(key).count().where("count > 1").select(F.lit("DUPLICATE_NODE").alias("problem"), F.col(key).cast("string").alias("id"))
    ids = nodes.select(F.col(key).alias("_id")).distinct()

    def lost(end: str, name: str) -> DataFrame:
        return edges.join(ids, F.col(end) == F.col("_id"), "left_anti").select(F.lit(name).alias("problem"), F.col(end).cast("string").alias("id")).distinct()

    return twice.unionByName(lost(src, "UNKNOWN_SOURCE")).unionByName(lost(dst, "UNKNOWN_TARGET"))


def outgoing(edges: DataFrame, src: str, of: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    return rows.join(of.select(F.col(key).alias(src)), src, "left_semi")


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows equally often. One aggregation over both, which combines on the map side."""
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).union(b.select(*cols).withColumn("_n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.bool_and(F.col("_n") == 0), F.lit(True)).alias("equal"))


def compare_leaves(before: DataFrame, after: DataFrame, tree: str, place: str, entry: str, ordered: bool) -> DataFrame:
    """Per tree: whether its leaves are equal, and the first difference (`at`, entries or counts before and after).

    Ordered leaves meet by place, which counts from 0; the first place that differs, or that one side lacks. Else each
    entry's occurrences are counted; the smallest entry whose counts differ. A null entry is equal to a null.
    """
    if ordered:
        a = before.select(tree, F.col(place).alias("at"), F.col(entry).alias("x"), F.lit(True).alias("in_a"))
        b = after.select(tree, F.col(place).alias("at"), F.col(entry).alias("y"), F.lit(True).alias("in_b"))
        both = a.join(b, [tree, "at"], "full")
        same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("x").eqNullSafe(F.col("y"))
        told = F.struct(F.col("at").cast("string").alias("at"), F.col("x").cast("string").alias("before"), F.col("y").cast("string").alias("after"))
        return both.groupBy(tree).agg(F.bool_and(same).alias("equal"), F.min_by(told, F.when(~same, F.col("at"))).alias("d")).select(tree, "equal", F.when(~F.col("equal"), F.col("d")).alias("difference"))
    counted = before.select(tree, F.col(entry).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(tree, F.col(entry).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = counted.groupBy(tree, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    other = F.col("a") != F.col("b")
    told = F.struct(F.col("x").cast("string").alias("at"), F.col("a").cast("string").alias("before"), F.col("b").cast("string").alias("after"))
    return each.groupBy(tree).agg((~F.bool_or(other)).alias("equal"), F.min(F.when(other, told)).alias("difference"))


def naming_conflicts(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Names bound to more than one type; null counts as the type unknown."""
    return df.groupBy(name).agg(F.sort_array(F.collect_set(F.coalesce(kind, F.lit("unknown")))).alias("types")).where(F.size("types") > 1)


def closure(pairs: DataFrame, scratch_save, child: str = "child", parent: str = "parent") -> DataFrame:
    """Transitive closure of (child, parent) by doubling; `scratch_save` writes a frame and reads it back between rounds. Cycles end."""
    reach = scratch_save(pairs.select(child, parent).distinct())
    n = reach.count()
    while True:
        step = reach.alias("a").join(reach.alias("b"), F.col(f"a.{parent}") == F.col(f"b.{child}")).select(F.col(f"a.{child}").alias(child), F.col(f"b.{parent}").alias(parent))
        reach = scratch_save(reach.union(step).distinct())
        m = reach.count()
        if m == n:
            return reach
        n = m


def widen(uses: DataFrame, hierarchy: DataFrame, members: DataFrame) -> DataFrame:
    """(variable, widest): of a variable's type and its supertypes (type, super, depth), the widest that declares every member used.

    Variables that are cast, tested by instanceof or used unsafely, and those never used, are left out. `uses` has
    variable, type, member, unsafe; `members` has type, member.
    """
    per = uses.groupBy("variable", "type").agg(F.bool_or("unsafe").alias("unsafe"), F.collect_set("member").alias("used")).where("not unsafe and size(used) > 0")
    declared = members.groupBy("type").agg(F.collect_set("member").alias("declared"))
    found = per.join(hierarchy, "type").join(declared.withColumnRenamed("type", "super"), "super").where(F.size(F.array_except("used", "declared")) == 0)
    return found.groupBy("variable").agg(F.max_by("super", F.struct("depth", "super")).alias("widest"))


def scope(seeds: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """Seeds with their target, or with the reason why there is none."""
    out = seeds.join(elements.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("rejection", F.when(F.col("_found").isNull(), "UNRESOLVED_SEED")).drop("_found")


def link(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Continuation roots (src, dst, boundary) with REJECTED and a diagnostic, or LINKED."""
    ids = nodes.select(F.col("canonical_id").alias("_id")).distinct()
    out = roots.join(ids.withColumnRenamed("_id", "_s"), F.col("src") == F.col("_s"), "left").join(ids.withColumnRenamed("_id", "_d"), F.col("dst") == F.col("_d"), "left")
    why = F.when(F.col("_s").isNull(), "MISSING_NODE").when(F.col("_d").isNull(), "MISSING_TARGET").when(F.coalesce(F.col("boundary"), F.lit(False)), "BOUNDARY")
    return out.withColumn("diagnostic", why).withColumn("state", F.when(why.isNull(), "LINKED").otherwise("REJECTED")).drop("_s", "_d")


def name_collisions(requested: DataFrame, declared: DataFrame) -> DataFrame:
    """By owner: requested names that are declared already, and whether all are free."""
    both = requested.join(declared.withColumn("_taken", F.lit(True)), ["owner", "name"], "left")
    hit = F.sort_array(F.collect_list(F.when(F.col("_taken"), F.col("name"))))
    return both.groupBy("owner").agg(hit.alias("collisions"), (F.count("_taken") == 0).alias("available"))


# What is assessed for a container, and the two verdicts.
ASSESSED = ("ORDER", "UNIQUENESS", "MUTABILITY", "NULLS", "ALIASING", "CONCURRENCY", "SIGNATURES")
PRESERVED, OPEN = "PRESERVED", "REQUIRES_PROOF"


def contract(shape, order, append, insert, remove, reference, complete, unique_guard, alias_free, confined, local, flow) -> Column:
    """struct<rule, confidence, order, assessments> for a container's usage; null where neither rule applies.

    A unique sequence comes first: complete, local, without alias, in one thread, no insertion or removal by place; its
    confidence is HIGH. Else an array of references that is only appended to: HIGH without alias and in one thread, else
    MEDIUM; an unknown order is NONE, since the usage is complete. Assessments map each property to PRESERVED, or to
    REQUIRES_PROOF where aliases, threads or signatures are not closed (locally or by a complete flow).
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    unique = c(complete) & (c(shape) == "LIST") & c(unique_guard) & ~c(insert) & ~c(remove) & c(local) & c(alias_free) & c(confined)
    array = c(complete) & (c(shape) == "ARRAY") & c(reference) & c(append) & ~c(insert) & ~c(remove) & c(order).isin("NONE", "ENCOUNTER", "POSITIONAL", "UNKNOWN")
    closed = c(local) | c(flow)
    verdict = {"ALIASING": c(alias_free) & closed, "CONCURRENCY": c(confined) & closed, "SIGNATURES": closed}

    def assessed(proven: bool) -> Column:
        return F.create_map(*(x for p in ASSESSED for x in (F.lit(p), F.lit(PRESERVED) if proven or p not in verdict else F.when(verdict[p], PRESERVED).otherwise(OPEN))))

    def found(rule: str, grade: Column, target: Column, proven: bool) -> Column:
        return F.struct(F.lit(rule).alias("rule"), grade.alias("confidence"), target.alias("order"), assessed(proven).alias("assessments"))

    high = F.when(c(alias_free) & c(confined), "HIGH").otherwise("MEDIUM")
    target = F.when(c(order) == "UNKNOWN", "NONE").otherwise(c(order))
    return F.when(unique, found("semantic.sequence.unique.set", F.lit("HIGH"), F.lit("ENCOUNTER"), True)).when(array, found("semantic.array.append.sequence", high, target, False))


def tree_leaves(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """Rows that are no node's parent in their tree."""
    inner = nodes.select(tree, F.col(parent).alias(node)).where(F.col(node).isNotNull()).distinct()
    return nodes.join(inner, [tree, node], "left_anti")


def canonical_attributes(attributes) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
