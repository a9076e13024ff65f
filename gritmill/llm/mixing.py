"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them); of these at most `max_patterns` reach
the driver, and the rest, of sources that share nothing, need no flow. There, flow runs from patterns (each word once at cost 1, again at cost 3 and so
on: convex repetition costs) to source quotas, by successive shortest paths. A pattern's flow is then dealt to documents
in the order of a seeded hash: whole copies for all, one more for those below a threshold that radix passes find exactly
(histograms of at most 1024 buckets a pattern), and a part of one document at the threshold, so that words match the flow.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritmill.llm.common import WORD, Scratch

_BITS, _STEP, _FEW = 60, 10, 1000


def water_fill(sizes: dict, weights: dict, share: float = 1.5, ceiling: float = 2.0) -> dict:
    """Targets that split share * total by weight, none above ceiling * its size; the excess goes to the others by weight."""
    total, done = share * sum(sizes.values()), {}
    free = set(sizes)
    while free:
        left, weight = total - sum(done.values()), sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * left / weight > ceiling * sizes[s]]
        if not over:
            return done | {s: weights[s] * left / weight for s in free}
        done |= {s: ceiling * sizes[s] for s in over}
        free -= set(over)
    return done


def weights_of(sources: list) -> dict:
    """5, 2, 1, repeating, over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}


def min_cost_flow(patterns: dict, quotas: dict, copies: int = 2) -> dict:
    """{(pattern, source): words}: meets as much of the quotas as can be, at least cost.

    `patterns` maps a key to (sources, words); each copy of a pattern's words costs two more than the last.
    """
    graph: list[list[list]] = [[] for _ in range(2 + len(patterns) + len(quotas))]

    def arc(a: int, b: int, capacity: int, cost: int) -> list:
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    node = {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    flows = {}
    for i, (p, (sources, words)) in enumerate(patterns.items()):
        for c in range(copies):
            arc(0, 2 + i, words, 1 + 2 * c)
        for s in sources:
            if s in node:
                flows[p, s] = arc(2 + i, node[s], copies * words, 0)
    for s, q in quotas.items():
        arc(node[s], 1, int(q), 0)
    while True:
        dist, via, queue = {0: 0}, {}, deque([0])
        waiting = {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in graph[a]:
                if e[1] > 0 and dist[a] + e[2] < dist.get(e[0], 1 << 60):
                    dist[e[0]], via[e[0]] = dist[a] + e[2], (a, e)
                    if e[0] not in waiting:
                        waiting.add(e[0])
                        queue.append(e[0])
        if 1 not in dist:
            return {k: e[3][1] for k, e in flows.items()}
        path, at = [], 1
        while at:
            at, e = via[at]
            path.append(e)
        move = min(e[1] for e in path)
        for e in path:
            e[1] -= move
            e[3][1] += move


_STATE = "pattern string, copies long, rest long, prefix long, bits int"


def deal(rows: DataFrame, state: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Adds `taken` to rows of (pattern, size, h): each pattern's flow, over its rows in the order of h.

    `state` has a row of _STATE a pattern: whole copies for all its rows, and words of the rest. Each pass finds the bucket
    of the next 10 bits of h in which the rest runs out, until few rows are left in any. `few` tells that the patterns have
    been on the driver, so that their state may be broadcast.
    """
    spread = F.broadcast if few else lambda x: x

    def prefix(bits) -> Column:
        return F.call_function("shiftrightunsigned", F.col("h"), (F.lit(_BITS) - bits).cast("int"))

    state = scratch.save(state.select(*(x.split()[0] for x in _STATE.split(", "))), "state")
    while True:
        here = rows.join(spread(state.where((F.col("rest") > 0) & (F.col("bits") < _BITS))), "pattern").where(prefix(F.col("bits")) == F.col("prefix"))
        sums = here.groupBy("pattern", "rest", prefix(F.col("bits") + _STEP).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("pattern").orderBy("bucket")  # at most 1024 rows a pattern
        cut = sums.withColumn("upto", F.sum("words").over(order)).where("upto >= rest")
        found = scratch.save(cut.groupBy("pattern").agg(F.min_by(F.struct("bucket", "upto", "words", "n"), "bucket").alias("x")).select("pattern", "x.*"), "cut")
        most = found.agg(F.max("n").alias("most")).collect()[0]["most"]
        if most is not None:
            found = found.select("pattern", "bucket", (F.col("upto") - F.col("words")).alias("less"))
            moved = state.join(spread(found), "pattern", "left").select("pattern", "copies", (F.col("rest") - F.coalesce("less", F.lit(0))).alias("rest"), F.coalesce("bucket", "prefix").alias("prefix"), (F.col("bits") + F.when(F.col("bucket").isNotNull(), _STEP).otherwise(0)).alias("bits"))
            state = scratch.save(moved, "state")
        if most is None or most <= _FEW:
            break
    at = rows.join(spread(state), "pattern", "left").withColumn("p", prefix(F.col("bits")))
    base = F.coalesce(F.col("copies") * F.col("size"), F.lit(0))
    edge = (F.col("bits") > 0) & (F.col("p") == F.col("prefix"))
    rest = at.where(~F.coalesce(edge, F.lit(False))).withColumn("taken", base + F.when((F.col("bits") > 0) & (F.col("p") < F.col("prefix")), F.col("size")).otherwise(0))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = at.where(edge).withColumn("taken", base + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - before)))
    return rest.unionByName(last).drop("copies", "rest", "prefix", "bits", "p")


def spread_targets(sources: DataFrame, scratch: Scratch, share: float, ceiling: int) -> DataFrame:
    """(source, words, target) of any number of sources (source, words): water_fill and weights_of without the driver.

    Places come from a distributed sort and the counts of its parts; a source is capped if words by weight lie under a
    level, which a few sums over the table find.
    """
    spark = sources.sparkSession
    placed = scratch.save(sources.orderBy(F.col("source").isNull(), "source").withColumn("id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("id", 33)
    counts = placed.groupBy(part.alias("part")).agg((F.max(F.col("id").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n")).collect()  # one row a part of the sort
    first, at = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        first.append((r["part"], at))
        at += r["n"]
    firsts = spark.createDataFrame(first, "part long, first long")
    place = F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    each = placed.withColumn("part", part).join(F.broadcast(firsts), "part").select("source", "words", F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (place % 3 + 1).cast("int")).alias("weight"))
    each = scratch.save(each, "weighted")
    ratio, level = F.col("words") / F.col("weight"), -1.0
    while True:
        over = ratio * ceiling < F.lit(level)
        t = each.agg(F.sum("words").alias("all"), F.sum(F.when(over, F.col("words"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).collect()[0]
        left = share * (t["all"] or 0) - ceiling * (t["full"] or 0)
        after = left / t["weight"] if t["weight"] else level  # words for each unit of weight
        if after <= level or not t["weight"]:
            break
        level = after
    return each.select("source", "words", F.least((F.col("words") * ceiling).cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def n_words(text: str) -> Column:
    """Words (runs without ASCII white space) of a text column; null has none."""
    return F.greatest(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def mix(docs: DataFrame, scratch: Scratch, seed: int = 20240607, members: Column | None = None, share: float = 1.5, ceiling: int = 2, max_patterns: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, sources (array), size, source_size, target (of its first source), taken, text_hash.

    `members` is an array column of the sources that hold a document (by default its one source; null is a source).
    Null and empty texts have size 0 and take 0. A document takes at most `ceiling` times its size. Reruns agree; rows
    that repeat are dealt one by one. A null doc_id is hashed like a value. An empty table gives no rows; a very long text is
    counted whole. Up to max_patterns membership patterns all go through the flow on the driver. Beyond, only those of
    sources that share documents do (ValueError if more than max_patterns have several sources); every other source meets
    its target from its own documents, which is what the flow would find, and nothing of it reaches the driver.
    """
    spark = docs.sparkSession
    members = F.array(F.col(source_col).cast("string")) if members is None else F.array_sort(F.array_distinct(members))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        members.alias("sources"),
        n_words(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), 4).alias("h"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    ).withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"}))
    rows = scratch.save(rows, "sizes")
    totals = scratch.save(rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")), "patterns")
    several = totals.where(F.size("sources") > 1)
    n = totals.agg(F.count("*").alias("n"), F.count_if(F.size("sources") > 1).alias("m")).collect()[0]
    few = n["n"] <= max_patterns
    if few:
        patterns = {r["pattern"]: (list(r["sources"]), r["words"]) for r in sorted(totals.collect(), key=lambda r: r["pattern"])}
        sizes: dict = {}
        for sources, words in patterns.values():
            for s in sources:
                sizes[s] = sizes.get(s, 0) + words
        targets = water_fill(sizes, weights_of(list(sizes)), share, ceiling) if sizes else {}
        flow = _flow(patterns, targets, ceiling)
        told = spark.createDataFrame([(p, sizes[m[0]], float(targets[m[0]])) for p, (m, _) in patterns.items() if m], "pattern string, source_size long, target double")
        state = spark.createDataFrame([(p, *(divmod(f, patterns[p][1]) if patterns[p][1] else (0, 0)), 0, 0) for p, f in flow.items()], _STATE)
    else:
        if n["m"] > max_patterns:
            raise ValueError(f"over {max_patterns} patterns of several sources")
        goals = scratch.save(spread_targets(totals.select(F.explode("sources").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words")), scratch, share, ceiling), "targets")
        # sources that share documents go through the flow, with their own patterns; all others meet their target from their own
        shared = scratch.save(several.select(F.explode("sources").alias("source")).distinct(), "shared")
        first = totals.withColumn("source", F.get("sources", 0)).withColumn("one", F.size("sources") == 1)
        near = first.join(shared.select(F.col("source").alias("other"), F.lit(True).alias("hit")), F.col("source").eqNullSafe(F.col("other")), "left").withColumn("flows", ~F.col("one") | F.col("hit").isNotNull())
        named = scratch.save(near.join(goals.withColumnRenamed("source", "of").withColumnRenamed("words", "source_size"), F.col("source").eqNullSafe(F.col("of")), "left").select("pattern", "sources", "words", "flows", "source_size", "target"), "named")
        told = named.where(F.size("sources") > 0).select("pattern", "source_size", "target")
        patterns = {r["pattern"]: (list(r["sources"]), r["words"]) for r in named.where("flows").orderBy("pattern").collect()}
        wanted = {r["source"]: r["target"] for r in goals.join(shared, goals["source"].eqNullSafe(shared["source"]), "left_semi").collect()}
        flow = _flow(patterns, wanted, ceiling)
        own = named.where("not flows").withColumn("flow", F.coalesce(F.floor("target").cast("long"), F.lit(0)))
        own = own.select("pattern", F.when(F.col("words") > 0, F.floor(F.col("flow") / F.greatest("words", F.lit(1)))).otherwise(0).cast("long").alias("copies"), F.when(F.col("words") > 0, F.pmod("flow", F.greatest("words", F.lit(1)))).otherwise(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("bits"))
        state = own.unionByName(spark.createDataFrame([(p, *(divmod(f, patterns[p][1]) if patterns[p][1] else (0, 0)), 0, 0) for p, f in flow.items()], _STATE))
    dealt = deal(rows, state, scratch, few)
    told = F.broadcast(told) if few else told
    return dealt.join(told, "pattern", "left").select("doc_id", "sources", "size", "source_size", "target", "taken", "text_hash")


def _flow(patterns: dict, targets: dict, ceiling: int) -> dict:
    """Words of each pattern that the flow takes."""
    flow = dict.fromkeys(patterns, 0)
    for (p, _), f in min_cost_flow(patterns, {s: int(t) for s, t in targets.items()}, ceiling).items():
        flow[p] += f
    return flow
