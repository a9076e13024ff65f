"""Index queries over commits, blobs, packs and references: filters, aggregates, joins, pages.

Every list query takes offset and limit and applies a total order, so that pages are stable. Null or empty arguments give
an empty result, never an error. Functions take frames, so any table with the named columns will do.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_LIMIT, DEFAULT_LIMIT, MAX_QUERY, MAX_PREFIXES, MAX_BLOB = 100, 20, 1000, 50, 1 << 20


def clamp(offset: int | str | None = 0, limit: int | str | None = DEFAULT_LIMIT) -> tuple[int, int]:
    """Offset at least 0; limit below 1 gives the default, above the maximum the maximum. What is no number counts as absent."""

    def number(x, default: int) -> int:
        try:
            return int(x)
        except (TypeError, ValueError):
            return default

    at, n = max(0, number(offset, 0)), number(limit, DEFAULT_LIMIT)
    return at, DEFAULT_LIMIT if n < 1 else min(n, MAX_LIMIT)


def sanitise(query: str | None) -> str:
    """Without control characters but tab and line ends. Raises ValueError beyond the longest query."""
    text = "".join(c for c in query or "" if c in "\t\n\r" or not (ord(c) < 32 or 127 <= ord(c) < 160))
    if len(text) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    return text


def page(df: DataFrame, *order, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A page under a total order; offset and limit become one TakeOrderedAndProject."""
    return df.orderBy(*order).offset(offset).limit(limit)


def nothing(df: DataFrame) -> DataFrame:
    return df.limit(0)


# filters


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    return df.where(F.col(column).between(start, end))


def since(df: DataFrame, column: str, at) -> DataFrame:
    return df.where(F.col(column) >= at)


def distinct_where(df: DataFrame, condition, *columns: str) -> DataFrame:
    return df.where(condition).select(*columns).distinct()


def any_prefix(items, *prefixes: str) -> Column:
    """Whether an element of a list column starts with one of at most MAX_PREFIXES non-blank prefixes; the rest are dropped."""
    use = [p for p in prefixes if p and p.strip()][:MAX_PREFIXES]
    if not use:
        return F.lit(False)
    return F.coalesce(F.exists(items, lambda x: reduce(or_, (x.startswith(p) for p in use))), F.lit(False))


def member(items, value: str) -> Column:
    """Exact list membership; a null list has no members."""
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def large(df: DataFrame, size: str, threshold: int, key: str, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return page(df.where(F.col(size) >= threshold), F.col(size).desc(), key, offset=offset, limit=limit)


def containing(commits: DataFrame, files: DataFrame, on: str, text: str, size: Column, query: str) -> DataFrame:
    """Commits with a file of at most 1 MiB whose text holds the query, by a semi join."""
    if not query:
        return nothing(commits)
    return commits.join(files.where((size <= MAX_BLOB) & F.contains(F.col(text), F.lit(query))).select(on), on, "left_semi")


# aggregates


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def trend(df: DataFrame, at: str, value: str) -> DataFrame:
    """Average by exact instant; null instants form a group, null values are skipped."""
    return df.groupBy(at).agg(F.avg(value).alias("average"))


def counts_by_type(df: DataFrame, column: str, values: dict) -> DataFrame:
    """One row with the count of each value, in a single pass."""
    return df.agg(*(F.count_if(F.col(column) == v).alias(k) for k, v in values.items()))


def migration_summary(df: DataFrame, condition: Column, package: str, author: str, at: str) -> DataFrame:
    """Affected rows, distinct packages and authors (nulls left out), first and last date; zeros and nulls if none."""
    return df.where(condition).agg(F.count("*").alias("affected"), F.countDistinct(package).alias("packages"), F.countDistinct(author).alias("authors"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def migration_candidates(df: DataFrame, prefixes: list[str], items: str, key: str) -> DataFrame:
    """(prefix, key) of affected rows: the prefixes ride along as a literal array, so no join is needed."""
    use = [p for p in dict.fromkeys(prefixes) if p and p.strip()]
    hit = F.filter(F.array(*map(F.lit, use)) if use else F.array().cast("array<string>"), lambda p: F.exists(F.col(items), lambda x: x.startswith(p)))
    return df.select(key, F.explode(hit).alias("prefix"))


def ratio_of_tests(df: DataFrame, package: str, is_test: Column) -> DataFrame:
    """Tests and all rows by package in one pass; a null package is a group."""
    return df.groupBy(package).agg(F.sum(F.when(is_test, 1).otherwise(0)).alias("tests"), F.count("*").alias("total"))


# joins


def scan(df: DataFrame, where: str | Column, *columns: str) -> DataFrame:
    """Rows that match, in the wanted columns alone; both reach the scan."""
    return df.where(where).select(*columns)


def count_where(df: DataFrame, where: str | Column) -> DataFrame:
    return df.where(where).agg(F.count("*").alias("n"))


def packs(df: DataFrame, where: str | Column, pack: str, extension: str) -> DataFrame:
    """Packs with their sorted distinct extensions."""
    return df.where(where).groupBy(pack).agg(F.sort_array(F.collect_set(extension)).alias("extensions"))


def first_row(df: DataFrame, where: str | Column, order: str, *columns: str) -> DataFrame:
    """The first matching row by order: one pack file's data."""
    return df.where(where).orderBy(order).limit(1).select(*columns)


def prefix(c: str, start: str) -> Column:
    """Whether a value begins with this text; no sign in it is a wildcard."""
    return F.startswith(F.col(c), F.lit(start))


def import_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct rows of `now` that `before` has not; nulls are equal."""
    return now.subtract(before)


def orphans(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    return parents.select(on).distinct().join(children.select(on), on, "left_anti")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the highest order value; null keys are dropped. An aggregation, not a window: it combines on the map side."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def api_diff(a: DataFrame, b: DataFrame, key: str, order: str, compared: dict[str, str]) -> DataFrame:
    """added, removed and changed keys from a to b; `compared` maps a column to the word that tells of its change."""
    x, y = last_by(a, key, order), last_by(b, key, order)
    left = x.select(F.col(key).alias("k"), F.lit(True).alias("in_a"), *(F.col(c).alias(f"a_{c}") for c in compared))
    right = y.select(F.col(key).alias("k"), F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in compared))
    both = left.join(right, "k", "full")
    told = F.concat_ws(", ", *(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(word)) for c, word in compared.items()))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(told != "", "changed")
    detail = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "").otherwise(told)
    return both.select(F.col("k").alias(key), change.alias("change"), detail.alias("detail"), *(f"a_{c}" for c in compared), *(f"b_{c}" for c in compared)).where("change is not null")


def public_only(diff: DataFrame, visibility: str, word: str = "public") -> DataFrame:
    """Changes of what was or is public: a side whose visibility holds the word."""
    held = lambda side: F.coalesce(F.contains(F.col(f"{side}_{visibility}"), F.lit(word)), F.lit(False))
    return diff.where(held("a") | held("b"))


def dead_code(df: DataFrame, key: str, names: str, imports: str) -> DataFrame:
    """Keys none of whose qualified names is imported, exactly or by its package's star, anywhere (their own imports count).

    Each name asks for itself and for its package's star; these meet the distinct imports in one equality join, and a key
    stays if none was met. So each side is read once. A name without a package can only be imported exactly.
    """
    package = F.expr("substring(name, 1, length(name) - length(substring_index(name, '.', -1)) - 1)")
    declared = df.select(key, F.explode(F.array_distinct(names)).alias("name")).where(F.trim("name") != "")
    asked = declared.select(key, F.explode(F.array_compact(F.array("name", F.when(package != "", F.concat(package, F.lit(".*")))))).alias("asked"))
    imported = df.select(F.explode(F.array_distinct(imports)).alias("asked")).where(F.trim("asked") != "").distinct()
    met = asked.join(imported.withColumn("met", F.lit(True)), "asked", "left")
    return met.groupBy(key).agg(F.max("met").alias("met")).where("met is null").select(key)


def new_only(fresh: DataFrame, known: DataFrame, *on: str) -> DataFrame:
    """Rows not yet known, once each."""
    return fresh.join(known.select(*on), list(on), "left_anti").dropDuplicates(list(on))


def purge(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number deleted). A condition that is null keeps its row."""
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("deleted"))


def after_anchor(df: DataFrame, order: list[str], key: str, anchor, size: int, since=None, until=None) -> DataFrame:
    """The `size` rows that follow the anchor in order; none if the anchor is not there. Without an anchor, the first ones.

    The anchor's position is a one-row frame, so the scan needs no global window.
    """
    at = order[0]
    rows = df if since is None else df.where(F.col(at) >= since)
    rows = rows if until is None else rows.where(F.col(at) < until)
    if anchor is not None:
        place = df.where(F.col(key) == anchor).select(F.struct(*order).alias("_anchor")).limit(1)
        rows = rows.join(F.broadcast(place), F.struct(*order) > F.col("_anchor")).drop("_anchor")
    return rows.orderBy(*order).limit(size)


def rank_fusion(*ranked: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (id, rank from 0): sum of 1 / (k + rank + 1); earlier lists win ties, then their rank. Null ids are skipped."""
    every = reduce(DataFrame.unionByName, (r.select("id", "rank", F.lit(i).alias("list")) for i, r in enumerate(ranked))).where("id is not null")
    out = every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("_first"))
    out = out.orderBy(F.col("score").desc(), "_first", "id")
    return (out.limit(top) if top else out).drop("_first")


def ranks(df: DataFrame, order: list, top: int) -> DataFrame:
    """(id, rank) of the first `top` rows; the window runs over those rows alone."""
    best = df.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
