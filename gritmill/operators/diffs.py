"""Diffs: unified diffs of versions, refinement of hunks to statements, inference of rules from pairs, equal sequences."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gritmill.plans.tokens import lex


def unified(before: str | None, after: str | None, path: str, max_lines: int | None = None, width: int | None = None) -> str:
    """A unified diff of two versions (null: no file), whole unless limits are given: long lines are cut then, and lines beyond the most are counted in a last line."""
    a, b = (x.splitlines() if x else [] for x in (before, after))
    lines = [x[:width] for x in difflib.unified_diff(a, b, "/dev/null" if before is None else f"a/{path}", "/dev/null" if after is None else f"b/{path}", lineterm="")]
    return "\n".join(lines[:max_lines] + ([f"... {len(lines) - max_lines} more lines"] if max_lines is not None and len(lines) > max_lines else []))


def commit_diffs(parent: DataFrame, commit: DataFrame, prefix: str = "", max_files: int | None = 50) -> DataFrame:
    """(commit, diff) from files (commit, path, text) of parents and commits: changed files under the prefix, by path.

    A removed and an added file with the same text is a rename. Each file's diff is whole. Without `max_files` every commit is
    told; with it, commits with more changed files give an empty diff, which tells callers to skip them. Equal files fall out
    in the join, so only changed texts reach Python, and none of a commit that is skipped. Files are compared where the join
    leaves them, so that a large commit's are many tasks' work; its diffs come together as one value, of 2 GB at most.
    Joins sort and merge: texts made by expressions look small to Spark, which would broadcast them through the driver.
    """
    a = parent.select("commit", "path", F.col("text").alias("before"))
    b = commit.select("commit", "path", F.col("text").alias("after"))
    both = a.join(b.hint("merge"), ["commit", "path"], "full").where(~F.col("before").eqNullSafe(F.col("after")) & F.startswith(F.col("path"), F.lit(prefix)))
    # of copies the first gives the name, so that a commit that moves many of them is not paired in full
    gone = both.where("after is null").groupBy("commit", F.xxhash64("before").alias("h"), F.col("before").alias("moved")).agg(F.min("path").alias("old_path"))
    come = both.where("before is null").select("commit", "path", F.xxhash64("after").alias("h"), "after")
    renames = come.join(gone.hint("merge"), ["commit", "h"]).where("after = moved").groupBy("commit", "path").agg(F.min("old_path").alias("old_path"))

    @F.pandas_udf("string")
    def diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([unified(x if isinstance(x, str) else None, y if isinstance(y, str) else None, p) for x, y, p in zip(before, after, path, strict=True)], dtype=object)

    left_behind = renames.select("commit", F.col("old_path").alias("path"), F.lit(True).alias("left_behind"))
    rows = both.join(renames.hint("merge"), ["commit", "path"], "left").join(left_behind.hint("merge"), ["commit", "path"], "left").where("left_behind is null")
    if max_files is not None:
        wide = rows.where("commit is not null").groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") > max_files).select("commit")
        rows = rows.join(wide.hint("merge"), "commit", "left_anti")
    text = F.when(F.col("old_path").isNotNull(), F.concat(F.lit("rename from "), "old_path", F.lit("\nrename to "), "path")).otherwise(diff("before", "after", "path"))
    each = rows.select("commit", F.struct("path", text.alias("text")).alias("f"))
    files = each.groupBy("commit").agg(F.sort_array(F.collect_list("f")).alias("files"))
    whole = F.array_join(F.transform("files", lambda f: f["text"]), "\n")
    if max_files is None:
        return files.select("commit", whole.alias("diff"))
    told = files.select("commit", F.when(F.size("files") > max_files, "").otherwise(whole).alias("diff"))
    return told.unionByName(wide.select("commit", F.lit("").alias("diff")))


def refine(hunks: DataFrame, statements: DataFrame, side: str) -> DataFrame:
    """Smallest statements (key, start, end, text) that overlap each hunk's lines on one side, with their place among them."""
    s, n = F.col(f"{side}_start"), F.col(f"{side}_count")
    hit = hunks.join(statements, "key").where((F.col("start") <= s + n - 1) & (F.col("end") >= s))
    smaller = hit.alias("x").join(hit.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.hunk") == F.col("y.hunk")) & (F.col("y.start") >= F.col("x.start")) & (F.col("y.end") <= F.col("x.end")) & ((F.col("y.start") > F.col("x.start")) | (F.col("y.end") < F.col("x.end"))), "left_anti")
    return smaller.groupBy("key", "hunk").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias(f"{side}_items"))


def pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, hunk, before, after) of statements by place; equal pairs are dropped."""
    both = before.join(after, ["key", "hunk"])
    zipped = F.arrays_zip(F.transform("before_items", lambda x: x["text"]).alias("b"), F.transform("after_items", lambda x: x["text"]).alias("a"))
    out = both.select("key", "hunk", F.posexplode(zipped).alias("place", "p")).select("key", "hunk", "place", F.col("p.b").alias("before"), F.col("p.a").alias("after"))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def align(before: str, after: str) -> list[tuple[str, str, str, bool]]:
    """(kind, before text, after text, literal) of two texts' tokens by place, once their shape of brackets agrees; else one MODIFIED pair."""
    a, b = ([t for t, _, _ in lex(x)] for x in (before, after))
    if len(a) != len(b):
        return [("MODIFIED", before, after, False), *(("IDENTICAL", x, x, x[0] in "\"'" or x[0].isdigit()) for x in dict.fromkeys(a) if x in b and (x[0].isalnum() or x[0] in "\"'_$"))]
    words = [(x, y) for x, y in zip(a, b, strict=True) if x[0].isalnum() or x[0] in "\"'_$" or x != y]
    return [("IDENTICAL" if x == y else "MODIFIED", x, y, x[0] in "\"'" or x[0].isdigit()) for x, y in words]


def infer(before: str, after: str) -> tuple[str, str, float] | None:
    """(pattern, replacement, confidence) from one changed pair; None if nothing stays the same."""
    from gritmill.operators.mining import generalise

    steps = align(before, after)
    same = [(x, lit) for k, x, _, lit in steps if k == "IDENTICAL"]
    out = generalise(before, after, same)
    if out is None or before == after:
        return None
    n, ok = len(steps), len(same)
    leaf = all(k == "IDENTICAL" or len(lex(x)) == 1 and len(lex(y)) == 1 for k, x, y, _ in steps)
    return (*out, round(0.8 + 0.15 * ok / n if leaf else 0.5 + 0.4 * ok / n, 6))


def inferred_rules(changed: DataFrame) -> DataFrame:
    """(pattern, replacement, confidence) of frames with before and after, in Arrow batches; failures leave their row out."""

    @F.pandas_udf("struct<pattern:string,replacement:string,confidence:double>")
    def run(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        def one(x: str, y: str) -> tuple:
            try:
                return infer(x, y) or (None, None, None)
            except Exception:  # a pair that can't be taken apart says nothing of the others
                return None, None, None

        return pd.DataFrame([one(x, y) for x, y in zip(before, after, strict=True)], columns=["pattern", "replacement", "confidence"])

    return changed.where("before is not null and after is not null").withColumn("r", run("before", "after")).where("r.pattern is not null").select(*changed.columns, "r.*")


def canonical_sequence(text) -> Column:
    """Statement text with its names numbered by first use, so that sequences equal up to renaming are equal texts."""

    @F.pandas_udf("string")
    def run(source: pd.Series) -> pd.Series:
        def one(t):
            if not isinstance(t, str):
                return None
            names: dict[str, str] = {}
            toks = [x for x, _, _ in lex(t)]
            return " ".join(names.setdefault(x, f"v{len(names)}") if re.fullmatch(r"[a-z_$][\w$]*", x) and (i + 1 >= len(toks) or toks[i + 1] != "(") and (i == 0 or toks[i - 1] != ".") and x not in ("return", "new", "if", "for", "int", "long", "double", "boolean", "var") else x for i, x in enumerate(toks))

        return source.map(one)

    return run(text)


# Type prefixes whose getters never give null, and annotations that tell.
SAFE_RETURNS = ("String.valueOf", "Objects.requireNonNull", "Optional.of", "List.of", "Set.of", "Map.of", "Collections.", "Arrays.asList")


def nullness(expression, initialiser, context, annotations) -> Column:
    """struct<status, reason> in four stages, the first that knows: known calls, initialiser, null checks in context, annotations."""
    e, i, c, a = (F.col(x) if isinstance(x, str) else x for x in (expression, initialiser, context, annotations))

    def told(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    known = F.when(F.rlike(e, F.lit(r"^(?:new\b|\"|\d|this$)|^(?:" + "|".join(re.escape(x) for x in SAFE_RETURNS) + ")")), told("NON_NULL", "structural child")).when(F.rlike(e, F.lit(r"\.get\([^)]*\)$")), told("NULLABLE", "Map.get may return null"))
    start = F.when(F.rlike(i, F.lit(r"^(?:new\b|\"|\d)")), told("NON_NULL", "initialiser")).when(i == "null", told("NULLABLE", "initialised with null"))
    checked = F.when(F.rlike(c, F.concat(F.lit(r"\Q"), e, F.lit(r"\E\s*[!=]=\s*null"))), told("POTENTIALLY_NULLABLE", "null check in context"))
    marked = F.when(F.array_contains(a, "NonNull") | F.array_contains(a, "Nonnull"), told("NON_NULL", "@NonNull")).when(F.array_contains(a, "Nullable") | F.array_contains(a, "CheckForNull"), told("NULLABLE", "@Nullable"))
    return F.coalesce(known, start, checked, marked, told("UNKNOWN", "getter"))
