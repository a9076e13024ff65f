"""Reports of matches: dry runs, scored lists as JSON and Markdown, and the data of a static site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gritmill.functions.scalars import markdown_cell
from gritmill.plans.rules import Rule, matches, report
from gritmill.sources.sinks import csv_field

# Severities in the order of their sections, with title and remark.
SECTIONS = (
    ("WARNING", "⚠️ Warnings", "These locations have a high risk of NullPointerException:"),
    ("CLEANUP", "🔧 Cleanup", "Recommended changes, null safety unclear:"),
    ("QUICKASSIST", "💡 QuickAssist", "Optional, developer should decide:"),
    ("INFO", "ℹ️ Info", "Probably safe locations, for information only:"),
    ("IGNORE", "🚫 Ignored", "Provably non-null, no change required:"),
)
# Names of the reasons why a location is ignored, by a word in it; the first that applies.
IGNORED = (
    ("toString_never_null", "StringBuilder/StringBuffer.toString()"), ("enum", "Enum.toString()"), ("this", "this.toString()"), ("primitive", "Primitive type"), ("parsed_node_valid", "AST-Node.toString()"),
    ("structural_child", "AST-Node.toString()"), ("factory_never_null", "Factory method (java.time, etc.)"), ("new", "'new' expression"), ("null guard", "Inside null guard"),
)


def dry_run(df: DataFrame, source: str, rules: list[Rule], keep: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """What the rules would do, with nothing changed: the kept columns, line, offset, length, matched, replacement, description, severity, pattern."""
    named = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(i), F.struct(F.lit(r.message or None).cast("string").alias("description"), F.lit(r.metadata.get("severity", "info")).alias("severity"), F.lit(r.pattern).alias("pattern")))))
    found = report(matches(df, source, rules, keep), rules).withColumn("told", named[F.col("rule")])
    return found.select(*keep, "line", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), "matched", "replacement", "told.description", "told.severity", "told.pattern")


def dry_run_csv(entries: DataFrame) -> DataFrame:
    """Lines of the entries' CSV form, without its header."""
    columns = ("line", "offset", "length", "matched", "replacement", "description", "severity", "pattern")
    return entries.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("value"))


def scored_json(entries: DataFrame) -> DataFrame:
    """One JSON text an entry (MATCH_ENTRY and score): a missing replacement and empty evidence are left out."""
    score = F.struct(F.col("score.trivial_change").alias("trivialChange"), F.col("score.null_status").alias("nullStatus"), F.col("score.severity").alias("severity"), F.col("score.reason").alias("reason"), F.when(F.size("score.evidence") > 0, F.col("score.evidence")).alias("evidence"))
    row = F.struct(F.col("repo").alias("repository"), F.col("rule_name").alias("rule"), F.col("file_path").alias("file"), "line", F.col("matched_code").alias("matchedCode"), F.col("suggested_replacement").alias("suggestedReplacement"), score.alias("score"))
    return entries.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))


def ignored_reason(reason) -> Column:
    """The name of a reason for ignoring a location."""
    r, out = (F.col(reason) if isinstance(reason, str) else reason), None
    for word, name in IGNORED:
        hit = F.contains(r, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(r)


def scored_lines(entries: DataFrame) -> DataFrame:
    """(section, place, value): the Markdown lines of each severity's list, largest changes first; ignored ones are counted by reason."""
    listed = entries.where("score.severity <> 'IGNORE'").select(F.col("score.severity").alias("section"), F.lpad((1000000 - F.col("score.trivial_change")).cast("string"), 9, "0").alias("place"), scored_value().alias("value"))
    counted = entries.where("score.severity = 'IGNORE'").groupBy(ignored_reason("score.reason").alias("r")).agg(F.count("*").alias("n"))
    return listed.unionByName(counted.select(F.lit("IGNORE").alias("section"), F.col("r").alias("place"), F.concat(F.lit("- "), "r", F.lit(": "), F.col("n").cast("string"), F.lit("x")).alias("value")))


def scored_markdown(entries: DataFrame, day: str) -> str:
    """The whole page; the caller limits the entries."""
    counts = {r["section"]: r["n"] for r in entries.groupBy(F.col("score.severity").alias("section")).agg(F.count("*").alias("n")).collect()}
    lines: dict[str, list[tuple]] = {}
    for r in scored_lines(entries).toLocalIterator():
        lines.setdefault(r["section"], []).append((r["place"], r["value"]))
    page = [f"# Refactoring Mining Report — {day}", "", "## Summary", "", "| Severity | Count |", "|----------|-------|"]
    page += [f"| {title} | {counts[s]} |" for s, title, _ in reversed(SECTIONS) if s in counts] + [""]
    for s, title, remark in SECTIONS:
        if s in counts:
            page += [f"## {title} — {counts[s]} Matches", "", remark, "", *[v for _, v in sorted(lines[s])], ""]
    return "\n".join(page)


def scored_value() -> Column:
    """The Markdown line of an entry."""
    return F.concat(F.lit("- `"), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit("` — `"), F.coalesce(markdown_cell("matched_code", 80), F.lit("")), F.lit("` — "), "score.reason", F.coalesce(F.concat(F.lit(" → `"), markdown_cell("suggested_replacement", 60), F.lit("`")), F.lit("")))


def site_evaluations(stored: DataFrame, new: DataFrame, key: str = "commitHash", demo: tuple[str, ...] = ()) -> DataFrame:
    """Evaluations for a site: the stored ones without demo rows, and new ones whose key isn't stored (the first of each)."""
    old = stored.where(~F.coalesce(F.col(key).isin(*demo), F.lit(False))) if demo else stored
    fresh = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("x")).select(key, "x.*")
    return old.unionByName(fresh.select(*old.columns))
