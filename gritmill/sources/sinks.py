"""Sinks: JSON, CSV, text lines, Markdown; writers stay distributed but for the Markdown page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gritmill.functions.scalars import markdown_cell


def csv_field(value) -> Column:
    """Quoted only if it holds a comma, a quote or a line end; quotes doubled; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.rlike(v, F.lit('[,"\n\r]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def report_json(matches: DataFrame, repo: str = "repo") -> DataFrame:
    """One row per repository: match and rule counts, and its matches as JSON."""
    item = F.struct(*[c for c in matches.columns if c != repo])
    return matches.groupBy(repo).agg(F.count("*").alias("matches"), F.countDistinct("hint_file", "rule_name").alias("rules"), F.to_json(F.sort_array(F.collect_list(item))).alias("items"))


def text_lines(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    return df.select(F.format_string(pattern, *(F.col(c) for c in columns)).alias("value"))


def markdown(df: DataFrame, width: int = 60) -> str:
    """A table for a page; the caller limits the rows."""
    cells = df.select(*(markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit("")), width).alias(c) for c in df.columns))
    rows = ["| " + " | ".join(str(x).replace("|", "\\|") for x in r) + " |" for r in cells.toLocalIterator()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *rows])
