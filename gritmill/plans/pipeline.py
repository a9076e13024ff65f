"""A small pipeline algebra that builds DataFrames: a source, operations, a terminal.

    Pipeline.of(df, "x").filter(F.col("x") > 0).map(F.col("x") * 2, "y").sorted().limit(3).reduce("SUM")

Operations are lazy; terminals return one-row frames (or lists of rows for `foreach`), so that Catalyst sees the whole plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F


@dataclass(frozen=True)
class Pipeline:
    df: DataFrame
    element: str
    steps: tuple[str, ...] = field(default=())
    order: tuple[Column, ...] = field(default=())

    # sources

    @staticmethod
    def of(df: DataFrame, element: str) -> Pipeline:
        """A collection, an iterable or a stream: a frame with one element column."""
        return Pipeline(df.select(element), element, (f"source {element}",))

    @staticmethod
    def array(df: DataFrame, column: str, element: str) -> Pipeline:
        return Pipeline(df.select(F.explode(column).alias(element)), element, (f"source array {column} as {element}",))

    @staticmethod
    def values(spark: SparkSession, items: Iterable, element: str, kind: str) -> Pipeline:
        """An iterator's items; for small literal sources."""
        return Pipeline(spark.createDataFrame([(x,) for x in items], f"{element} {kind}"), element, (f"source items {element}",))

    @staticmethod
    def range(spark: SparkSession, bounds: int | str, element: str = "i") -> Pipeline:
        """0 to n - 1, or "start,end" with the end left out; ValueError if malformed."""
        if isinstance(bounds, str):
            parts = bounds.split(",")
            if len(parts) != 2:
                raise ValueError(f"a range is start,end: {bounds}")
            start, end = (int(x) for x in parts)
        else:
            start, end = 0, bounds
        return Pipeline(spark.range(start, max(start, end)).withColumnRenamed("id", element), element, (f"source range {start}..{end}",))

    def _then(self, step: str, df: DataFrame, element: str | None = None, order=None) -> Pipeline:
        return replace(self, df=df, element=element or self.element, steps=(*self.steps, step), order=self.order if order is None else order)

    # operations

    def filter(self, condition: Column, comment: str = "") -> Pipeline:
        return self._then(f"filter {condition}" + (f"  // {comment}" if comment else ""), self.df.where(condition))

    def map(self, value: Column, name: str | None = None, kind: str | None = None) -> Pipeline:
        """A new element, under a new name if given; sorting so far is not kept."""
        new = name or self.element
        return self._then(f"map {value} as {new}", self.df.select((value.cast(kind) if kind else value).alias(new)), new, ())

    def flat_map(self, items: Column, name: str | None = None) -> Pipeline:
        new = name or self.element
        return self._then(f"flatMap {items} as {new}", self.df.select(F.explode(items).alias(new)), new, ())

    def peek(self, observation, *metrics: Column) -> Pipeline:
        """Metrics gathered while the pipeline runs; elements pass unchanged."""
        return self._then("peek", self.df.observe(observation, *metrics))

    def distinct(self) -> Pipeline:
        return self._then("distinct", self.df.distinct(), order=())

    def sorted(self, *by: Column) -> Pipeline:
        order = by or (F.col(self.element),)
        return self._then("sorted", self.df.orderBy(*order), order=order)

    def limit(self, n: int) -> Pipeline:
        return self._then(f"limit {n}", self.df.limit(n))

    def skip(self, n: int) -> Pipeline:
        return self._then(f"skip {n}", self.df.offset(n))

    def concat(self, other: Pipeline) -> Pipeline:
        """All elements of this one and then of the other, as a bag."""
        return self._then(f"concat ({' -> '.join(other.steps)})", self.df.union(other.df.select(F.col(other.element).alias(self.element))), order=())

    # terminals

    def _placed(self) -> DataFrame:
        """Elements with their place in the order of `sorted`: a distributed sort, then numbers that grow with it."""
        return self.df.orderBy(*self.order, F.col(self.element)).withColumn("_at", F.monotonically_increasing_id()) if self.order else self.df

    def _list(self, value: Column) -> Column:
        if not self.order:
            return F.sort_array(F.collect_list(value))
        rows = F.filter(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), value.alias("value")))), lambda x: x["value"].isNotNull())
        return F.transform(rows, lambda x: x["value"])

    def collect(self, how: str = "TO_LIST", key: Column | None = None, value: Column | None = None, separator: str = "", custom: Column | None = None) -> DataFrame:
        """TO_LIST, TO_SET, TO_MAP, JOINING, GROUPING_BY or CUSTOM. Lists keep the order of `sorted`, equal ones by element;
        without it elements have no order, and lists are in ascending order, so that results are stable."""
        e = F.col(self.element)
        df = self._placed() if how in ("TO_LIST", "JOINING", "GROUPING_BY") else self.df
        if how == "GROUPING_BY":
            return df.groupBy(key.alias("key")).agg(self._list(e if value is None else value).alias("items"))
        out = {
            "TO_LIST": lambda: self._list(e),
            "TO_SET": lambda: F.sort_array(F.collect_set(e)),
            "TO_MAP": lambda: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("key"), (e if value is None else value).alias("value"))))),
            "JOINING": lambda: F.array_join(self._list(e.cast("string")), separator),
            "CUSTOM": lambda: custom,
        }[how]()
        return df.agg(out.alias("result"))

    def reduce(self, kind: str, identity=None, step: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """SUM, COUNT, INCREMENT, DECREMENT, MIN, MAX, PRODUCT, STRING_CONCAT, or CUSTOM with an identity and a step; the last two go by the order of `sorted`."""
        e = F.col(self.element)
        df = self._placed() if kind in ("STRING_CONCAT", "CUSTOM") else self.df
        out = {
            "SUM": lambda: F.coalesce(F.sum(e), F.lit(0)),
            "COUNT": lambda: F.count("*"),
            "INCREMENT": lambda: F.count("*"),
            "DECREMENT": lambda: -F.count("*"),
            "MIN": lambda: F.min(e),
            "MAX": lambda: F.max(e),
            "PRODUCT": lambda: F.coalesce(F.product(e), F.lit(1.0)),
            "STRING_CONCAT": lambda: F.array_join(self._list(e.cast("string")), ""),
            "CUSTOM": lambda: F.aggregate(self._list(e), identity, step),
        }[kind]()
        return df.agg(out.alias("result"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("result"))

    def find_first(self) -> DataFrame:
        return self.df.limit(1)

    find_any = find_first

    def any_match(self, condition: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("result"))

    def all_match(self, condition: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("result"))

    def none_match(self, condition: Column) -> DataFrame:
        return self.df.agg((~F.coalesce(F.bool_or(condition), F.lit(False))).alias("result"))

    def foreach(self, action: Callable[[Row], None], ordered: bool = False) -> None:
        """Runs an action per element: on the executors, or one by one in order on the driver."""
        if ordered:
            for row in self.df.toLocalIterator():
                action(row)
        else:
            self.df.foreach(action)

    def explain(self) -> str:
        """The steps as a tree; `df.explain()` shows Spark's plan."""
        return "\n".join(f"{'  ' * i}{'└ ' if i else ''}{s}" for i, s in enumerate(self.steps))
