"""Sources: files of a tree, commit logs, evaluations, candidates, rule files, database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritmill.schemas import COMMIT_EVALUATION, MINING_CANDIDATE


def files(spark: SparkSession, root: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """(path, text, size) of a folder's files, at any depth. The limit, where given, takes the first paths."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rows = rows.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("size"))
    return rows.orderBy("path").limit(limit) if limit else rows


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT_EVALUATION).json(path, multiLine=True)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a folder by file name; files that don't parse are left out."""
    from pyspark.sql import types as T

    schema = T.StructType([*MINING_CANDIDATE.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*-candidate.json").json(path)
    return rows.withColumn("file", F.input_file_name()).where("_corrupt is null").drop("_corrupt").orderBy("file").drop("file")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from `git log --format=%H%x09%an%x09%ae%x09%aI%x09%s` lines."""
    parts = F.split("value", "\t", 5)
    return spark.read.text(path).where(F.size(parts) == 5).select(parts[0].alias("object_id"), parts[1].alias("author_name"), parts[2].alias("author_email"), F.try_to_timestamp(parts[3]).alias("commit_time"), parts[4].alias("commit_message"))


def hunks(text) -> object:
    """array<struct<before_start, before_count, after_start, after_count>> of a unified diff; a missing count is 1."""
    heads = F.regexp_extract_all(text, F.lit(r"@@ -(\d+(?:,\d+)? \+\d+(?:,\d+)?) @@"), 1)

    def number(x, group: int):
        got = F.regexp_extract(x, r"^(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?$", group)
        return F.when(got == "", 1).otherwise(F.when(got != "", got).cast("int"))

    return F.transform(heads, lambda x: F.struct(number(x, 1).alias("before_start"), number(x, 2).alias("before_count"), number(x, 3).alias("after_start"), number(x, 4).alias("after_count")))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database table, read in ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def rule_files(spark: SparkSession, root: str, glob: str = "*.hint") -> dict[str, str]:
    """Text of each rule file by name; rule files are few and small, and are parsed on the driver."""
    return {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files(spark, root, glob).toLocalIterator()}
