"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset (tests, a single machine), a folder in the warehouse, which is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: it is computed once, and lost executors lose nothing of it.

    The folder goes when Python ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/gritmill-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store; none there is no error."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is over
        return
