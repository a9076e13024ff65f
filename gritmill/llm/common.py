"""Shared helpers: scratch tables in the cluster's shared folder, and access to text bytes in Arrow batches."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gritmill.checkpoints import shared_dir

#: ASCII white space that separates words everywhere in this subpackage: blank and x09 to x0D.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written once and read again, so that lineage is cut and lost executors lose nothing.

    The tables lie in the shared folder. The caller drops those it is done with; the rest go when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/gritmill-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop, self.root)

    def folder(self, name: str) -> str:
        """A path of its own in the scratch folder."""
        self.n += 1
        return f"{self.root}/{name}-{self.n}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *what) -> None:
        """Removes tables (by frame or path); a missing one is no error."""
        for x in what:
            path = getattr(x, "scratch_path", x)
            if isinstance(path, str):
                try:
                    jvm = self.spark.sparkContext._jvm
                    target = jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
                except Exception:  # the session may be over
                    return


def sorted_join(df: DataFrame) -> DataFrame:
    """Marks a side of a join whose rows grow with the input, so that the join sorts and merges.

    Left alone, Spark broadcasts what its files' bytes make look small, through the driver's memory, though an explode or
    good compression may hide many times the rows.
    """
    return df.hint("merge")


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; null gives b"". No str objects are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()) if wide else column.cast(pa.binary())
    nulls = column.null_count > 0
    buffers = column.buffers()
    import numpy as np

    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if nulls else None
    for i in range(len(column)):
        yield b"" if nulls and not valid[i] else bytes(data[offsets[i] : offsets[i + 1]])


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given columns in the order and with the types of the schema."""
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
