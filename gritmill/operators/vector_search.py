"""Vector search: exact cosine top-k on the JVM, similar items, hybrid ranking, embedding texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gritmill.operators.index_queries import rank_fusion, ranks

EMBEDDING_SIZE, INPUT_CHARS = 384, 2048


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float] | None, k: int, where: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest by cosine. No query vector (no model, blank text) gives nothing. One scan, no shuffle but the top-k."""
    rows = vectors if where is None else vectors.where(where)
    if not query:
        return rows.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), cosine(F.col(column), q).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(k)


def similar(vectors: DataFrame, key: str, column: str, of, k: int) -> DataFrame:
    """(id, score) of the k items nearest to the one named; itself left out; nothing if it is not there. The one vector is broadcast."""
    one = vectors.where(F.col(key) == of).select(F.col(column).alias("_q")).limit(1)
    scored = vectors.where((F.col(key) != of) & F.col(column).isNotNull()).join(F.broadcast(one)).select(F.col(key).alias("id"), cosine(F.col(column), F.col("_q")).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(k)


def hybrid(semantic: DataFrame, fulltext: DataFrame, k: int) -> DataFrame:
    """Rank fusion of two scored lists (id, score), semantic first on ties. An empty semantic list leaves the full-text order, as each rank adds to one list alone."""
    order = [F.col("score").desc(), F.col("id")]
    return rank_fusion(ranks(semantic, order, k), ranks(fulltext, order, k), top=k)


def embedding_text(name, documentation, methods, package) -> Column:
    """`name: doc`, `Methods: ...`, `Package: ...`; separators only where something stands before; at most INPUT_CHARS characters."""

    def given(c) -> Column:
        return F.when(F.coalesce(F.trim(c), F.lit("")) != "", c)

    head = F.concat_ws(": ", given(F.col(name)), given(F.col(documentation)))
    lines = F.array_compact(F.array(F.when(head != "", head), F.concat(F.lit("Methods: "), given(F.col(methods))), F.concat(F.lit("Package: "), given(F.col(package)))))
    return F.substring(F.array_join(lines, "\n"), 1, INPUT_CHARS)


def backfill(rows: DataFrame, embed, text: Column, flag: str = "has_embedding", column: str = "semantic_embedding") -> DataFrame:
    """Rows without an embedding get one from `embed`, a function from a text Column to an array<float> Column (such as a pandas UDF); null keeps the flag false."""
    new = F.when(~F.col(flag), embed(text)).otherwise(F.col(column))
    return rows.withColumn(column, new).withColumn(flag, F.col(column).isNotNull())


def pack(vector) -> Column:
    """Little-endian float32 bytes of a vector; null stays null."""
    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def unpack(data) -> Column:
    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(data)
