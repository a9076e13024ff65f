"""Full-text search: analyzers as columns, postings, BM25.

Analysis runs on the JVM, once a text. An index is written once: postings (token, doc_id, tf, len), sorted by token over
ranges, so that a query reads only the row groups of its tokens; and one row of corpus statistics. A hot token's postings
spread over ranges by document. A search without an index makes one pass, which keeps a few counts a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritmill.checkpoints import written

K1, B = 1.2, 0.75

# The default English stop words of the search library.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}_]+", -1), lambda w: w != "")


def word_parts(word: Column) -> Column:
    """Parts of a word at underscores, case changes and between letters and digits."""
    return F.filter(F.split(F.regexp_replace(word, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", "_"), "_", -1), lambda w: w != "")


def _delimited(text: Column, keep: bool) -> Column:
    def parts(w: Column) -> Column:
        p = word_parts(w)
        return F.when(F.size(p) > 1, F.concat(F.array(w), p)).otherwise(F.array(w)) if keep else p

    return F.transform(F.flatten(F.transform(_words(text), parts)), F.lower)


def java_identifier(text: Column) -> Column:
    """Words, and their parts at case changes."""
    return _delimited(text, True)


def java_path(text: Column) -> Column:
    """Parts of words alone."""
    return _delimited(text, False)


def commit_message(text: Column) -> Column:
    """Words and parts without stop words."""
    return F.filter(_delimited(text, True), lambda w: ~w.isin(*STOP_WORDS))


generic_content = commit_message


def dot_qualified_name(text: Column) -> Column:
    """The whole value as one token, dots as blanks: matches are equality but for case."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.lower(F.translate(text, ".", " "))))


def dot_qualified_tokens(text: Column) -> Column:
    """Extension: each part of each name by itself, and the simple name."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[.\s]+", -1), lambda w: w != ""), F.lower)


def java_source(text: Column) -> Column:
    """Identifiers, keywords, numbers and words of strings in source; identifiers also by camel-case part; comments and operators left out."""
    code = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)/\*.*?\*/|//[^\n]*", " ")
    tokens = F.regexp_extract_all(code, F.lit(r"[\p{L}_$][\p{L}\p{Nd}_$]*|\p{Nd}[\p{Nd}\p{L}_.]*"), 0)

    def parts(w: Column) -> Column:
        p = F.split(w, r"(?<=\p{Ll})(?=\p{Lu})", -1)
        return F.when(F.size(p) > 1, F.concat(F.array(w), p)).otherwise(F.array(w))

    return F.transform(F.flatten(F.transform(tokens, parts)), F.lower)


ANALYZERS = {"javaIdentifier": java_identifier, "javaPath": java_path, "commitMessage": commit_message, "genericContent": generic_content, "dotQualifiedName": dot_qualified_name, "dotQualifiedTokens": dot_qualified_tokens, "javaSourceEcj": java_source}


def terms(df: DataFrame, query: str, analyzer: str) -> list[str]:
    """The analysed query, by the same expressions as the documents; folds to one row on the driver."""
    return list(dict.fromkeys(df.sparkSession.range(1).select(ANALYZERS[analyzer](F.lit(query)).alias("t")).collect()[0]["t"]))


def analysed(df: DataFrame, key: str, text, analyzer: str) -> DataFrame:
    text = F.col(text) if isinstance(text, str) else text
    return df.select(F.col(key).alias("doc_id"), ANALYZERS[analyzer](text).alias("tokens"))


def bm25(docs: DataFrame, query_terms: list[str]) -> DataFrame:
    """(doc_id, score) of documents (doc_id, tokens) that hold a term: sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)).

    Texts are analysed in one pass, which writes lengths and counts of the terms; statistics and scores read those.
    """
    if not query_terms:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    # through a generator, tokens are made once for all counts; as an expression they would be made for each
    once = docs.select("doc_id", F.explode(F.array("tokens")).alias("tokens"))
    sized = once.select("doc_id", F.size("tokens").alias("len"), *(F.size(F.filter("tokens", _equals(q))).alias(f"tf{i}") for i, q in enumerate(query_terms)))
    sized = written(sized, "sized")
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query_terms))))
    both = sized.where(" or ".join(f"tf{i} > 0" for i in range(len(query_terms)))).join(F.broadcast(stats))  # one row of counts
    score = sum((_part(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("len"), F.col("avg")) for i in range(len(query_terms))), F.lit(0.0))
    return both.withColumn("score", score).where("score > 0").select("doc_id", "score")


def _part(tf: Column, df: Column, n: Column, length: Column, avg: Column) -> Column:
    """One term's share of a document's score."""
    return F.when(tf > 0, F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))).otherwise(F.lit(0.0))


def write_index(df: DataFrame, key: str, text, analyzer: str, folder: str) -> None:
    """Writes `folder`/postings (token, doc_id, tf, len) and `folder`/stats (n, avg). Null texts count as empty documents."""
    tokens = analysed(df, key, text, analyzer).select("doc_id", F.explode(F.array("tokens")).alias("tokens")).select("doc_id", F.size("tokens").alias("len"), "tokens")
    found = tokens.select("doc_id", "len", F.explode_outer("tokens").alias("token")).groupBy("token", "doc_id", "len").agg(F.count("*").alias("tf"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found.repartitionByRange(parts, "token", "doc_id").sortWithinPartitions("token", "doc_id").write.parquet(f"{folder}/postings")
    # every document has one row at least, that of no token if it is empty
    each = df.sparkSession.read.parquet(f"{folder}/postings").groupBy("doc_id").agg(F.max("len").alias("len"))
    each.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).coalesce(1).write.parquet(f"{folder}/stats")


def _best(found: DataFrame, offset: int, limit: int, digits: int | None) -> DataFrame:
    """A page of (doc_id, score), best first, doc_id as tie-break. With digits, scores equal when rounded are ties."""
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    return found.orderBy(F.col("score").desc(), "doc_id").offset(offset).limit(limit)


def search_index(spark: SparkSession, folder: str, query: str, analyzer: str, offset: int = 0, limit: int = 20, digits: int | None = None) -> DataFrame:
    """(doc_id, score) of an index's documents, best first: only the postings of the query's tokens are read."""
    every = spark.read.parquet(f"{folder}/postings")
    wanted = terms(every, query, analyzer)
    if not wanted:
        return every.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    rows = every.where(F.col("token").isin(wanted))
    counts = rows.groupBy("token").agg(F.count("*").alias("df"))
    stats = spark.read.parquet(f"{folder}/stats")
    told = rows.join(F.broadcast(counts), "token").join(F.broadcast(stats))  # one row a token of the query, and one row
    score = _part(F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("avg"))
    return _best(told.groupBy("doc_id").agg(F.sum(score).alias("score")).where("score > 0"), offset, limit, digits)


def _equals(q: str):
    return lambda w: w == q


def postings(docs: DataFrame) -> DataFrame:
    """(token, doc_id, tf) for an index that is written once and read by token."""
    return docs.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def search(df: DataFrame, key: str, fields: list[tuple[str, str, float]], query: str, where: Column | None = None, offset: int = 0, limit: int = 20, digits: int | None = None) -> DataFrame:
    """(doc_id, score): BM25 over fields of (column, analyzer, boost), summed, best first, key as tie-break."""
    rows = df if where is None else df.where(where)
    if not query or not query.strip():
        return rows.select(F.col(key).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    found = None
    for column, analyzer, boost in fields:
        one = bm25(analysed(rows, key, column, analyzer), terms(df, query, analyzer)).withColumn("score", F.col("score") * boost)
        found = one if found is None else found.unionByName(one)
    if len(fields) > 1:
        found = found.groupBy("doc_id").agg(F.sum("score").alias("score"))
    return _best(found, offset, limit, digits)
