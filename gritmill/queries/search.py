"""Full-text, vector and hybrid search."""

import atexit
import uuid

from pyspark.sql import functions as F

from gritmill.catalog import register
from gritmill.checkpoints import drop_folder, shared_dir
from gritmill.operators import index_queries as q
from gritmill.operators import text_search as t
from gritmill.operators import vector_search as v
from gritmill.sources.readers import tables


def _tokens_sql(column: str, keep: bool, stop: bool) -> str:
    """SQL of the delimiting analyzers for ASCII words without inner case changes or digits, which whole words alone."""
    words = f"list_filter(string_split_regex(coalesce({column}, ''), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: x <> '')"
    marked = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1_\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1_\\2', 'g'), '(\\p{{L}})(\\p{{Nd}})', '\\1_\\2', 'g'), '(\\p{{Nd}})(\\p{{L}})', '\\1_\\2', 'g')"
    parts = f"list_filter(string_split({marked.format(w='w')}, '_'), lambda x: x <> '')"
    each = f"CASE WHEN len({parts}) > 1 THEN list_concat([w], {parts}) ELSE [w] END" if keep else parts
    out = f"list_transform(flatten(list_transform({words}, lambda w: {each})), lambda x: lower(x))"
    if stop:
        out = f"list_filter({out}, lambda x: x NOT IN ({', '.join(repr(s) for s in t.STOP_WORDS)}))"
    return out


def _bm25_sql(table: str, key: str, tokens: str, terms: list[str], boost: float = 1.0, where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END" for i in range(len(terms)))
    return f"""SELECT {key} AS doc_id, ({score}) * {boost} AS score FROM (SELECT {key}, len(tokens) AS len, {tf} FROM (SELECT {key}, {tokens} AS tokens FROM {table} WHERE {where})),
(SELECT count(*) AS n, avg(len) AS av, {df} FROM (SELECT len(tokens) AS len, {tf} FROM (SELECT {tokens} AS tokens FROM {table} WHERE {where})))"""


def _top(sql: str, n: int = 20) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM ({sql}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {n}"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


_KEEP, _PATH, _STOP = _tokens_sql("{c}", True, False), _tokens_sql("{c}", False, False), _tokens_sql("{c}", True, True)


def _sql(kind: str, column: str) -> str:
    return {"javaIdentifier": _KEEP, "javaPath": _PATH, "commitMessage": _STOP, "genericContent": _STOP}[kind].replace("{c}", column)


_written: dict = {}


def _index(spark, d: str, table: str, key: str, column: str, analyzer: str) -> str:
    """The folder of the index of a table's column, written by the first search that wants it in this session."""
    kind = t.ANALYZERS[analyzer]
    want = (spark.sparkContext.applicationId, d, table, key, column, kind)
    if want not in _written:
        folder = f"{shared_dir(spark)}/gritmill-index-{uuid.uuid4().hex}"
        atexit.register(drop_folder, spark, folder)
        t.write_index(tables(spark, d, table), key, column, analyzer, folder)
        _written[want] = folder
    return _written[want]


def _one(name: str, table: str, key: str, column: str, analyzer: str, query: str, terms: list[str], where: str = "true"):
    """Registers a search over one field."""

    @register(name, _top(_bm25_sql(table, key, _sql(analyzer, column), terms, where=where)))
    def run(spark, d):
        if where == "true":
            return t.search_index(spark, _index(spark, d, table, key, column, analyzer), query, analyzer, digits=6)
        return t.search(tables(spark, d, table), key, [(column, analyzer, 1.0)], query, F.expr(where), digits=6)


_one("ft_commit", "documents", "doc_id", "text", "commitMessage", "tion and the erth", ["tion", "erth"])
_one("ft_path", "events", "event_id", "event_type", "javaPath", "click", ["click"])
_one("ft_symbol", "events", "event_id", "event_type", "javaIdentifier", "CLICK view", ["click", "view"])
_one("ft_doc", "benchmark", "item_id", "text", "commitMessage", "tion ertion", ["tion", "ertion"])
_one("ft_string", "documents", "doc_id", "text", "genericContent", "worthless token", ["worthless", "token"])
_one("ft_filepath", "supplier", "s_suppkey", "s_name", "javaPath", "Supplier 7", ["supplier", "7"])
_one("ft_type_module", "supplier", "s_suppkey", "s_name", "javaIdentifier", "Supplier", ["supplier"], "s_nationkey < 9")


def _keyword(name: str, table: str, key: str, column: str, query: str, where: str = "true"):
    """Registers a search by whole value: BM25 over one token a field."""
    token = query.lower().replace(".", " ")
    tokens = f"CASE WHEN coalesce({column}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE [lower(replace({column}, '.', ' '))] END"

    @register(name, _top(_bm25_sql(table, key, tokens, [token], where=where)))
    def run(spark, d):
        return t.search(tables(spark, d, table), key, [(column, "dotQualifiedName", 1.0)], query, F.expr(where), digits=6)


_keyword("ft_hierarchy", "customer", "c_custkey", "c_name", "customer#000000007")
_keyword("ft_annotation", "part", "p_partkey", "p_brand", "Brand#11")
_keyword("ft_ref", "orders", "o_orderkey", "o_orderpriority", "1-Urgent")
_keyword("ft_fqn", "customer", "c_custkey", "c_mktsegment", "BUILDING", "c_nationkey = 3")


@register("ft_type", f"SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM ({_bm25_sql('customer', 'c_custkey', 'CASE WHEN coalesce(c_mktsegment, chr(48)) = chr(48) THEN CAST([] AS VARCHAR[]) ELSE [lower(c_mktsegment)] END', ['machinery'], 2.0)}) WHERE score > 0 UNION ALL SELECT * FROM ({_bm25_sql('customer', 'c_custkey', 'CASE WHEN coalesce(c_name, chr(48)) = chr(48) THEN CAST([] AS VARCHAR[]) ELSE [lower(c_name)] END', ['machinery'], 1.5)}) WHERE score > 0) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def ft_type(spark, d):
    return t.search(tables(spark, d, "customer"), "c_custkey", [("c_mktsegment", "dotQualifiedName", 2.0), ("c_name", "dotQualifiedName", 1.5)], "MACHINERY", digits=6)


_CODE = "list_filter(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '[\\p{L}_$][\\p{L}\\p{Nd}_$]*|\\p{Nd}[\\p{Nd}\\p{L}_.]*'), lambda x: x <> '')"
_HUMPS = "string_split(regexp_replace(w, '(\\p{Ll})(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_SOURCE = f"list_transform(flatten(list_transform({_CODE}, lambda w: CASE WHEN len({_HUMPS}) > 1 THEN list_concat([w], {_HUMPS}) ELSE [w] END)), lambda x: lower(x))"


@register("ft_source", _top(_bm25_sql("pages", "page_id", _SOURCE, ["div", "class"])))
def ft_source(spark, d):
    return t.search(tables(spark, d, "pages"), "page_id", [("html", "javaSourceEcj", 1.0)], "div class", digits=6)


@register("ft_blank", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def ft_blank(spark, d):
    return t.search(tables(spark, d, "documents"), "doc_id", [("text", "commitMessage", 1.0)], "  ")


@register("postings", f"SELECT token, doc_id, count(*) AS tf FROM (SELECT item_id AS doc_id, unnest({_sql('commitMessage', 'text')}) AS token FROM benchmark) GROUP BY token, doc_id")
def postings(spark, d):
    return t.postings(t.analysed(tables(spark, d, "benchmark"), "item_id", "text", "commitMessage"))


_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
_D = "list_transform({x}, lambda z: z::DOUBLE)"


def _cos_sql(a: str, b: str) -> str:
    return _COS.format(a=_D.format(x=a), b=_D.format(x=b))


_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@register("knn", f"SELECT vec_id AS id, round({_COS.format(a=_D.format(x='embedding'), b=str(_QUERY) + '::DOUBLE[]')}, 6) AS score FROM embeddings WHERE label = 2 ORDER BY {_COS.format(a=_D.format(x='embedding'), b=str(_QUERY) + '::DOUBLE[]')} DESC, vec_id LIMIT 10")
def knn(spark, d):
    return _rounded(v.nearest(tables(spark, d, "embeddings"), "vec_id", "embedding", _QUERY, 10, F.col("label") == 2))


@register("knn_no_model", "SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings WHERE false")
def knn_no_model(spark, d):
    return v.nearest(tables(spark, d, "embeddings"), "vec_id", "embedding", None, 10)


_SIMILAR = f"SELECT e.vec_id AS id, {_cos_sql('e.embedding', 'o.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) o WHERE e.vec_id <> 5"


@register("similar", f"SELECT id, round(score, 6) AS score FROM ({_SIMILAR}) ORDER BY score DESC, id LIMIT 10")
def similar(spark, d):
    return _rounded(v.similar(tables(spark, d, "embeddings"), "vec_id", "embedding", 5, 10))


@register("similar_missing", "SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings WHERE false")
def similar_missing(spark, d):
    return v.similar(tables(spark, d, "embeddings"), "vec_id", "embedding", -1, 10)


_RRF = "SELECT id, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM ({a} UNION ALL {b}) GROUP BY id"
_BY_QTY = "(SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part ORDER BY rank LIMIT 30)"
_BY_SIZE = "(SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank FROM part ORDER BY rank LIMIT 30)"


@register("rrf", _RRF.format(a=_BY_QTY, b=_BY_SIZE))
def rrf(spark, d):
    part = tables(spark, d, "part").withColumnRenamed("p_partkey", "id")
    price = q.ranks(part.select("id", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("id")], 30)
    size = q.ranks(part.select("id", "p_size"), [F.col("p_size"), F.col("id")], 30)
    return _rounded(q.rank_fusion(price, size))


@register("hybrid", f"WITH s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM ({_SIMILAR}) ORDER BY rank LIMIT 15), f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ({_bm25_sql('benchmark', 'item_id', _sql('commitMessage', 'text'), ['tion', 'ertion'])}) WHERE score > 0 ORDER BY rank LIMIT 15) SELECT id, round(score, 6) AS score FROM (SELECT id, sum(1.0 / (60 + rank + 1)) AS score, min(struct_pack(l := l, r := rank)) AS o FROM (SELECT *, 0 AS l FROM s UNION ALL SELECT *, 1 AS l FROM f) GROUP BY id ORDER BY score DESC, o, id LIMIT 15)")
def hybrid(spark, d):
    semantic = v.similar(tables(spark, d, "embeddings"), "vec_id", "embedding", 5, 15)
    text = t.search(tables(spark, d, "benchmark"), "item_id", [("text", "commitMessage", 1.0)], "tion ertion", limit=15).withColumnRenamed("doc_id", "id")
    return _rounded(v.hybrid(semantic, text, 15))


@register("embedding_text", "SELECT p_partkey, left(concat_ws(chr(10), nullif(concat_ws(': ', nullif(trim(p_name), ''), nullif(trim(p_type), '')), ''), 'Package: ' || nullif(trim(p_brand), '')), 2048) AS t FROM part")
def embedding_text(spark, d):
    return tables(spark, d, "part").withColumn("none", F.lit(None).cast("string")).select("p_partkey", v.embedding_text("p_name", "p_type", "none", "p_brand").alias("t"))


@register("vector_round_trip", "SELECT vec_id, embedding FROM embeddings")
def vector_round_trip(spark, d):
    return tables(spark, d, "embeddings").select("vec_id", v.unpack(v.pack("embedding")).alias("embedding"))
