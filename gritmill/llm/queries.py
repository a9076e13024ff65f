"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritmill.llm import ego_join, license_scan, mixing, packing, pii, quality, rans, simhash, suffix_dedup, toxicity
from gritmill.llm.common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.ego_join(_read(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), Scratch(spark, "op3")).select("doc_id", "size", "source_size", "target", "taken")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_spans(_read(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"), Scratch(spark, "op9")).drop("spans")


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(_read(spark, sf_dir, "documents"), Scratch(spark, "op10"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ego_join, op2_pii, op3_mixing, op4_license, op5_repetition, op6_simhash, op7_packing, op8_toxicity, op9_suffix_dedup, op10_rans, pipeline)
    return {f.__name__: f for f in found}


_COSINE = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))"

OP1_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z) OR isinf(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE {_COSINE} >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT e.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = e.vec_id GROUP BY e.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ego_join": OP1_SQL}
