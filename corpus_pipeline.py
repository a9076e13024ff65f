"""A training-data pipeline of five stages; each is written as Parquet to the shared folder and read again by the next.

Quality rules, SimHash near-dedup, personal data, mixing to target weights, packing. All but the last return the columns
of the documents they get; each works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritmill.llm import mixing, packing, pii, quality, simhash
from gritmill.llm.common import Scratch, sorted_join
from gritmill.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    names = {c: f"kept_{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    names |= {"doc_id": "doc_id", "text": "kept_text"}
    return quality.repetition_rules(docs, keep=tuple(docs.columns)).where("kept").select(*(F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group of rows: the one with the smallest doc_id (null last), then hashes of text and row.

    Every row is grouped by its own text (told by its hash), whether its doc_id is null or repeated.
    """
    rows = docs.withColumn("near_t", F.xxhash64("text")).withColumn("near_r", F.xxhash64(*docs.columns))
    groups = simhash.simhash_groups(rows, Scratch(spark, "pipeline"), id_col="near_t").select(F.col("doc_id").alias("near_t"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "near_t", "near_r")
    least = rows.groupBy("near_t").agg(F.min(order).alias("o"))
    first = least.join(sorted_join(groups), "near_t").groupBy("component_id").agg(F.min("o").alias("o")).select("o.near_t", "o.near_r")
    # of rows equal in all columns one stays
    return rows.join(sorted_join(first), ["near_t", "near_r"], "left_semi").dropDuplicates(["near_t", "near_r"]).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    out = pii.redact(docs, Scratch(spark, "pipeline"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, and for a part its first words, white space kept."""
    taken = mixing.mix(docs, Scratch(spark, "pipeline")).where("taken > 0")
    keys = taken.select("doc_id", "text_hash", F.element_at("sources", 1).alias("of"), "size", "taken").withColumn("n", F.row_number().over(_order("doc_id", "text_hash", "of", "taken")))
    keys = keys.select(*(F.col(c).alias(f"mix_{c}") for c in keys.columns))
    rows = docs.withColumn("mix_h", F.xxhash64("text"))
    rows = rows.withColumn("mix_row", F.row_number().over(_order("doc_id", "mix_h", "source", "mix_h")))
    same = F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & (F.col("mix_h") == F.col("mix_text_hash")) & F.col("source").cast("string").eqNullSafe(F.col("mix_of"))
    found = rows.join(keys, same & (F.col("mix_row") == F.col("mix_n")))
    part = F.col("mix_taken") % F.col("mix_size")
    times = F.concat(F.array_repeat("mix_size", F.floor(F.col("mix_taken") / F.col("mix_size")).cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = found.withColumn("mix_words", F.explode(times))
    # the first `words` words: pieces between words are longer by one than words
    n = F.col("mix_words").cast("int")
    gaps, words = F.split("text", mixing.WORD, -1), F.regexp_extract_all("text", F.lit(mixing.WORD), 0)
    some = F.array_join(F.zip_with(F.slice(gaps, 1, n), F.slice(words, 1, n), lambda g, w: F.concat(g, w)), "")
    text = F.when(F.col("mix_words") == F.col("mix_size"), F.col("text")).otherwise(some)
    out = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _order(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols[:3]).orderBy(cols[3])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents' token ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("simhash", drop_near_copies), ("pii", hide_private), ("mixing", mix_sources), ("packing", pack_windows)]

#: SQL expresses neither fingerprints, weak supervision nor tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's rows."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        after = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
