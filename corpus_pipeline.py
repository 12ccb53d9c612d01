"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trackweave.llm import decontaminate, langid, near_dup, packing, secret_scan
from trackweave.llm.scratch import cleared, removed, shared_dir

#: Languages that score less, as a mean over a text's positions, are rejected; four languages share 1.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language: those without letters, or alike unlikely in all, go."""
    got = langid.identify(docs)
    return got.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def _text_hash() -> Column:
    """A null text counts as an empty one, as in all stages."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id.

    Rows without an id all stay. Rows of one id are one document only if their texts are equal;
    if they differ, each text is a document of its own.
    """
    named = docs.filter("doc_id IS NOT NULL").withColumn("__th", _text_hash())
    ids = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("__th").alias("lo"), F.max("__th").alias("hi"))
    repeats, differ = ids.agg(F.max(F.col("n") > 1), F.max(F.col("lo") != F.col("hi"))).first()
    named = named.withColumn("__key", _ordered_key(docs) if differ else F.col("doc_id"))
    kept = near_dup.near_duplicates(named, id_col="__key").filter("kept").select("__key").distinct()
    few = kept.count() <= near_dup.BROADCAST_IDS
    rows = named.join(F.broadcast(kept) if few else kept, "__key", "left_semi")
    rows = rows.dropDuplicates(["doc_id", "__th"]) if repeats else rows
    return rows.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def _ordered_key(docs: DataFrame) -> Column:
    """Id and text hash as one string, in the order of the ids."""
    if isinstance(docs.schema["doc_id"].dataType, StringType):
        return F.concat_ws("\0", "doc_id", F.lpad(F.hex("__th"), 16, "0"))
    unsigned = F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.lpad(F.hex(unsigned), 16, "0"), F.lpad(F.hex("__th"), 16, "0"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; others of the same id, or without one, stay."""
    hit = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("spans") > 0)
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("th").alias("__hit")).distinct()
    few = hit.count() <= near_dup.BROADCAST_IDS
    rows = docs.withColumn("__th", _text_hash())
    return rows.join(F.broadcast(hit) if few else hit, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hit")), "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that aren't widely copied examples are blotted out; documents stay."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secrets), ("packing", pack)]
#: SQL can't express the network, the tokenizer and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    A stage's own tables go when it has written its result, and its input when the next has been read;
    after a failure too. Only the last result stays, for the caller. Defined cases: an empty table gives no
    rows; a missing ``benchmark`` is an error.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        try:
            with cleared(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        finally:
            if i:
                removed(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
