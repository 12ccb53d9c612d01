"""Token counts through a digest cache (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import token_memo
from trackweave.llm.scratch import lean, small_batches
from trackweave.session import reach_workers

#: Each tokenizer version is a partition of the stored table, so another version's counts aren't read.
CACHE_SCHEMA = "digest string, n_tokens bigint, tokenizer string"


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version: ``digest``, ``n_tokens``. A cache that isn't there yet is empty."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    rows = rows.filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have added the same text


def packed_texts(texts: DataFrame) -> DataFrame:
    """Texts (``digest``, ``text``) as zstandard frames: ``digest``, ``packed``. They are shuffled so, as each is read at most once behind it."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [press.compress(t.as_py().encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(packed, pa.binary())], ["digest", "packed"])

    return texts.mapInArrow(lean(squeeze), "digest string, packed binary")


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count each text's tokens; one row for each input row: the id, ``n_bytes``, ``n_tokens``.

    Texts are joined by SHA-256 digest to the counts stored for this tokenizer version under the
    path ``cache``. Only distinct texts that miss are encoded, and their counts are appended. A
    text counts as it is, without normalising, since any change could change its tokens.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row;
    an empty table gives none; other columns are ignored. Copies are dropped before the shuffle
    in each task, texts are shuffled compressed, and a hot digest's rows are only ids and numbers when they meet its count.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    small_batches(spark)
    version = token_memo.version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text, 256).alias("digest")
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), digest)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            counts = [token_memo.byte_level_count(tokenizer_path, press.decompress(t.as_py()).decode()) for t in b.column("packed")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    texts = packed_texts(docs.select(digest, text.alias("text"))).dropDuplicates(["digest"])
    misses = texts.join(cached_counts(spark, cache, version), "digest", "left_anti")
    new = misses.mapInArrow(lean(encode), "digest string, n_tokens bigint")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    return rows.join(cached_counts(spark, cache, version), "digest").select(id_col, "n_bytes", "n_tokens")
