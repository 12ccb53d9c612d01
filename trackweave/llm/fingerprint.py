"""Document fingerprints by winnowing (operator 4): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.llm import winnow

K, W = 4, 16
#: A word is cut after so many characters, so that a text without white space has words as well.
TOKEN = r"[^\s]{1,16}"
DOCS_PER_BUCKET, MOST_BUCKETS = 2_000, 10_000


def fingerprint(docs: DataFrame, text_col: str, out: str, *, k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: array of (hash, pos), the winnowed k-grams of the text's words in text order.

    Any ``k + w - 1`` words that two texts share give a hash that both keep. A text of fewer
    than ``k`` words keeps one hash of all its words; a text without words, empty or null,
    keeps none. Equal texts have equal fingerprints.
    """
    df = docs.withColumn("__words", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)))
    df = winnow.fingerprints(df, "__words", "__fp", k, w, short=True).drop("__words")
    return df.withColumn(out, F.transform("__fp", lambda x: F.struct(winnow.hashed(x).alias("hash"), winnow.position(x).alias("pos")))).drop("__fp")


def hashes(fp: str) -> Column:
    """The set of a fingerprint's hashes."""
    return F.array_distinct(F.transform(fp, lambda x: x["hash"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike (1), an empty and another are not (0)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``next_text``: the text of the next row by ascending id, after the last row the first.

    Rows go to ranges of ids once; each range also gets a copy of the next range's first row,
    so that no range needs another and no task holds the whole order. Null ids come first;
    rows of one id follow in the order of their texts. An empty table has no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, nulls, least = base.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull()), F.min("id")).first()
    buckets = max(1, min(MOST_BUCKETS, n // DOCS_PER_BUCKET))
    cuts: list = []
    if n > nulls:
        share = [i / buckets for i in range(1, buckets)]
        found = base.agg(F.percentile_approx("id", share, 100_000)).first()[0] if share else []
        cuts = sorted({*found} - {least})
    firsts = ([] if nulls else [least]) + cuts  # the first id of each range; nulls, if any, lead the first range
    rows = len(cuts) or 1
    side = max(1, round(rows**0.5))
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    kind = dict(docs.dtypes)[id_col]
    if cuts:  # the number of cuts at or below the id, found by blocks
        heads = F.lit([b[0] for b in blocks]).cast(f"array<{kind}>")
        block = F.size(F.filter(heads, lambda c: c <= F.col("id")))
        inner = F.size(F.filter(F.element_at(F.lit([[*b, *[b[-1]] * (side - len(b))] for b in blocks]).cast(f"array<array<{kind}>>"), F.greatest(block, F.lit(1))), lambda c: c <= F.col("id")))
        inner = F.least(inner, F.element_at(F.lit([len(b) for b in blocks]), F.greatest(block, F.lit(1))))
        bucket = F.when(F.col("id").isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * side + inner)
    else:
        bucket = F.lit(0)
    own = base.withColumn("bucket", bucket.cast("int")).withColumn("ghost", F.lit(False))
    is_first = F.col("id").isin(firsts) if firsts else F.lit(False)
    if nulls:
        is_first = is_first | F.col("id").isNull()
    # One row for each range, however many have its first id or none; each task finds its least first.
    first = own.filter(F.coalesce(is_first, F.lit(False))).groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("named"), "id", "text")).alias("r"))
    ghosts = first.select("r.id", "r.text", "bucket", F.lit(True).alias("ghost"))
    ghosts = ghosts.withColumn("bucket", F.when(F.col("bucket") == 0, F.lit(len(cuts))).otherwise(F.col("bucket") - 1))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), "text")
    return own.unionByName(ghosts).select("*", F.lead("text").over(order).alias("next_text"))


def edit_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last quarter (rounded down) replaced by the first as many characters
    of the next document. Null texts count as empty; a single document is its own next one;
    repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    df = with_next(docs, id_col, text_col)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), "text")
    df = fingerprint(df, "text", "fp", k=k, w=w).withColumn("set", hashes("fp"))
    df = df.withColumn("next_set", F.lead("set").over(order)).filter(~F.col("ghost"))
    df = df.withColumn("n", F.length("text")).withColumn("q", F.floor(F.col("n") / 4).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("q")), F.substring("next_text", F.lit(1), F.col("q"))))
    df = df.drop("text", "next_text")
    df = fingerprint(df, "edited", "efp", k=k, w=w).withColumn("eset", hashes("efp"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["pos"].cast("string"))), ",")
    return df.select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"),
        shown("efp").alias("edited_fingerprint"), likeness("set", "eset").alias("near_edited"), likeness("set", "next_set").alias("near_next"),
    )
