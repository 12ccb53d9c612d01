"""Line dedup (operator 11), native: levelled sorted runs of line hashes.

A batch of documents becomes a run: the hashes of its distinct lines, each with the number of the
batch's documents that hold it, in buckets and sorted. ``fan`` runs of a level are merged into one of
the next (full outer merge joins; two tables of equal buckets meet without a shuffle): hashes
that have reached the limit are ``common``, the others stay ``open``. A new batch is anti-joined with
the common hashes, which are decided, and adds the rest as its own run. At the end the open runs are
merged once more: each hash that isn't common yet has all its documents in them, so the sums are exact.

Lines are known by 128 bits of hash: two of a million million distinct lines meet with a chance of 1e-15.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.scratch import shared_dir, stored

#: Documents that hold a common line at least, and code points of a key at least.
LIMIT, LEAST = 10, 1
#: Runs of a level that are merged, and batches that a table given at once is dealt into.
FAN, BATCHES = 2, 4
#: Common lines that are broadcast at most: the most frequent ones. Others are found by a shuffled join.
BROADCAST_LINES = 100_000

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """Keys of a text's lines in order: white space at both ends stripped, A-Z lower-cased."""
    return F.transform(F.split(F.translate(text, _UPPER, _LOWER), "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.lit(1), F.col(key)).alias("g")]


class LineRuns:
    """Runs of line hashes in the shared folder, by level.

    A run is two bucketed tables, ``open`` and ``common``, of ``h``, ``g`` and the number of documents
    ``n``. Its folder is named by its level and the first and last batch that it covers, so a session
    that opens the folder again finds all complete runs, and takes none that a larger one has replaced.
    """

    def __init__(self, spark: SparkSession, *, folder: str | None = None, limit: int = LIMIT, fan: int = FAN, buckets: int | None = None):
        if fan < 2:
            raise ValueError("a merge takes two runs at least")
        self.spark, self.limit, self.fan = spark, limit, fan
        self.folder = (folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[tuple[int, int, int], str] = {}
        self.batches = 0
        for level, first, last in sorted(self._complete(), key=lambda r: (-r[0], r[1])):
            if not any(f <= first and last <= t for _, f, t in self.names):
                self._register((level, first, last))
                self.batches = max(self.batches, last + 1)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self) -> list[tuple[int, int, int]]:
        """Runs in the folder both of whose tables were written to the end."""
        fs, at = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        runs = [n for n in names if re.fullmatch(r"\d+-\d+-\d+", n)]
        done = lambda n, part: fs.exists(self._fs(f"{self.folder}/{n}/{part}/_SUCCESS")[1])
        return [tuple(map(int, n.split("-"))) for n in runs if done(n, "open") and done(n, "common")]

    def _register(self, run: tuple[int, int, int]) -> None:
        name = self.names[run] = f"line_runs_{uuid.uuid4().hex}"
        for part in ("open", "common"):
            path = f"{self.folder}/{'-'.join(map(str, run))}/{part}"
            buckets = f"CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{part} (h BIGINT, g BIGINT, n BIGINT) USING parquet {buckets} LOCATION '{path}'")

    def _write(self, run: tuple[int, int, int], opened: DataFrame, common: DataFrame) -> None:
        name = f"line_runs_{uuid.uuid4().hex}"
        for part, rows in (("open", opened), ("common", common)):
            path = f"{self.folder}/{'-'.join(map(str, run))}/{part}"
            rows.write.format("parquet").bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", path).saveAsTable(f"{name}_{part}")
        self.names[run] = name

    def _forget(self, runs: list[tuple[int, int, int]]) -> None:
        for run in runs:
            name = self.names.pop(run)
            for part in ("open", "common"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
            fs, at = self._fs(f"{self.folder}/{'-'.join(map(str, run))}")
            fs.delete(at, True)

    def add(self, counts: DataFrame) -> None:
        """Add a batch as a run. ``counts``: its distinct lines' ``h`` and ``g``, and their numbers of documents ``n``."""
        fresh = counts.select("h", "g", "n").repartition(self.buckets, "h", "g")
        for name in self.names.values():
            fresh = fresh.join(self.spark.table(f"{name}_common").hint("merge"), ["h", "g"], "left_anti")
        self._write((0, self.batches, self.batches), fresh.filter(F.col("n") < self.limit), fresh.filter(F.col("n") >= self.limit))
        self.batches += 1
        level = 0
        while len(mine := sorted(r for r in self.names if r[0] == level)) >= self.fan:
            self._merge(mine)
            level += 1

    def _files(self, run: tuple[int, int, int], part: str) -> DataFrame:
        """A run's table read by its path, without its buckets."""
        return self.spark.read.schema("h bigint, g bigint, n bigint").parquet(f"{self.folder}/{'-'.join(map(str, run))}/{part}")

    def _merge(self, runs: list[tuple[int, int, int]]) -> None:
        """One run of the next level. A hash may stay open in it that is common by another run; only those that reach the limit move."""
        opened = reduce(_added, [self.spark.table(f"{self.names[r]}_open") for r in runs])
        known = reduce(DataFrame.unionByName, [self._files(r, "common") for r in runs], opened.filter(F.col("n") >= self.limit))
        self._write((runs[0][0] + 1, runs[0][1], runs[-1][2]), opened.filter(F.col("n") < self.limit), _summed(known))
        self._forget(runs)

    def common(self) -> DataFrame:
        """Hashes of all lines that ``limit`` documents hold: ``h``, ``g``, and ``n``, documents counted until that was known."""
        tables = [self._files(r, part) for r in self.names for part in ("open", "common")]
        none = self.spark.createDataFrame([], "h bigint, g bigint, n bigint")
        return _summed(reduce(DataFrame.unionByName, tables)).filter(F.col("n") >= self.limit) if tables else none

    def drop(self) -> None:
        """Remove all runs and the folder."""
        self._forget(list(self.names))
        fs, at = self._fs(self.folder)
        fs.delete(at, True)


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs merged: hashes of either, their numbers of documents added."""
    both = a.hint("merge").join(b.withColumnRenamed("n", "n2"), ["h", "g"], "full")
    return both.select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("h", "g").agg(F.sum("n").alias("n"))


def line_counts(docs: DataFrame, batches: int = 1, least: int = LEAST) -> DataFrame:
    """Distinct lines of each batch of documents (``text``): ``batch``, ``h``, ``g``, and the number of documents ``n``."""
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda x: F.length(x) >= least))
    rows = docs.select(F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key"))
    return rows.select("batch", *_hashes("key")).groupBy("batch", "h", "g").agg(F.count(F.lit(1)).alias("n"))


def _hits(lines: DataFrame, common: DataFrame, most: int) -> DataFrame:
    """Lines (``h``, ``g``, ...) that are common. The most frequent ``most`` are broadcast, so no hot line is a join key; the rest is shuffled."""
    if common.count() <= most:
        return lines.join(F.broadcast(common.select("h", "g")), ["h", "g"], "left_semi")
    rank = [F.col("n").desc(), "h", "g"]
    hot = common.orderBy(*rank).limit(most).select("h", "g", F.lit(True).alias("hot"))
    flagged = lines.join(F.broadcast(hot), ["h", "g"], "left")
    # Lines found already travel under a key of their own, which spreads them.
    flagged = flagged.withColumn("h", F.when(F.col("hot"), F.xxhash64("id", "th", "pos")).otherwise(F.col("h")))
    known = common.select("h", "g", F.lit(True).alias("rare"))
    return flagged.join(known, ["h", "g"], "left").filter(F.col("hot") | F.col("rare"))


def drop_common_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, least: int = LEAST,
    batches: int = BATCHES, fan: int = FAN, most_broadcast: int = BROADCAST_LINES,
) -> DataFrame:
    """Texts without the lines that ``limit`` documents or more hold: the id, ``n_lines``, ``n_dropped``, ``text``.

    Lines are compared by their key, stripped and lower-cased; keys of fewer than ``least`` code points
    are never dropped. A common line goes from every document, each time it occurs.

    Defined cases: a null or empty text is one empty line; each row is one document, so repeated rows
    count each and get a row each; null ids are as good as others; ids and texts of any length pass whole;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, runs = line_counts(docs, batches, least), LineRuns(spark, limit=limit, fan=fan)
    path = f"{runs.folder}/counts"
    counts.write.partitionBy("batch").parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    try:
        for i in range(batches):
            runs.add(counts.filter(F.col("batch") == i))
        common = stored(runs.common(), "common-lines")
    finally:
        runs.drop()
    key = docs.withColumn("th", F.xxhash64("text"))
    lines = key.select("id", "th", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).filter(F.length("key") >= least)
    hits = _hits(lines.select("id", "th", "pos", *_hashes("key")), common, most_broadcast)
    hits = hits.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("pos").alias("drops"))
    out = key.join(hits, key["id"].eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    out = out.select("id", F.split("text", "\n", -1).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    return out.select(F.col("id").alias(id_col), F.size("lines").cast("bigint").alias("n_lines"), F.size("drops").cast("bigint").alias("n_dropped"), kept.alias(text_col))
