"""Closed-interval algebra on frames: range joins by buckets, sweeps, islands and conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 16


def islands(rows: DataFrame, key: str = "obj_id", frame: str = "frame", item: str = "region_id") -> DataFrame:
    """Maximal runs of consecutive frames of each key: ``tracklet_id`` (least item), start, end, n."""
    run = F.col(frame) - F.row_number().over(Window.partitionBy(key).orderBy(frame))
    out = rows.withColumn("run", run).groupBy(key, "run").agg(
        F.min(item).alias("tracklet_id"), F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count(F.lit(1)).alias("n"),
    )
    return out.drop("run")


def tracklet_regions(rows: DataFrame, key: str = "obj_id", frame: str = "frame", item: str = "region_id") -> DataFrame:
    """Each row with its run's ``tracklet_id`` and its place ``pos`` in it."""
    run = F.col(frame) - F.row_number().over(Window.partitionBy(key).orderBy(frame))
    w = Window.partitionBy(key, "run")
    rows = rows.withColumn("run", run)
    return rows.withColumn("tracklet_id", F.min(item).over(w)).withColumn("pos", F.row_number().over(w.orderBy(frame)) - 1).drop("run")


def _bucketed(df: DataFrame, start: Column, end: Column, bucket: int) -> DataFrame:
    lo, hi = F.floor(start / bucket), F.floor(end / bucket)
    return df.withColumn("__first", lo).withColumn("__bucket", F.explode(F.sequence(lo, hi)))


def overlap_join(a: DataFrame, b: DataFrame, *, on: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """Pairs of closed intervals (``start_frame``, ``end_frame``) that overlap; b's columns get the suffix 2.

    Each interval goes to the buckets that it covers and meets only those of the same bucket; a
    pair is taken in the later of the two first buckets, so it comes once and no pass removes
    copies. A point is an interval of one frame.
    """
    right = b.select(*[F.col(c).alias(f"{c}2") for c in b.columns])
    x = _bucketed(a, F.col("start_frame"), F.col("end_frame"), bucket)
    y = _bucketed(right, F.col("start_frame2"), F.col("end_frame2"), bucket).withColumnsRenamed({"__first": "__first2", "__bucket": "__bucket2"})
    same = F.col("__bucket") == F.col("__bucket2")
    for c in on or []:
        same = same & (F.col(c) == F.col(f"{c}2"))
    hit = (F.col("start_frame") <= F.col("end_frame2")) & (F.col("start_frame2") <= F.col("end_frame"))
    return x.join(y, same & hit & (F.col("__bucket") == F.greatest("__first", "__first2"))).drop("__first", "__first2", "__bucket", "__bucket2")


def overlap_summary(rows: DataFrame) -> DataFrame:
    """For each tracklet with overlaps: their number ``n``, least and greatest id ``lo`` and ``hi``, itself not counted.

    ``rows`` has a row for each frame of a tracklet (``tracklet_id``, ``frame``, ``pos`` from 0). Overlapping tracklets are
    those active at its start and those that start later within it, so no pairs are made: each frame gives its counts
    and its two least and greatest ids, one of which isn't the tracklet's own.
    """
    rows = rows.select("tracklet_id", "frame", "pos")
    per = rows.groupBy("frame").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("pos") == 0).alias("starts"), F.min("tracklet_id").alias("lo1"), F.max("tracklet_id").alias("hi1"))
    met = rows.join(per, "frame")
    inner = lambda f, end: f(F.when(F.col("tracklet_id") != F.col(end), F.col("tracklet_id")))
    second = met.groupBy("frame").agg(inner(F.min, "lo1").alias("lo2"), inner(F.max, "hi1").alias("hi2"))
    met = met.join(second, "frame")
    other = lambda k: F.when(F.col(f"{k}1") != F.col("tracklet_id"), F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    n = F.sum(F.when(F.col("pos") == 0, F.col("active")).otherwise(F.col("starts"))) - 1
    return met.groupBy("tracklet_id").agg(n.alias("n"), F.min(other("lo")).alias("lo"), F.max(other("hi")).alias("hi")).filter("n > 0")


def path_distances(rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Common frames ``n``, least distance ``min_dist`` and its first frame ``min_frame`` of two tracklets ``a`` and ``b``.

    All pairs that share a frame, a < b; or the given ``pairs`` in their own order, with 0, 99999 and -1 if they share none.
    """
    one = rows.select(F.col("tracklet_id").alias("a"), "frame", "x", "y")
    two = rows.select(F.col("tracklet_id").alias("b"), "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    if pairs is None:
        met = one.join(two, "frame").filter("a < b")
    else:
        pairs = pairs.select("a", "b").distinct()
        met = pairs.join(one, "a").join(two, ["b", "frame"])
    dist = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    got = met.withColumn("dist", dist).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dist", "frame")).alias("m"))
    got = got.select("a", "b", "n", F.col("m.dist").alias("min_dist"), F.col("m.frame").alias("min_frame"))
    if pairs is None:
        return got
    return pairs.join(got, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("min_dist", F.lit(99999.0)).alias("min_dist"), F.coalesce("min_frame", F.lit(-1)).alias("min_frame"))


def ordered_parts(df: DataFrame, keys: list[str | Column], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the number ``part`` of their range of the sort keys; written, so that the ranges stay the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str | Column], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with their place ``k`` in the order of the keys, from 0: numbered in ranges that are laid end to end."""
    rows = ordered_parts(df, keys, written)
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(until), F.lit(0)).alias("offset"))
    k = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return rows.join(F.broadcast(sizes), "part").withColumn("k", k).drop("part", "offset")


def neighbours(df: DataFrame, key: str, written: Callable[[DataFrame], DataFrame], total: str | None = None) -> DataFrame:
    """Rows with the key's values before and behind, ``prev`` and ``next``; with ``total``, that column's running sum ``running``."""
    rows = ordered_parts(df, [key], written)
    w, inner = Window.orderBy("part"), Window.partitionBy("part").orderBy(key)  # the first has one row for each range
    step = F.col(total) if total else F.lit(0)
    ends = rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(step).alias("sum"))
    before = F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("part", F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("behind"), before.alias("offset"))
    rows = rows.join(F.broadcast(ends), "part").withColumns({
        "prev": F.coalesce(F.lag(key).over(inner), "before"), "next": F.coalesce(F.lead(key).over(inner), "behind"),
        "running": F.col("offset") + F.sum(step).over(inner.rowsBetween(Window.unboundedPreceding, 0)),
    })
    return rows.drop("part", "before", "behind", "offset", *([] if total else ["running"]))


def active_counts(intervals: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Number of intervals that hold each stretch of frames between events: start, end, ``active``."""
    steps = intervals.selectExpr("start_frame AS frame", "1 AS step").unionByName(intervals.selectExpr("end_frame + 1 AS frame", "-1 AS step"))
    rows = neighbours(steps.groupBy("frame").agg(F.sum("step").alias("step")), "frame", written, "step")
    return rows.filter("next IS NOT NULL").select(F.col("frame").alias("start_frame"), (F.col("next") - 1).alias("end_frame"), F.col("running").alias("active"))


def complete_stretches(intervals: DataFrame, k: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stretches of frames in which exactly ``k`` intervals are active, with the sorted ids of their members."""
    full = active_counts(intervals, written).filter(F.col("active") == k)
    hits = overlap_join(full.select("start_frame", "end_frame"), intervals.select("tracklet_id", "start_frame", "end_frame"))
    return hits.groupBy("start_frame", "end_frame").agg(F.array_sort(F.collect_list("tracklet_id2")).alias("members"))


def conflicts(rows: DataFrame, key: str = "obj_id", frame: str = "frame") -> DataFrame:
    """Identities that are in one frame more than once."""
    return rows.groupBy(key, frame).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
