"""Boxes that touch, merged until none do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.components import connected_components

#: Side of the cells in which boxes are compared in pairs.
CELL = 20


def _cells(b: DataFrame, size: int, inner: bool) -> DataFrame:
    """A row for each cell that a box touches, or (``inner``) for each multiple of ``size`` that it holds."""
    first = (lambda c: F.ceil(F.col(c) / size)) if inner else (lambda c: F.floor(F.col(c) / size))
    span = lambda a, z: F.filter(F.sequence(first(a), F.greatest(first(a), F.floor(F.col(z) / size))), lambda i: i * size <= F.col(z))
    return b.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def _at_points(b: DataFrame, size: int) -> DataFrame:
    """Links of boxes that hold one point of a lattice, each with the first of them: as many as boxes, however many lie there."""
    at = _cells(b, size, True)
    first = at.groupBy("frame", "cx", "cy").agg(F.min("box_id").alias("a"))
    return at.join(first, ["frame", "cx", "cy"]).select("a", F.col("box_id").alias("b")).filter("a <> b").distinct()


def _in_pairs(b: DataFrame, size: int) -> DataFrame:
    """Links of all boxes that touch, found by the cells that they lie in."""
    c = _cells(b, size, False)
    other = c.select("frame", "cx", "cy", *[F.col(x).alias(f"{x}b") for x in ("box_id", "x1", "y1", "x2", "y2")])
    meet = (F.col("box_id") < F.col("box_idb")) & (F.col("x1") <= F.col("x2b")) & (F.col("x1b") <= F.col("x2")) & (F.col("y1") <= F.col("y2b")) & (F.col("y1b") <= F.col("y2"))
    once = (F.col("cx") == F.floor(F.greatest("x1", "x1b") / size)) & (F.col("cy") == F.floor(F.greatest("y1", "y1b") / size))
    return c.join(other, ["frame", "cx", "cy"]).filter(meet & once).select(F.col("box_id").alias("a"), F.col("box_idb").alias("b"))


def merged_boxes(boxes: DataFrame, write: Callable[[DataFrame], DataFrame], size: int = CELL) -> DataFrame:
    """Boxes that touch replaced by the box around them, until none touch: the same columns, with ``n`` merged and the least ``box_id``.

    ``boxes``: ``frame``, ``box_id`` (unique) and the corners ``x1``, ``y1``, ``x2``, ``y2``; edges count, so boxes that
    share a corner touch. Merging only grows boxes, so any order ends at the same ones. A round finds the
    components of touching boxes: first those that share a lattice point (crowds, without pairs), from a
    coarse lattice to a fine one, then the rest in pairs. The rounds end when no pair touches, at most with one box a frame.
    """
    b = write(boxes.select("frame", "box_id", "x1", "y1", "x2", "y2", F.lit(1).cast("bigint").alias("n")))
    steps = [lambda x: _at_points(x, size), lambda x: _at_points(x, max(1, size // 4)), lambda x: _in_pairs(x, size)]
    at = 0
    while at < len(steps):
        links = write(steps[at](b))
        if not links.limit(1).count():
            at += 1
            continue
        found = connected_components(links, write)
        named = b.join(found, b["box_id"] == found["vertex"], "left").withColumn("box_id", F.coalesce("component", "box_id"))
        b = write(named.groupBy("frame", "box_id").agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"), (F.sum, "n"))]))
    return b
