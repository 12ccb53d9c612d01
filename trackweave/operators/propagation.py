"""Constraint propagation: which identities each tracklet can't have, carried along links and through common frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.written import forget

#: Identities of a word: sets are bits of whole numbers, by (tracklet, word).
BITS = 62


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % BITS).cast("int"))


def propagate(tracklets: DataFrame, frames: DataFrame, links: DataFrame, write: Callable[[DataFrame], DataFrame], back: DataFrame | None = None) -> DataFrame:
    """Identity sets at their fixpoint: ``tracklet_id``, ``arena``, ``word``, ``no`` (bits excluded), ``ids`` (bits of all), ``decided``, ``round``.

    ``tracklets``: ``tracklet_id``, ``arena``, ``identity`` (from 0, null: undecided), ``single``, ``noise``, and
    ``total`` identities of the arena. ``frames``: a row for each frame of a tracklet. ``links`` (``a``, ``b``): the
    region graph; with ``back``, ``links`` carry forward only and those backward. A decided tracklet excludes all identities but its own, for itself, and its own for the
    undecided ones that share a frame with it. What all tracklets before one (noise left out) exclude, it can't
    have either, nor what all behind it exclude. An undecided single tracklet that one identity is left to is
    decided. Rounds look at the neighbours of tracklets that changed, and at the frames of those decided anew,
    all at once; ``round`` is the one that decided a tracklet (0: given). Sets only grow, so rounds end: at
    most one for each bit, in fact about the longest chain of links.

    If no tracklet runs out of identities, the sets are those of any sequential order. One that does is left
    undecided with all excluded (a conflict).
    """
    word = F.explode(F.sequence(F.lit(0), F.expr(f"(total - 1) DIV {BITS}").cast("int")))
    own = F.when(F.expr(f"identity DIV {BITS}") == F.col("word"), _bit(F.col("identity"))).otherwise(F.lit(0).cast("bigint"))
    here = F.least(F.lit(BITS), F.col("total") - F.col("word") * BITS)
    state = tracklets.withColumn("word", word).withColumn("ids", F.call_function("shiftleft", F.lit(1).cast("bigint"), here.cast("int")) - 1)
    state = state.withColumn("no", F.when(F.col("identity").isNotNull(), F.col("ids").bitwiseAND(F.bitwise_not(own))).otherwise(F.lit(0).cast("bigint")))
    given = F.col("identity").isNotNull()
    columns = ["tracklet_id", "arena", "single", "noise", "word", "ids", "no", "decided", "round", "fresh", "changed"]
    state = write(state.withColumns({"decided": given, "round": F.when(given, 0), "fresh": given, "changed": given}).select(columns))
    frames = write(frames.select("tracklet_id", "frame").join(tracklets.select("tracklet_id", "arena"), "tracklet_id"))
    links = write(links.select("a", "b").distinct())
    back = links if back is None else write(back.select("a", "b").distinct())
    turn = 0
    while state.filter("changed").limit(1).count():
        turn += 1
        moved = state.filter("changed").select("tracklet_id").distinct()
        add = _along(state, links, moved, "a", "b").unionByName(_along(state, back, moved, "b", "a")).unionByName(_beside(state, frames))
        add = add.groupBy("tracklet_id", "word").agg(F.bit_or("add").alias("add"))
        j = state.join(add, ["tracklet_id", "word"], "left")
        grown = F.when(F.col("decided") | F.col("add").isNull(), F.col("no")).otherwise(F.col("no").bitwiseOR(F.col("add")))
        j = j.withColumn("new", grown)
        left = write(j.select(*columns, "new", F.bit_count(F.col("ids").bitwiseAND(F.bitwise_not(F.col("new")))).alias("open")))
        open_ = left.groupBy("tracklet_id").agg(F.sum("open").alias("possible"))
        j = left.drop("open").join(open_, "tracklet_id")
        fresh = ~F.col("decided") & F.col("single") & (F.col("possible") == 1)
        last, state = state, write(j.select(
            "tracklet_id", "arena", "single", "noise", "word", "ids", F.col("new").alias("no"), (F.col("decided") | fresh).alias("decided"),
            F.when(fresh, turn).otherwise(F.col("round")).alias("round"), fresh.alias("fresh"), (fresh | (F.col("new") != F.col("no"))).alias("changed"),
        ))
        forget(last, left)
    return state.select("tracklet_id", "arena", "word", "no", "ids", "decided", "round")


def _along(state: DataFrame, links: DataFrame, moved: DataFrame, near: str, far: str) -> DataFrame:
    """What all neighbours on the side ``near`` exclude, for tracklets on the side ``far`` that have a changed one there."""
    asked = links.join(moved.withColumnRenamed("tracklet_id", near), near).select(far).distinct()
    around = links.join(asked, far).join(state.filter("NOT noise").select(F.col("tracklet_id").alias(near), "arena", "word", "no"), near)
    # an identity is one of its arena: neighbours of another exclude nothing here
    at = state.select(F.col("tracklet_id").alias(far), F.col("arena").alias("mine"), "word")
    around = around.join(at, [far, "word"]).withColumn("no", F.when(F.col("arena") == F.col("mine"), F.col("no")).otherwise(F.lit(0).cast("bigint")))
    return around.groupBy(F.col(far).alias("tracklet_id"), "word").agg(F.bit_and("no").alias("add"))


def _beside(state: DataFrame, frames: DataFrame) -> DataFrame:
    """Identities of tracklets decided anew, for those that share a frame with them; sets by frame first, so no pairs are made."""
    own = state.filter("fresh").select("tracklet_id", "word", F.col("ids").bitwiseAND(F.bitwise_not(F.col("no"))).alias("own"))
    there = frames.join(own, "tracklet_id").groupBy("arena", "frame", "word").agg(F.bit_or("own").alias("own"))
    return frames.join(there, ["arena", "frame"]).groupBy("tracklet_id", "word").agg(F.bit_or("own").alias("add"))
