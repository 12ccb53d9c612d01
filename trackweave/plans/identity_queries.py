"""Queries of identities: sets propagated to a fixpoint, conflicts, and what is left to decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import graph, intervals, kernels, tracks
from trackweave.operators.propagation import BITS, propagate
from trackweave.plans import set_queries
from trackweave.plans.dense_queries import ARENA, NOISE, SINGLE, _classes
from trackweave.plans.queries import _written, query
from trackweave.session import reach_workers
from trackweave.sources import tables as S


def _propagated(spark, d) -> DataFrame:
    """Identity sets of all tracklets: objects are an arena's identities; tracklets of several frames are decided."""
    write = _written(spark)
    rows = intervals.tracklet_regions(S.unique_detections(spark, d)).withColumn("arena", F.expr(f"obj_id DIV {ARENA}").cast("int"))
    rows = write(rows)
    t = rows.groupBy("tracklet_id", "arena", "obj_id").agg(F.count(F.lit(1)).alias("n")).join(_classes(spark, d), "tracklet_id")
    single = F.col("label") == SINGLE
    t = t.select(
        "tracklet_id", "arena", single.alias("single"), (F.col("label") == NOISE).alias("noise"), F.lit(ARENA).alias("total"),
        F.when(F.col("n") >= set_queries.DECIDED, F.col("obj_id") % ARENA).alias("identity"),
    )
    t = write(t)
    ends = write(set_queries._ends(spark, d).join(t.select("tracklet_id", "arena", "noise"), "tracklet_id"))
    first = ends.select("arena", "noise", (F.col("start_frame") - 1).alias("f"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("tracklet_id").alias("b"))
    last = ends.select("arena", "noise", F.col("end_frame").alias("f"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("tracklet_id").alias("a"))
    return propagate(t, rows.select("tracklet_id", "frame"), _telling_links(last, first), write, _telling_links(first, last))


def _telling_links(near: DataFrame, far: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) to tracklets ``far`` whose neighbours ``near``, noise left out, are all of their own arena.

    One neighbour of another arena excludes nothing, and then all together don't; such tracklets need no links. Ends are compared by place.
    """
    there = near.filter("NOT noise").withColumnsRenamed({"x": "u", "y": "v"}).drop("noise")
    at = there.groupBy("f", "u", "v").agg(F.min("arena").alias("lo"), F.max("arena").alias("hi"))
    seen = graph.around(far.select("f", "x", "y").distinct(), at, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = far.join(seen, ["f", "x", "y"]).filter("lo = arena AND hi = arena").drop("lo", "hi", "noise")
    return graph.near(own, there, on=["arena"]).select("a", "b")


@query()
def propagated_identities(spark, d):
    """Identities that each tracklet can't have, at the fixpoint of links, frames and single ones left (G25, U4): the number excluded, the identity if decided, and the round that decided it.

    A conflict has no identity left.
    """
    s = _propagated(spark, d)
    left = F.col("ids").bitwiseAND(F.bitwise_not(F.col("no")))
    t = s.groupBy("tracklet_id", "decided", "round").agg(F.sum(F.bit_count("no")).alias("excluded"), F.sum(F.bit_count(left)).alias("possible"), F.max(F.when(left != 0, F.col("word") * BITS + F.round(F.log2(left)).cast("int"))).alias("top"))
    return t.select("tracklet_id", "decided", "round", "excluded", "possible", F.when(F.col("possible") == 1, F.col("top")).alias("identity"), (F.col("possible") == 0).alias("conflict"))


@query()
def matched_tracks(spark, d):
    """Tracks of each arena: complete sets matched in time order (G22), groups matched to the largest (G23), leftovers with prohibited
    identities (G24), by prototypes of their regions (X32, A15, A16, A18). ``how`` is the step that joined a tracklet, null if none did.

    Matching is ordered within an arena, so an arena is one group: its few objects' tracklets and their regions' descriptors.
    """
    reach_workers(spark)
    rows = intervals.tracklet_regions(S.unique_detections(spark, d)).withColumn("arena", F.expr(f"obj_id DIV {ARENA}").cast("int"))
    look = S.regions(spark, d).select("region_id", F.array(F.col("area") / 50, F.col("margin") / 3, F.col("min_intensity") / 80).alias("look"))
    rows = _written(spark)(rows.join(look, "region_id").select("arena", "tracklet_id", "frame", "x", "y", "look"))
    at = F.array("x", "y")
    t = rows.groupBy("arena", "tracklet_id").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.min_by(at, "frame").alias("head"), F.max_by(at, "frame").alias("tail"), F.sort_array(F.collect_list(F.struct("frame", "look"))).alias("looks"))
    t = t.select("arena", F.struct("tracklet_id", "start", "end", "head", "tail", F.col("looks.look").alias("looks")).alias("t"))
    active = rows.groupBy("arena", "frame").agg(F.sort_array(F.collect_set("tracklet_id")).alias("members"))
    most = active.groupBy("arena").agg(F.max(F.size("members")).alias("k"))
    sets = active.join(most, "arena").filter(F.size("members") == F.col("k")).groupBy("arena", "members").agg(F.min("frame").alias("frame"))
    each = t.groupBy("arena").agg(F.collect_list("t").alias("tracklets")).join(sets.groupBy("arena").agg(F.sort_array(F.collect_list(F.struct("frame", "members"))).alias("sets")), "arena")

    def match(batches):
        for b in batches:
            out = []
            for arena, tracklets, sets in zip(b["arena"], b["tracklets"], b["sets"], strict=True):
                known = [
                    tracks.Tracklet(x["tracklet_id"], x["start"], x["end"], tuple(x["head"]), tuple(x["tail"]), kernels.prototypes(np.array([list(v) for v in x["looks"]], float)))
                    for x in tracklets
                ]
                got, groups = tracks.solve(known, [list(map(int, s["members"])) for s in sets], reach=set_queries.REACH, neutral=set_queries.NEUTRAL, accepted=set_queries.ACCEPTED)
                out += [(int(arena), k.id, got.of(k.id), got.how.get(k.id), len(groups)) for k in known]
            yield pd.DataFrame(out, columns=["arena", "tracklet_id", "track_id", "how", "groups"])

    return each.mapInPandas(match, "arena int, tracklet_id bigint, track_id bigint, how string, groups int")
