"""Queries that match sets, samples and ranges: across complete sets, over permutations, by certainty; and the conflicts that remain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.operators import intervals, kernels
from trackweave.plans import set_queries
from trackweave.plans.dense_queries import tracking_ranges
from trackweave.plans.queries import QUERIES, SQL, _r, _written, query
from trackweave.plans.set_queries import _ALL, _CENTRES, _EXCLUDED, _SETS, _SHARES, _WIDTH, DECIDED
from trackweave.session import reach_workers
from trackweave.sources import tables as S

_NORMAL = f"f AS (SELECT tracklet_id, {_SHARES} FROM tre), q AS (SELECT tracklet_id, [{', '.join(f'avg(e{i} / ({" + ".join(f"e{j}" for j in _ALL)}))' for i in _ALL)}] AS p FROM f GROUP BY 1), k AS (SELECT tracklet_id, p, list_position(p, list_max(p)) AS k FROM q)"


def _probabilities(spark, d):
    """Mean probability of each identity over a tracklet's regions ``p``, and the likeliest one ``k`` (from 1)."""
    rows = intervals.tracklet_regions(S.unique_detections(spark, d)).select("tracklet_id", "y")
    e = [F.exp(-F.abs(F.col("y") - c) / _WIDTH) for c in _CENTRES]
    total = sum(e[1:], e[0])
    p = rows.groupBy("tracklet_id").agg(F.array(*[F.avg(x / total) for x in e]).alias("p"))
    return p.withColumn("k", F.array_position("p", F.array_max("p")).cast("int"))


@query(f"""WITH {_SETS}, {_NORMAL} SELECT a.cs, a.tracklet_id AS a, b.tracklet_id AS b, round(greatest(x.p[x.k] * y.p[x.k], x.p[y.k] * y.p[y.k]), 6) AS likeness
FROM mem a JOIN mem b ON b.cs = a.nxt JOIN k x ON x.tracklet_id = a.tracklet_id JOIN k y ON y.tracklet_id = b.tracklet_id""", "tre te")
def classifier_matching(spark, d):
    """How alike the tracks of successive complete sets are by their identities' probabilities: the better agreement on the likeliest identity of either."""
    m, p = set_queries._members(spark, d).select("cs", "nxt", "tracklet_id"), _written(spark)(_probabilities(spark, d))
    m = _written(spark)(m.join(p, "tracklet_id"))
    other = m.select(F.col("cs").alias("nxt"), F.col("tracklet_id").alias("b"), F.col("p").alias("q"), F.col("k").alias("j"))
    at = lambda v, i: F.element_at(v, F.col(i))
    both = m.select("cs", "nxt", F.col("tracklet_id").alias("a"), "p", "k").join(other, "nxt")
    return both.select("cs", "a", "b", _r(F.greatest(at("p", "k") * at("q", "k"), at("p", "j") * at("q", "j")), 6).alias("likeness"))


@query("""WITH s AS (SELECT g.frame, g.id // 2 AS pair, g.id % 2 AS side, g.x, g.y, p.x AS px, p.y AS py FROM gt g JOIN pred p ON p.frame = g.frame AND p.id = g.id),
t AS (SELECT a.frame, a.pair, sqrt((a.x - a.px) ** 2 + (a.y - a.py) ** 2) AS aa, sqrt((b.x - b.px) ** 2 + (b.y - b.py) ** 2) AS bb, sqrt((a.x - b.px) ** 2 + (a.y - b.py) ** 2) AS ab, sqrt((b.x - a.px) ** 2 + (b.y - a.py) ** 2) AS ba FROM s a JOIN s b ON b.frame = a.frame AND b.pair = a.pair AND a.side = 0 AND b.side = 1)
SELECT frame, pair, ab + ba < aa + bb AS swapped, round(least(aa + bb, ab + ba) / 2, 6) AS error FROM t""", "gt pred")
def permuted_errors(spark, d):
    """Samples of two objects: whether the predictions fit better the other way round, and the mean distance of the better way."""
    g = S.ground_truth(spark, d)
    p = S.predictions(spark, d).select("frame", "id", F.col("x").alias("px"), F.col("y").alias("py"))
    s = g.join(p, ["frame", "id"]).withColumns({"pair": F.expr("id DIV 2").cast("int"), "side": F.col("id") % 2})
    place = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}{k}")
    t = s.groupBy("frame", "pair").agg(F.count(F.lit(1)).alias("n"), *[place(k, c) for k in (0, 1) for c in ("x", "y", "px", "py")]).filter("n = 2")
    far = lambda i, j: F.sqrt((F.col(f"x{i}") - F.col(f"px{j}")) ** 2 + (F.col(f"y{i}") - F.col(f"py{j}")) ** 2)
    same, other = far(0, 0) + far(1, 1), far(0, 1) + far(1, 0)
    return t.select("frame", "pair", (other < same).alias("swapped"), _r(F.least(same, other) / 2, 6).alias("error"))


@query(f"""SELECT tracklet_id, identity, certainty FROM ({SQL["identity_certainties"]}) c WHERE tracklet_id IN (SELECT tracklet_id FROM ({SQL["tracklets"]}) t WHERE n < {DECIDED})
ORDER BY certainty DESC, tracklet_id, identity LIMIT 1""")
def surest_tracklet(spark, d):
    """The undecided tracklet and identity of the greatest certainty, to be decided next (K5); ties: the least."""
    open_ = intervals.islands(S.unique_detections(spark, d)).filter(F.col("n") < DECIDED).select("tracklet_id")
    c = QUERIES["identity_certainties"](spark, d).join(open_, "tracklet_id")
    best = c.agg(F.max(F.struct("certainty", (-F.col("tracklet_id")).alias("t"), (-F.col("identity")).alias("i"))).alias("b")).filter("b IS NOT NULL")
    return best.selectExpr("-b.t AS tracklet_id", "-b.i AS identity", "b.certainty")


@query(f"""WITH {_EXCLUDED}, ids AS (SELECT DISTINCT obj_id FROM tr), fr AS (SELECT DISTINCT frame FROM du), at_ AS (SELECT e.frame, t.tracklet_id, t.obj_id, t.n FROM tre e JOIN tr t USING (tracklet_id)),
open_ AS (SELECT frame, obj_id FROM at_ WHERE n >= {DECIDED} UNION SELECT a.frame, i.obj_id FROM at_ a, ids i WHERE a.n < {DECIDED} AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.tracklet_id = a.tracklet_id AND ex.obj_id = i.obj_id))
SELECT 'own identity excluded' AS kind, (SELECT count(*) FROM tr t JOIN ex ON ex.tracklet_id = t.tracklet_id AND ex.obj_id = t.obj_id WHERE t.n >= {DECIDED}) AS n
UNION ALL SELECT 'identity impossible in a frame', (SELECT count(*) FROM fr) * (SELECT count(*) FROM ids) - (SELECT count(*) FROM open_)
UNION ALL SELECT 'identity twice in a frame', (SELECT count(*) FROM (SELECT 1 FROM det GROUP BY obj_id, frame HAVING count(*) > 1))""", "tr tre det")
def conflict_report(spark, d):
    """Three kinds of conflicts, counted: decided tracklets that exclude their own identity, identities that no tracklet of a frame can have, identities twice in a frame.

    What tracklets of a frame leave possible is put together as bits, once for each span of frames, so frames and identities make no pairs.
    """
    write = _written(spark)
    spans = write(set_queries._spans(spark, d))
    words = spans.select("obj_id").distinct().groupBy(set_queries._word()).agg(F.bit_or(set_queries._bit()).alias("ids"))
    # words are as many as identities / 62; all tasks have them
    each = spans.filter("NOT decided").select("start_frame", "end_frame").distinct().crossJoin(F.broadcast(words))
    free = each.join(set_queries._excluded(spans), ["start_frame", "end_frame", "word"], "left").withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    free = free.select("frame", "word", F.col("ids").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint")))).alias("bits"))
    open_ = set_queries._decided_bits(spans).unionByName(free).groupBy("frame", "word").agg(F.bit_or("bits").alias("open")).agg(F.coalesce(F.sum(F.bit_count("open")), F.lit(0)).alias("open"))
    frames = S.detections(spark, d).select("frame").distinct().agg(F.count(F.lit(1)).alias("f"))
    all_ = frames.crossJoin(words.agg(F.coalesce(F.sum(F.bit_count("ids")), F.lit(0)).alias("k"))).crossJoin(open_).select(F.lit("identity impossible in a frame").alias("kind"), (F.col("f") * F.col("k") - F.col("open")).alias("n"))
    w = Window.partitionBy("obj_id").orderBy("start_frame", "tracklet_id")
    met = (F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start_frame")) | (F.lead("start_frame").over(w) <= F.col("end_frame"))
    against = spans.filter("decided").withColumn("met", met).filter("met")
    twice = intervals.conflicts(S.detections(spark, d))
    count = lambda t, kind: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(against, "own identity excluded").unionByName(all_).unionByName(count(twice, "identity twice in a frame"))


@query()
def range_matches(spark, d):
    """Detections at the end of each forward tracking range matched to those of the next frame, at the least summed distance.

    A range's end is one group: a square of the objects that are visible at once.
    """
    reach_workers(spark)
    ends = tracking_ranges(spark, d).filter("forward").select(F.col("to_frame").alias("frame")).distinct()
    rows = _written(spark)(S.unique_detections(spark, d).select("region_id", "frame", "x", "y"))
    last = rows.join(ends, "frame").select("frame", "region_id", "x", "y", F.lit(0).alias("side"))
    first = rows.withColumn("frame", F.col("frame") - 1).join(ends, "frame").select("frame", "region_id", "x", "y", F.lit(1).alias("side"))

    def match(b: pd.DataFrame) -> pd.DataFrame:
        p, q = (b[b["side"] == k].sort_values("region_id") for k in (0, 1))
        far = np.hypot(p["x"].to_numpy()[:, None] - q["x"].to_numpy()[None], p["y"].to_numpy()[:, None] - q["y"].to_numpy()[None])
        out = [(int(b["frame"].iloc[0]), int(p["region_id"].iloc[r]), int(q["region_id"].iloc[c]), round(float(far[r, c]), 4)) for r, c in kernels.assignment(far)]
        return pd.DataFrame(out, columns=["frame", "src", "dst", "dist"])

    return last.unionByName(first).groupBy("frame").applyInPandas(match, "frame int, src bigint, dst bigint, dist double")
