"""Region graph: candidate edges, best edges, one-to-one contraction and greedy confirmation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.operators.components import connected_components
from trackweave.operators.written import forget

MAX_DISTANCE = 10.0
#: Neighbours that a search looks at first, on average: it begins with a reach that holds about as many.
FIRST_NEIGHBOURS = 8


def movement_score(dist: Column, max_distance: float) -> Column:
    return F.greatest(F.lit(0.0), (max_distance - dist) / max_distance)


def candidate_edges(rows: DataFrame, max_distance: float = MAX_DISTANCE, score: Callable[[Column, float], Column] = movement_score) -> DataFrame:
    """Edges from each region to those of the next frame within ``max_distance`` in x and in y.

    An equi-join on the frame and a grid cell of twice the distance: a region goes to the four cells
    that its reach covers (a little more, for rounding), and those of the next frame to their own.
    """
    reach = max_distance * 1.001
    cell = lambda c: F.floor(F.col(c) / (2 * reach)).cast("int")
    sides = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / (2 * reach)).cast("int"), F.floor((F.col(c) + reach) / (2 * reach)).cast("int")))
    a = rows.select(F.col("region_id").alias("src"), (F.col("frame") + 1).alias("f"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    a = a.withColumn("cx", sides("x1")).withColumn("cy", sides("y1"))
    b = rows.select(F.col("region_id").alias("dst"), F.col("frame").alias("f"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    hit = a.join(b, ["f", "cx", "cy"]).filter((F.abs(F.col("x1") - F.col("x2")) <= max_distance) & (F.abs(F.col("y1") - F.col("y2")) <= max_distance))
    dist = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    return hit.select("src", "dst", (F.col("f") - 1).alias("frame"), dist.alias("dist"), score(dist, max_distance).alias("score"))


def near(asked: DataFrame, given: DataFrame, reach: float = MAX_DISTANCE, on: list[str] | None = None) -> DataFrame:
    """Rows of ``asked`` (``f``, ``x``, ``y``, others) and of ``given`` (``f``, ``u``, ``v``, others) of one frame number, and
    of equal columns ``on``, within ``reach`` in x and in y."""
    wide = reach * 1.001  # a little more, for rounding
    cell = lambda c: F.floor(F.col(c) / (2 * wide)).cast("int")
    sides = lambda c: F.explode(F.sequence(F.floor((F.col(c) - wide) / (2 * wide)).cast("int"), F.floor((F.col(c) + wide) / (2 * wide)).cast("int")))
    a = asked.withColumn("cx", sides("x")).withColumn("cy", sides("y"))
    b = given.withColumns({"cx": cell("u"), "cy": cell("v")})
    return a.join(b, ["f", "cx", "cy", *(on or [])]).filter((F.abs(F.col("x") - F.col("u")) <= reach) & (F.abs(F.col("y") - F.col("v")) <= reach)).drop("cx", "cy")


def around(asked: DataFrame, given: DataFrame, *sums: Column, reach: float = MAX_DISTANCE) -> DataFrame:
    """Aggregates ``sums`` of what is ``given`` near each place ``asked`` for (``f``, ``x``, ``y``, distinct); places without any are absent.

    Tasks add up what they join, so pairs are never shuffled or kept.
    """
    return near(asked.select("f", "x", "y"), given, reach).groupBy("f", "x", "y").agg(*sums)


def reaches(given: DataFrame, max_distance: float, neighbours: int = FIRST_NEIGHBOURS) -> list[float]:
    """Growing reaches up to ``max_distance``, each twice the one before. ``given``: places ``f``, ``u``, ``v``.

    The first is about the one in which a place sees ``neighbours`` others, by the places in its cell.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * max_distance))
    seen = given.groupBy("f", cell("u"), cell("v")).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    out = [max_distance]
    while seen > neighbours and len(out) < 24:
        seen /= 4
        out.insert(0, out[0] / 2)
    return out


def nearest_two(rows: DataFrame, write: Callable[[DataFrame], DataFrame], side: str = "src", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``best_two`` of the candidate edges between ``rows`` (written), without all of them: nearest regions by a growing reach.

    Regions of one place have the same edges and need only the two least ids of another place. A place that
    has found two within a reach is done: all others are farther and score less.
    """
    rows = rows.select("frame", "x", "y", "region_id")
    k = F.row_number().over(Window.partitionBy("frame", "x", "y").orderBy("region_id"))
    ends = write(rows.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("k", k).filter("k <= 2"))
    step = 1 if side == "src" else -1
    given = ends.select((F.col("frame") - step).alias("f"), F.col("x").alias("u"), F.col("y").alias("v"), "region_id")
    open_, out = ends.filter("k = 1").select(F.col("frame").alias("f"), "x", "y"), None
    dist = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    w = Window.partitionBy("f", "x", "y").orderBy(F.col("score").desc(), "region_id")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    for reach in reaches(given, max_distance):
        last = reach == max_distance
        e = near(open_, given, reach).withColumn("score", movement_score(dist, max_distance))
        e = e.filter(F.col("score") > (0.0 if last else (max_distance - reach) / max_distance)).withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
        got = e.groupBy("f", "x", "y").agg(pick(1, "region_id").alias("best"), F.coalesce(pick(1, "score"), F.lit(0.0)).alias("s1"), pick(2, "region_id").alias("second"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias("s2"))
        got = got if last else write(got.filter("second IS NOT NULL"))
        out = got if out is None else out.unionByName(got)
        open_ = open_ if last else open_.join(got.select("f", "x", "y"), ["f", "x", "y"], "left_anti")
    found = out.withColumnsRenamed({"f": "frame"})
    return rows.join(found, ["frame", "x", "y"]).select(F.col("region_id").alias(side), "best", "s1", "second", "s2")


def only_edges(rows: DataFrame, write: Callable[[DataFrame], DataFrame], max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``one_to_one`` of the candidate edges between ``rows``, without all of them: ``src``, ``dst``, ``frame``.

    Neighbours are counted by place. A place of several regions, or one that sees several within a reach, has no such edge.
    """
    places = write(rows.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("frame", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("id")))
    grow = reaches(places.select(F.col("frame").alias("f"), F.col("x").alias("u"), F.col("y").alias("v")), max_distance)

    def alone(asked: DataFrame, step: int) -> DataFrame:
        given = places.select((F.col("frame") - step).alias("f"), F.col("x").alias("u"), F.col("y").alias("v"), "n", F.col("id").alias("other"))
        asked = asked.select(F.col("frame").alias("f"), "x", "y", "id")
        for reach in grow:
            seen = around(asked, given, F.sum("n").alias("m"), F.min("other").alias("other"), reach=reach)
            if reach == max_distance:
                return asked.join(seen.filter("m = 1"), ["f", "x", "y"]).select("id", "other", F.col("f").alias("frame"))
            asked = write(asked.join(seen.filter("m > 1"), ["f", "x", "y"], "left_anti"))

    out = write(alone(places.filter("n = 1"), 1))
    ends = places.filter("n = 1").join(out.select(F.col("other").alias("id")).distinct(), "id", "left_semi")
    back = alone(ends, -1).select(F.col("id").alias("dst"), F.col("other").alias("src"))
    return out.select(F.col("id").alias("src"), F.col("other").alias("dst"), "frame").join(back, ["src", "dst"])


def place_components(rows: DataFrame, write: Callable[[DataFrame], DataFrame], max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Components of the candidate edges between two frames, by place: ``f`` (the first frame), ``x``, ``y``, ``side`` (0: sources), ``n`` regions, ``component``.

    The component is the least source. Places that see each other in a small reach are joined first; farther pairs
    count only where they join different components, and tasks drop the others. Places without an edge are absent.
    """
    at = write(rows.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("frame", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("id")))
    half = 1 << 62  # sources come before all targets, so the least vertex is a source
    src = at.select(F.col("frame").alias("f"), "x", "y", (F.col("id") - half).alias("a"))
    dst = at.select((F.col("frame") - 1).alias("f"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("id") + half).alias("b"))
    first = reaches(dst, max_distance)[0]
    label = write(connected_components(near(src, dst, first).select("a", "b"), write))
    if first < max_distance:
        of = lambda t, c: t.join(label.withColumnRenamed("vertex", c), c, "left").withColumn(f"c{c}", F.coalesce("component", c)).drop("component")
        more = write(near(of(src, "a"), of(dst, "b"), max_distance).filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        joined = write(connected_components(more, write))
        known = label.unionByName(joined.join(label, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component")))
        joined = joined.select(F.col("vertex").alias("component"), F.col("component").alias("whole"))
        label = known.join(joined, "component", "left").select("vertex", F.coalesce("whole", "component").alias("component"))
    ends = at.select(F.col("frame").alias("f"), "x", "y", F.lit(0).alias("side"), "n", (F.col("id") - half).alias("vertex"))
    ends = ends.unionByName(at.select((F.col("frame") - 1).alias("f"), "x", "y", F.lit(1).alias("side"), "n", (F.col("id") + half).alias("vertex")))
    return write(ends.join(label, "vertex").withColumn("component", F.col("component") + half).drop("vertex"))


def best_two(edges: DataFrame, side: str = "src", score: str = "score") -> DataFrame:
    """The best and second-best edge of each vertex (edges of score 0 never count): ids and scores; missing: null and 0."""
    other = "dst" if side == "src" else "src"
    w = Window.partitionBy(side).orderBy(F.col(score).desc(), other)
    top = edges.filter(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return top.groupBy(side).agg(pick(1, other).alias("best"), F.coalesce(pick(1, score), F.lit(0.0)).alias("s1"), pick(2, other).alias("second"), F.coalesce(pick(2, score), F.lit(0.0)).alias("s2"))


def strongly_better(two: DataFrame, eps: float = 0.3, least: float = 0.5) -> DataFrame:
    """Vertices whose best edge stands out: s1 / (s1 + s2 + eps) > least. ``two``: the best two edges of each."""
    share = F.col("s1") / (F.col("s1") + F.col("s2") + eps)
    return two.withColumn("share", share).filter(F.col("share") > least)


def one_to_one(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their target."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return edges.withColumns({"n_out": n("src"), "n_in": n("dst")}).filter("n_out = 1 AND n_in = 1").drop("n_out", "n_in")


def contract_paths(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first vertex of each vertex's path, for edges with at most one edge in and out: ``vertex``, ``head``, ``hops``.

    Pointer doubling: a path of n vertices takes log2(n) joins. ``write`` cuts the lineage of a round
    (a checkpoint or a written table).
    """
    back = edges.select(F.col("dst").alias("vertex"), F.col("src").alias("head"), F.lit(1).alias("hops"))
    last = back = write(back)
    while True:
        up = back.select(F.col("vertex").alias("head"), F.col("head").alias("head2"), F.col("hops").alias("hops2"))
        nxt = write(back.join(up, "head", "left").select("vertex", F.coalesce("head2", "head").alias("head"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("head2").isNotNull().alias("moved")))
        forget(last)
        last, back = nxt, nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            break
    heads = edges.select(F.col("src").alias("vertex")).join(edges.select(F.col("dst").alias("vertex")), "vertex", "left_anti").distinct()
    return back.unionByName(heads.select("vertex", F.col("vertex").alias("head"), F.lit(0).alias("hops")))


def confirm_greedily(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Confirm edges by falling score (ties: src, dst), dropping others of both ends: a greedy matching.

    Rounds take all edges that are the best of both their ends at once; that gives the same edges
    as one pass in order, because the order is total.
    """
    rest, out = write(edges.select("src", "dst", "score")), None
    order = F.struct(-F.col("score"), F.col("src"), F.col("dst"))
    while rest.limit(1).count():
        ranked = rest.withColumns({"o": order, "a": F.min(order).over(Window.partitionBy("src")), "b": F.min(order).over(Window.partitionBy("dst"))})
        best = write(ranked.filter("o = a AND o = b").select("src", "dst", "score"))
        out, last = best if out is None else out.unionByName(best), rest
        rest = write(rest.join(best.select("src"), "src", "left_anti").join(best.select("dst"), "dst", "left_anti"))
        forget(last)
    return out if out is not None else edges.select("src", "dst", "score").limit(0)


def confirm_near(rows: DataFrame, write: Callable[[DataFrame], DataFrame], max_distance: float = MAX_DISTANCE, digits: int = 6) -> DataFrame:
    """``confirm_greedily`` of the candidate edges between ``rows``, without all of them: ``src``, ``dst``, ``score`` (rounded).

    The order is by score, so edges within a small reach are confirmed to the end before farther ones are made, between
    regions that are left. Regions of one place have the same scores: where a place's best score is with places that
    have it with no other, their regions are paired in the order of their ids at once; else the first two.
    """
    at = rows.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("frame", "x", "y").agg(F.array_sort(F.collect_list("region_id")).alias("ids"))
    at = write(at.withColumn("p", F.col("ids")[0]))
    src = at.select(F.col("frame").alias("f"), "x", "y", "p", "ids")
    dst = at.select((F.col("frame") - 1).alias("f"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("p").alias("q"), F.col("ids").alias("jds"))
    parts = []
    dist = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    for reach in reaches(dst, max_distance, FIRST_NEIGHBOURS):
        pairs = near(src.drop("ids"), dst.drop("jds"), reach).select("p", "q", F.round(movement_score(dist, max_distance), digits).alias("score"))
        if reach != max_distance:
            pairs = pairs.filter(F.col("score") > F.round(F.lit((max_distance - reach) / max_distance), digits))
        pairs = write(pairs)
        while pairs.limit(1).count():
            order = F.struct(-F.col("score"), F.col("lo"), F.col("hi"))
            j = pairs.join(src.select("p", F.col("ids")[0].alias("lo")), "p").join(dst.select("q", F.col("jds")[0].alias("hi")), "q")
            a, b = Window.partitionBy("p"), Window.partitionBy("q")
            j = j.withColumns({"o": order, "a": F.min(order).over(a), "sa": F.max("score").over(a)}).withColumn("ka", F.count_if(F.col("score") == F.col("sa")).over(a))
            j = j.withColumns({"b": F.min("o").over(b), "sb": F.max("score").over(b)}).withColumn("kb", F.count_if(F.col("score") == F.col("sb")).over(b))
            top = j.filter("score = sa AND score = sb").select("p", "q", "score", "ka", "kb", ((F.col("o") == F.col("a")) & (F.col("o") == F.col("b"))).alias("first"))
            top = top.withColumn("sp", (F.count(F.lit(1)).over(a) == F.col("ka")) & (F.max("kb").over(a) == 1))
            top = top.withColumn("sq", (F.count(F.lit(1)).over(b) == F.col("kb")) & (F.max("ka").over(b) == 1))
            best = write(top.filter("sp OR sq OR first").select("p", "q", "score", F.when(F.col("sp"), 1).when(F.col("sq"), 2).otherwise(0).alias("how")))
            both = best.join(src.select("p", "ids"), "p").join(dst.select("q", "jds"), "q")
            turn = lambda one, ids: both.filter(F.col("how") == (1 if one == "p" else 2)).select("p", "q", "score", ids, F.explode("jds" if one == "p" else "ids").alias("id")).withColumn("k", F.row_number().over(Window.partitionBy(one).orderBy("id"))).filter(F.col("k") <= F.size(ids))
            got = both.filter("how = 0").select("p", "q", F.col("ids")[0].alias("src"), F.col("jds")[0].alias("dst"), "score")
            got = got.unionByName(turn("p", "ids").select("p", "q", F.expr("ids[k - 1]").alias("src"), F.col("id").alias("dst"), "score"))
            got = write(got.unionByName(turn("q", "jds").select("p", "q", F.col("id").alias("src"), F.expr("jds[k - 1]").alias("dst"), "score")))
            parts.append(got.select("src", "dst", "score"))
            before = (src, dst, pairs, best)
            left = lambda t, c, ids: t.join(got.groupBy(c).agg(F.count(F.lit(1)).cast("int").alias("k")), c, "left").withColumn(ids, F.when(F.col("k").isNull(), F.col(ids)).otherwise(F.slice(ids, F.col("k") + 1, F.size(ids)))).filter(F.size(ids) > 0).drop("k")
            src, dst = write(left(src, "p", "ids")), write(left(dst, "q", "jds"))
            pairs = write(pairs.join(src.select("p"), "p", "left_semi").join(dst.select("q"), "q", "left_semi"))
            forget(*before)
        forget(pairs)
    out = parts[0] if parts else rows.select(F.col("region_id").alias("src"), F.col("region_id").alias("dst"), F.lit(0.0).alias("score")).limit(0)
    for t in parts[1:]:
        out = out.unionByName(t)
    return out


def longest_paths(links: DataFrame, weights: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The heaviest path that begins at each vertex: ``vertex``, ``total``, ``hops`` behind it and the ``next`` vertex (ties: the least).

    ``links`` (``a``, ``b``) have no cycle; ``weights`` has a positive ``w`` for each ``vertex``. A round
    looks again at the vertices in front of those that grew, so the rounds are the longest path's links,
    and one more. ``write`` cuts the lineage of a round.
    """
    best = write(weights.select("vertex", "w", F.col("w").alias("total"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("next"), F.lit(True).alias("grew")))
    links = links.select("a", "b").distinct()
    while best.filter("grew").limit(1).count():
        ahead = best.filter("grew").select(F.col("vertex").alias("b"), "total", F.col("hops").alias("h"))
        offer = links.join(ahead, "b").groupBy("a").agg(F.max(F.struct("total", (-F.col("b")).alias("m"), "h")).alias("o"))
        j = best.drop("grew").join(offer, best["vertex"] == offer["a"], "left")
        more, tie = F.col("o.total") + F.col("w"), -F.col("o.m")
        grew = F.col("o").isNotNull() & ((more > F.col("total")) | ((more == F.col("total")) & (tie < F.col("next"))))
        pick = lambda new, c: F.when(grew, new).otherwise(F.col(c)).alias(c)
        best = write(j.select("vertex", "w", pick(more, "total"), pick(F.col("o.h") + 1, "hops"), pick(tie, "next"), F.coalesce(grew, F.lit(False)).alias("grew")))
    return best.select("vertex", "total", "hops", "next")


def longest_ways(ways: DataFrame, links: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The heaviest path that begins at each place ``into``: ``into``, ``total``.

    ``ways`` run from a place ``into`` to a place ``from`` with a weight ``w``; ``links`` go on from there to further places ``into``,
    without a cycle. A round looks again at what is in front of places that grew; each is written, and the one before removed.
    """
    ways = write(ways)
    steps = write(links.withColumnRenamed("into", "to"))
    best = write(ways.groupBy("into").agg(F.max("w").cast("bigint").alias("total")).withColumn("grew", F.lit(True)))
    while best.filter("grew").limit(1).count():
        ahead = best.filter("grew").select(F.col("into").alias("to"), F.col("total").alias("t"))
        offer = steps.join(ahead, "to").groupBy("from").agg(F.max("t").alias("t"))
        offer = ways.join(offer, "from").groupBy("into").agg(F.max(F.col("w") + F.col("t")).alias("more"))
        last, j = best, best.join(offer, "into", "left")
        best = write(j.select("into", F.greatest("total", "more").alias("total"), F.coalesce(F.col("more") > F.col("total"), F.lit(False)).alias("grew")))
        forget(last)
    return best.select("into", "total")
