"""Queries of the tracking operators over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import geometry as G
from trackweave.operators import graph, intervals, kernels
from trackweave.operators.components import bipartite_components
from trackweave.operators.written import forget, writer
from trackweave.session import reach_workers
from trackweave.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: DuckDB forms of the adapters in ``sources.tables``.
CTE = {
    "det": "SELECT event_id AS region_id, CAST(user_id AS INT) AS obj_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 21600000000) AS INT) AS frame, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events",
    "du": "SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY obj_id, frame ORDER BY region_id) = 1",
    "reg": "SELECT *, y + 1 AS sxx, x / 10 + 1 AS syy, ((region_id % 7) - 3) / 10.0::DOUBLE AS sxy, 50 + region_id % 200 AS area, CAST(floor(x) AS INT) AS roi_x, CAST(floor(y) AS INT) AS roi_y, CAST(1 + region_id % 20 AS INT) AS roi_w, CAST(1 + region_id % 15 AS INT) AS roi_h, CAST(region_id % 5 AS INT) AS label, CAST(region_id % 11 AS INT) AS margin, CAST(region_id % 256 AS INT) AS min_intensity FROM det",
    "runs": "SELECT *, frame - row_number() OVER (PARTITION BY obj_id ORDER BY frame) AS run FROM du",
    "tr": "SELECT obj_id, min(region_id) AS tracklet_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM runs GROUP BY obj_id, run",
    "tre": "SELECT * EXCLUDE (run), min(region_id) OVER (PARTITION BY obj_id, run) AS tracklet_id, row_number() OVER (PARTITION BY obj_id, run ORDER BY frame) - 1 AS pos FROM runs",
    "edges": "SELECT a.region_id AS src, b.region_id AS dst, a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, greatest(0.0, (10.0 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / 10.0) AS score FROM du a JOIN du b ON b.frame = a.frame + 1 AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10",
    "gt": "SELECT frame, obj_id AS id, x, y FROM du",
    "pred": "SELECT frame, id, x, y FROM (SELECT region_id, frame, CASE WHEN region_id % 97 = 0 THEN (obj_id + 1) % (SELECT max(obj_id) + 1 FROM du) ELSE obj_id END AS id, x + region_id % 3 AS x, y FROM du WHERE region_id % 11 <> 0) QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY region_id) = 1",
    "ev": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings",
}
#: Adapters that another one reads.
NEEDS = {"du": ["det"], "reg": ["det"], "runs": ["det", "du"], "tr": ["det", "du", "runs"], "tre": ["det", "du", "runs"], "edges": ["det", "du"], "gt": ["det", "du"], "pred": ["det", "du"]}


def query(sql: str | None = None, uses: str = "", recursive: bool = False):
    """Register a query under its function's name, with its SQL behind the adapters that it uses."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            names = list(dict.fromkeys(n for u in uses.split() for n in [*NEEDS.get(u, []), u]))
            parts = [f"{n} AS ({CTE[n]})" for n in names]
            body = sql.strip()
            if body.startswith("WITH "):
                parts.append(body[5:])
                SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts)
            else:
                SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
        return f

    return add


def _r(c, n: int = 4):
    return F.round(c, n)


# Scalar geometry


@query("""SELECT region_id, round(major, 4) AS major, round(minor, 4) AS minor, round(theta, 4) AS theta, round(degrees(theta), 3) AS deg_ccw, round(1 - sqrt(minor / major), 4) AS eccentricity,
round(4 * major * minor / area, 4) AS ellipse_ratio, round(sqrt(area / ((major / minor) * pi())), 4) AS scaled_minor
FROM (SELECT *, sqrt((sxx + syy) / 2 + r) AS major, sqrt(greatest(0.0, (sxx + syy) / 2 - r)) AS minor, CASE WHEN t < 0 THEN t + pi() ELSE t END AS theta
  FROM (SELECT *, sqrt(4 * sxy * sxy + (sxx - syy) * (sxx - syy)) / 2 AS r, -0.5 * atan2(2 * sxy, sxx - syy) AS t FROM reg)) WHERE sxx - syy <> 0""", "reg")
def region_ellipses(spark, d):
    """Axes, orientation, eccentricity and area ratio from moments."""
    r = S.regions(spark, d).filter("sxx - syy <> 0")
    major, minor = G.ellipse_axes(F.col("sxx"), F.col("syy"), F.col("sxy"))
    r = r.withColumns({"major": major, "minor": minor, "theta": G.orientation(F.col("sxx"), F.col("syy"), F.col("sxy"))})
    major, minor = F.col("major"), F.col("minor")
    return r.select(
        "region_id", _r(major).alias("major"), _r(minor).alias("minor"), _r(F.col("theta")).alias("theta"), _r(F.degrees("theta"), 3).alias("deg_ccw"), _r(G.eccentricity(major, minor)).alias("eccentricity"),
        _r(G.ellipse_area_ratio(major, minor, F.col("area"))).alias("ellipse_ratio"), _r(G.same_area_axes(F.col("area"), major, minor)[1]).alias("scaled_minor"),
    )


@query("""SELECT region_id, least(((a - b) % 180 + 180) % 180, 180 - ((a - b) % 180 + 180) % 180) AS axis_error, least(((a - b) % 360 + 360) % 360, 360 - ((a - b) % 360 + 360) % 360) AS angle_error
FROM (SELECT region_id, CAST(region_id * 7 % 720 - 360 AS BIGINT) AS a, CAST(region_id * 11 % 720 AS BIGINT) AS b FROM det)""", "det")
def angle_errors(spark, d):
    """Differences of directions, head and tail alike or not."""
    r = S.detections(spark, d).selectExpr("region_id", "region_id * 7 % 720 - 360 AS a", "region_id * 11 % 720 AS b")
    return r.select("region_id", G.axis_angle_error(F.col("a"), F.col("b")).alias("axis_error"), G.angle_error(F.col("a"), F.col("b")).alias("angle_error"))


@query("""SELECT tracklet_id, frame, region_id, round(sqrt(dx * dx + dy * dy), 4) AS speed, round(dx, 4) AS dx, round(dy, 4) AS dy, round(avg(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY tracklet_id), 4) AS mean_speed
FROM (SELECT *, x - lag(x) OVER (PARTITION BY tracklet_id ORDER BY frame) AS dx, y - lag(y) OVER (PARTITION BY tracklet_id ORDER BY frame) AS dy FROM tre)""", "tre")
def velocities(spark, d):
    """Step vectors and speeds along tracklets."""
    t = intervals.tracklet_regions(S.unique_detections(spark, d))
    w = Window.partitionBy("tracklet_id").orderBy("frame")
    t = t.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).withColumn("s", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return t.select("tracklet_id", "frame", "region_id", _r(F.col("s")).alias("speed"), _r(F.col("dx")).alias("dx"), _r(F.col("dy")).alias("dy"), _r(F.avg("s").over(Window.partitionBy("tracklet_id"))).alias("mean_speed"))


@query("""SELECT a.region_id AS a, b.region_id AS b, least(a.roi_x, b.roi_x) AS ux, least(a.roi_y, b.roi_y) AS uy, greatest(a.roi_x + a.roi_w, b.roi_x + b.roi_w) - least(a.roi_x, b.roi_x) AS uw,
greatest(a.roi_y + a.roi_h, b.roi_y + b.roi_h) - least(a.roi_y, b.roi_y) AS uh, b.x BETWEEN a.roi_x AND a.roi_x + a.roi_w - 1 AND b.y BETWEEN a.roi_y AND a.roi_y + a.roi_h - 1 AS holds
FROM reg a JOIN reg b ON a.frame = b.frame AND a.region_id < b.region_id AND a.roi_x <= b.roi_x + b.roi_w AND a.roi_x + a.roi_w >= b.roi_x AND a.roi_y <= b.roi_y + b.roi_h AND a.roi_y + a.roi_h >= b.roi_y""", "reg")
def touching_boxes(spark, d):
    """Boxes of one frame that intersect or touch, their union, and containment.

    Boxes go to the grid cells that they cover, edges included; a pair is taken in the cell of the
    lower corner of what they share, so it comes once.
    """
    r = S.regions(spark, d).select("region_id", "frame", "x", "y", "roi_x", "roi_y", "roi_w", "roi_h")
    one, two = [F.col(c) for c in ("roi_x", "roi_y", "roi_w", "roi_h")], [F.col(c) for c in ("roi_x2", "roi_y2", "roi_w2", "roi_h2")]
    cells = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / 20), F.floor((F.col(at) + F.col(size)) / 20)))
    b = r.select(*[F.col(c).alias(f"{c}2") for c in r.columns]).withColumn("cx", cells("roi_x2", "roi_w2")).withColumn("cy", cells("roi_y2", "roi_h2"))
    a = r.withColumn("cx", cells("roi_x", "roi_w")).withColumn("cy", cells("roi_y", "roi_h"))
    corner = lambda at: F.floor(F.greatest(at, f"{at}2") / 20)
    j = a.join(b.withColumnRenamed("frame2", "frame"), ["frame", "cx", "cy"])
    j = j.filter((F.col("region_id") < F.col("region_id2")) & G.boxes_touch(*one, *two) & (F.col("cx") == corner("roi_x")) & (F.col("cy") == corner("roi_y")))
    return j.select(F.col("region_id").alias("a"), F.col("region_id2").alias("b"), G.box_union(*one, *two).alias("u"), G.box_holds(F.col("x2"), F.col("y2"), *one).alias("holds")).select("a", "b", F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("u.w").alias("uw"), F.col("u.h").alias("uh"), "holds")


@query("""SELECT region_id, greatest(0, roi_x - 3) AS ex, greatest(0, roi_y - 3) AS ey, roi_w + 6 AS ew, roi_h + 6 AS eh, least(greatest(region_id % 100, roi_x), roi_x + roi_w - 1) AS cx,
CAST(roi_w * roi_h AS BIGINT) AS n_points, roi_x * roi_h * roi_w + roi_h * roi_w * (roi_w - 1) // 2 AS sum_x FROM reg""", "reg")
def box_arithmetic(spark, d):
    """Expanded and clamped boxes, and boxes as runs decoded to points."""
    r = S.regions(spark, d)
    runs = F.transform(F.sequence(F.col("roi_y"), F.col("roi_y") + F.col("roi_h") - 1), lambda v: F.struct(v.alias("line"), F.col("roi_x").alias("col1"), (F.col("roi_x") + F.col("roi_w") - 1).alias("col2")))
    r = r.withColumn("pts", G.runs_to_points(runs))
    return r.select(
        "region_id", F.greatest(F.lit(0), F.col("roi_x") - 3).alias("ex"), F.greatest(F.lit(0), F.col("roi_y") - 3).alias("ey"), (F.col("roi_w") + 6).alias("ew"), (F.col("roi_h") + 6).alias("eh"),
        G.clamp(F.col("region_id") % 100, F.col("roi_x"), F.col("roi_w")).alias("cx"), F.size("pts").cast("bigint").alias("n_points"), F.aggregate("pts", F.lit(0).cast("bigint"), lambda s, p: s + p["x"]).alias("sum_x"),
    )


@query("""SELECT frame, line, min(c) AS col1, max(c) AS col2 FROM (SELECT frame, line, c, c - row_number() OVER (PARTITION BY frame, line ORDER BY c) AS g
FROM (SELECT DISTINCT frame, roi_y AS line, CAST(floor(x) AS INT) AS c FROM reg)) GROUP BY frame, line, g""", "reg")
def run_lengths(spark, d):
    """Points of each frame as run-length rows."""
    p = S.regions(spark, d).selectExpr("frame", "roi_y AS line", "CAST(floor(x) AS INT) AS c").distinct()
    g = F.col("c") - F.row_number().over(Window.partitionBy("frame", "line").orderBy("c"))
    return p.withColumn("g", g).groupBy("frame", "line", "g").agg(F.min("c").alias("col1"), F.max("c").alias("col2")).drop("g")


# Filters


@query("SELECT region_id, frame, area, round(area / (roi_w * roi_h), 6) AS fill FROM reg WHERE area > 100 AND min_intensity < 200 AND area / (roi_w * roi_h) > 1.0 AND frame BETWEEN 10 AND 60", "reg")
def region_filter(spark, d):
    """Area, intensity, fill and frame-range filters."""
    fill = F.col("area") / (F.col("roi_w") * F.col("roi_h"))
    return S.regions(spark, d).filter((F.col("area") > 100) & (F.col("min_intensity") < 200) & (fill > 1.0) & F.col("frame").between(10, 60)).select("region_id", "frame", "area", F.round(fill, 6).alias("fill"))


@query("SELECT region_id, frame, label, margin FROM reg WHERE margin > 0 QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY margin DESC, region_id) = 1", "reg")
def best_margins(spark, d):
    """The region of the largest margin of each frame and label."""
    best = F.min(F.struct((-F.col("margin")).alias("m"), "region_id")).alias("b")
    return S.regions(spark, d).filter("margin > 0").groupBy("frame", "label").agg(best).selectExpr("b.region_id", "frame", "label", "-b.m AS margin")


@query("""SELECT CASE label WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'noise' WHEN 3 THEN 'part' END AS class, count(*) AS n, CAST(median(area) AS DOUBLE) AS median_area, round(stddev_pop(area), 4) AS sd_area FROM reg GROUP BY 1""", "reg")
def class_statistics(spark, d):
    """Regions by class: count, median and spread of area."""
    return S.regions(spark, d).groupBy(G.class_name(F.col("label")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.median("area").alias("median_area"), _r(F.stddev_pop("area")).alias("sd_area"))


@query("""WITH t AS (SELECT obj_id, tracklet_id, avg(area) AS mean_area FROM (SELECT r.obj_id, r.area, e.tracklet_id FROM tre e JOIN reg r USING (region_id)) GROUP BY 1, 2),
s AS (SELECT avg(mean_area) + 2 * stddev_pop(mean_area) AS cut FROM t) SELECT tracklet_id, round(mean_area, 4) AS mean_area FROM t, s WHERE mean_area > cut""", "tre reg")
def collision_candidates(spark, d):
    """Tracklets whose mean area exceeds mean plus two deviations."""
    t = intervals.tracklet_regions(S.unique_detections(spark, d)).withColumn("area", 50 + F.col("region_id") % 200).groupBy("tracklet_id").agg(F.avg("area").alias("mean_area"))
    cut = t.agg((F.avg("mean_area") + 2 * F.stddev_pop("mean_area")).alias("cut"))
    return t.join(F.broadcast(cut), F.col("mean_area") > F.col("cut")).select("tracklet_id", _r(F.col("mean_area")).alias("mean_area"))


@query("SELECT b.region_id, min(a.region_id) AS kept FROM det a JOIN det b ON a.frame = b.frame AND a.region_id < b.region_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY b.region_id", "det")
def duplicate_detections(spark, d):
    """Detections within a pixel of an earlier one of the frame."""
    cell = lambda c: F.floor(F.col(c)).cast("int")
    r = S.detections(spark, d)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = r.select(F.col("region_id").alias("a"), "frame", F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy")).withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
    a = a.withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")})
    j = r.withColumns({"cx": cell("x"), "cy": cell("y")}).join(a, ["frame", "cx", "cy"]).filter("a < region_id AND abs(ax - x) <= 1 AND abs(ay - y) <= 1")
    return j.groupBy("region_id").agg(F.min("a").alias("kept"))


# Graph


def _edges(spark, d):
    return graph.candidate_edges(S.unique_detections(spark, d))


def _best_two(spark, d, side: str = "src"):
    """The best two edges of each region, found without making all edges."""
    write = _written(spark)
    return graph.nearest_two(write(S.unique_detections(spark, d)), write, side)


@query("SELECT src, dst, frame, round(dist, 4) AS dist, round(score, 4) AS score FROM edges", "edges")
def candidate_edges(spark, d):
    """Edges between near regions of neighbouring frames, scored by distance."""
    return _edges(spark, d).select("src", "dst", "frame", _r(F.col("dist")).alias("dist"), _r(F.col("score")).alias("score"))


@query("""SELECT src, max(CASE WHEN k = 1 THEN dst END) AS best, round(coalesce(max(CASE WHEN k = 1 THEN score END), 0), 4) AS s1, max(CASE WHEN k = 2 THEN dst END) AS second, round(coalesce(max(CASE WHEN k = 2 THEN score END), 0), 4) AS s2
FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM edges WHERE score > 0) WHERE k <= 2 GROUP BY src""", "edges")
def best_two_edges(spark, d):
    """The two best successors of each region."""
    b = _best_two(spark, d)
    return b.select("src", "best", _r(F.col("s1")).alias("s1"), "second", _r(F.col("s2")).alias("s2"))


@query("""WITH b AS (SELECT src, max(CASE WHEN k = 1 THEN dst END) AS best, coalesce(max(CASE WHEN k = 1 THEN score END), 0) AS s1, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS s2
FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM edges WHERE score > 0) WHERE k <= 2 GROUP BY src)
SELECT src, best, round(s1 / (s1 + s2 + 0.3), 4) AS share FROM b WHERE s1 / (s1 + s2 + 0.3) > 0.5""", "edges")
def strongly_better(spark, d):
    """Regions whose best successor stands out."""
    return graph.strongly_better(_best_two(spark, d)).select("src", "best", _r(F.col("share")).alias("share"))


@query("""SELECT round(avg(o), 6) AS mean_out, round(stddev_samp(o), 6) AS sd_out, count(*) AS vertices, max(o) AS most FROM (SELECT src, count(*) AS o FROM edges GROUP BY src)""", "edges")
def degree_summary(spark, d):
    """Out-degrees of the region graph."""
    o = _edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    return o.agg(F.round(F.avg("o"), 6).alias("mean_out"), F.round(F.stddev("o"), 6).alias("sd_out"), F.count(F.lit(1)).alias("vertices"), F.max("o").alias("most"))


_ONE = """one AS (SELECT src, dst, frame FROM edges QUALIFY count(*) OVER (PARTITION BY src) = 1 AND count(*) OVER (PARTITION BY dst) = 1)"""


@query(f"WITH {_ONE} SELECT src, dst, frame FROM one", "edges")
def one_to_one_edges(spark, d):
    """Edges without a rival at either end."""
    return graph.only_edges(S.unique_detections(spark, d), _written(spark)).select("src", "dst", "frame")


@query(f"""WITH {_ONE}, walk AS (SELECT src AS head, src AS vertex, 0 AS hops FROM one WHERE src NOT IN (SELECT dst FROM one) UNION ALL SELECT w.head, o.dst, w.hops + 1 FROM walk w JOIN one o ON o.src = w.vertex)
SELECT head, count(*) AS n, max(hops) AS hops, min(vertex) AS lo, max(vertex) AS hi FROM walk GROUP BY head""", "edges", recursive=True)
def contracted_tracklets(spark, d):
    """Paths of one-to-one edges contracted by pointer doubling."""
    one = _written(spark)(graph.only_edges(S.unique_detections(spark, d), _written(spark)).select("src", "dst"))
    paths = graph.contract_paths(one, _written(spark))
    return paths.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("hops"), F.min("vertex").alias("lo"), F.max("vertex").alias("hi"))


def _written(spark):
    """Cut lineage by tables written to the folder that the session names for checkpoints; a local session without one gets its own."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not spark.sparkContext.getCheckpointDir():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="trackweave-"))
    return writer(spark)


@query()
def confirmed_edges(spark, d):
    """Edges confirmed greedily by score."""
    return graph.confirm_near(S.unique_detections(spark, d), _written(spark))


@query("""WITH e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM edges)
SELECT z.src AS a, z.dst AS b, z.i - 1 AS rivals FROM e z JOIN e r ON r.dst = z.dst AND r.src <> z.src WHERE z.o = 1 AND z.i = 2 AND r.o = 2""", "edges")
def z_cases(spark, d):
    """A region's only successor has exactly one other predecessor, and that one two successors."""
    e = _edges(spark, d).withColumns({"o": F.count(F.lit(1)).over(Window.partitionBy("src")), "i": F.count(F.lit(1)).over(Window.partitionBy("dst"))})
    e = e.withColumn("other", F.sum("o").over(Window.partitionBy("dst")) - F.col("o"))
    return e.filter("o = 1 AND i = 2 AND other = 2").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("i") - 1).alias("rivals"))


# Intervals


@query("SELECT tracklet_id, obj_id, start_frame, end_frame, n FROM tr", "tr")
def tracklets(spark, d):
    """Runs of consecutive frames of each object."""
    return intervals.islands(S.unique_detections(spark, d)).select("tracklet_id", "obj_id", "start_frame", "end_frame", "n")


@query("SELECT count(*) AS n, round(avg(n), 6) AS mean_len, CAST(median(n) AS DOUBLE) AS median_len, max(n) AS max_len, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / ((max(end_frame) - min(start_frame) + 1) * count(DISTINCT obj_id)), 6) AS coverage FROM tr", "tr")
def tracklet_statistics(spark, d):
    """Lengths and coverage of tracklets."""
    t = intervals.islands(S.unique_detections(spark, d))
    cover = F.sum("n") / ((F.max("end_frame") - F.min("start_frame") + 1) * F.countDistinct("obj_id"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n"), 6).alias("mean_len"), F.median("n").alias("median_len"), F.max("n").alias("max_len"), F.sum("n").alias("total"), F.round(cover, 6).alias("coverage"))


@query("SELECT f.frame, t.tracklet_id FROM (SELECT DISTINCT frame FROM du) f JOIN tr t ON t.start_frame <= f.frame AND f.frame <= t.end_frame", "tr")
def tracklets_in_frame(spark, d):
    """Tracklets present at each frame: a point-in-interval join."""
    rows = S.unique_detections(spark, d)
    f = rows.select("frame").distinct().select(F.col("frame").alias("start_frame"), F.col("frame").alias("end_frame"))
    return intervals.overlap_join(f, intervals.islands(rows).select("tracklet_id", "start_frame", "end_frame")).select(F.col("start_frame").alias("frame"), F.col("tracklet_id2").alias("tracklet_id"))


@query("SELECT a.tracklet_id, count(*) AS n, min(b.tracklet_id) AS lo, max(b.tracklet_id) AS hi FROM tr a JOIN tr b ON a.start_frame <= b.end_frame AND b.start_frame <= a.end_frame AND a.tracklet_id <> b.tracklet_id GROUP BY 1", "tr")
def overlapping_singles(spark, d):
    """Tracklets that each tracklet overlaps, of any length: number, least and greatest (J3, J4 without its class filter)."""
    return intervals.overlap_summary(intervals.tracklet_regions(S.unique_detections(spark, d)))


_SWEEP = """st AS (SELECT frame, sum(s) AS s FROM (SELECT start_frame AS frame, 1 AS s FROM tr UNION ALL SELECT end_frame + 1, -1 FROM tr) GROUP BY frame),
act AS (SELECT frame AS start_frame, lead(frame) OVER (ORDER BY frame) - 1 AS end_frame, CAST(sum(s) OVER (ORDER BY frame) AS BIGINT) AS active FROM st)"""


@query(f"WITH {_SWEEP} SELECT * FROM act WHERE end_frame IS NOT NULL", "tr")
def active_tracklets(spark, d):
    """Number of tracklets over time by a sweep."""
    return intervals.active_counts(intervals.islands(S.unique_detections(spark, d)), _written(spark))


@query(f"""WITH {_SWEEP}, k AS (SELECT max(active) AS k FROM act) SELECT a.start_frame, a.end_frame, count(*) AS n, min(t.tracklet_id) AS lo, CAST(sum(t.tracklet_id) AS BIGINT) AS total FROM act a JOIN k ON a.active = k.k
JOIN tr t ON t.start_frame <= a.end_frame AND a.start_frame <= t.end_frame WHERE a.end_frame IS NOT NULL GROUP BY 1, 2""", "tr")
def complete_sets(spark, d):
    """Stretches in which the most tracklets are active, with their members."""
    t = intervals.islands(S.unique_detections(spark, d))
    k = intervals.active_counts(t, _written(spark)).agg(F.max("active")).first()[0] or 0
    c = intervals.complete_stretches(t, k, _written(spark))
    return c.select("start_frame", "end_frame", F.size("members").cast("bigint").alias("n"), F.array_min("members").alias("lo"), F.aggregate("members", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("SELECT f.frame, count(*) AS n, min(t.tracklet_id) AS lo, max(t.tracklet_id) AS hi FROM (SELECT start_frame AS frame FROM tr UNION SELECT end_frame FROM tr) f JOIN tr t ON t.start_frame <= f.frame AND f.frame <= t.end_frame GROUP BY f.frame", "tr")
def collateral_sets(spark, d):
    """Tracklets present at each start or end of one (W15, U5): those that have a row in the frame."""
    rows = intervals.tracklet_regions(S.unique_detections(spark, d))
    rows = rows.withColumn("last", F.lead("pos").over(Window.partitionBy("tracklet_id").orderBy("pos")).isNull())
    per = rows.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.min("tracklet_id").alias("lo"), F.max("tracklet_id").alias("hi"), F.max((F.col("pos") == 0) | F.col("last")).alias("end"))
    return per.filter("end").drop("end")


@query("SELECT obj_id, frame, count(*) AS n FROM det GROUP BY obj_id, frame HAVING count(*) > 1", "det")
def identity_conflicts(spark, d):
    """Identities that occur twice in a frame."""
    return intervals.conflicts(S.detections(spark, d))


@query("SELECT a.tracklet_id, count(b.tracklet_id) AS n_before, min(b.tracklet_id) AS first_before FROM tr a LEFT JOIN tr b ON b.end_frame + 1 = a.start_frame GROUP BY 1", "tr")
def predecessors(spark, d):
    """Tracklets that end just before each one starts."""
    t = intervals.islands(S.unique_detections(spark, d))
    b = t.groupBy((F.col("end_frame") + 1).alias("start_frame")).agg(F.count(F.lit(1)).alias("n_before"), F.min("tracklet_id").alias("first_before"))
    return t.join(b, "start_frame", "left").select("tracklet_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), "first_before")


@query("""WITH e AS (SELECT t.tracklet_id, t.start_frame, t.end_frame, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM tr t JOIN du a ON a.obj_id = t.obj_id AND a.frame = t.start_frame JOIN du b ON b.obj_id = t.obj_id AND b.frame = t.end_frame)
SELECT a.tracklet_id, b.tracklet_id AS nearest, round(sqrt((a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2), 4) AS dist FROM e a JOIN e b ON b.end_frame + 1 = a.start_frame QUALIFY row_number() OVER (PARTITION BY a.tracklet_id ORDER BY (a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2, b.tracklet_id) = 1""", "tr")
def nearest_predecessors(spark, d):
    """Of the tracklets that end just before each one starts, the one whose end is nearest to its start."""
    at = F.struct("x", "y")
    t = intervals.tracklet_regions(S.unique_detections(spark, d)).groupBy("tracklet_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by(at, "frame").alias("first"), F.max_by(at, "frame").alias("last"),
    )
    b = t.select(F.col("tracklet_id").alias("b"), (F.col("end_frame") + 1).alias("start_frame"), "last")
    sq = (F.col("first.x") - F.col("last.x")) ** 2 + (F.col("first.y") - F.col("last.y")) ** 2
    near = t.drop("last").join(b, "start_frame").groupBy("tracklet_id").agg(F.min(F.struct(sq.alias("sq"), "b")).alias("m"))
    return near.select("tracklet_id", F.col("m.b").alias("nearest"), _r(F.sqrt("m.sq")).alias("dist"))


@query("SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev_frame, lead(frame) OVER (ORDER BY frame) AS next_frame, n FROM (SELECT frame, count(*) AS n FROM det GROUP BY frame)", "det")
def frame_index(spark, d):
    """Frames that have data, with their neighbours and sizes."""
    f = S.detections(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return intervals.neighbours(f, "frame", _written(spark)).select("frame", F.col("prev").alias("prev_frame"), F.col("next").alias("next_frame"), "n")


@query("""WITH g AS (SELECT obj_id, tracklet_id, end_frame, lead(start_frame) OVER w AS s2, lead(tracklet_id) OVER w AS t2 FROM tr WINDOW w AS (PARTITION BY obj_id ORDER BY start_frame)),
e AS (SELECT g.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM g JOIN du a ON a.obj_id = g.obj_id AND a.frame = g.end_frame JOIN du b ON b.obj_id = g.obj_id AND b.frame = g.s2)
SELECT obj_id, f AS frame, round(x1 + (x2 - x1) * (f - end_frame) / (s2 - end_frame), 6) AS x, round(y1 + (y2 - y1) * (f - end_frame) / (s2 - end_frame), 6) AS y FROM (SELECT *, unnest(range(end_frame + 1, s2)) AS f FROM e)""", "tr")
def filled_gaps(spark, d):
    """Positions in the gaps between tracklets of an object, interpolated."""
    w = Window.partitionBy("obj_id").orderBy("frame")
    r = S.unique_detections(spark, d).select("obj_id", "frame", "x", "y", F.lead("frame").over(w).alias("f2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    g = r.filter("f2 > frame + 1").withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("f2") - 1)))
    part = lambda a, b: _r(F.col(a) + (F.col(b) - F.col(a)) * (F.col("f") - F.col("frame")) / (F.col("f2") - F.col("frame")), 6)
    return g.select("obj_id", F.col("f").alias("frame"), part("x", "x2").alias("x"), part("y", "y2").alias("y"))


# Ground truth, matching, trajectories


def _in_reach(g, p, reach: int):
    """Rows of ``g`` (x, y) and ``p`` (px, py) of a frame that may lie within ``reach``: an equi-join on grid cells of twice that.

    Each row of ``g`` goes to the four cells that its reach covers (a pixel more, for rounding), each of ``p`` to its own.
    """
    size = 2 * (reach + 1)
    sides = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach - 1) / size), F.floor((F.col(c) + reach + 1) / size)))
    a = g.withColumn("cx", sides("x")).withColumn("cy", sides("y"))
    return a.join(p.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)}), ["frame", "cx", "cy"])


@query("""SELECT g.frame, g.id, p.id AS pred_id, round(sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2), 4) AS dist FROM gt g LEFT JOIN pred p ON p.frame = g.frame AND (g.x - p.x) ** 2 + (g.y - p.y) ** 2 <= 25
QUALIFY row_number() OVER (PARTITION BY g.frame, g.id ORDER BY (g.x - p.x) ** 2 + (g.y - p.y) ** 2, p.id) = 1""", "gt pred")
def nearest_matches(spark, d):
    """The nearest prediction within 5 pixels of each true object."""
    return _matched_places(spark, d, "left").select("frame", "id", "pred_id", _r(F.sqrt("sq")).alias("dist"))


def _matched_places(spark, d, how: str = "inner"):
    """True objects with the nearest prediction within 5 pixels (``pred_id``, ``sq``, ``px``, ``py``). Objects of one place have the same one, so places are matched."""
    g, p = S.ground_truth(spark, d), S.predictions(spark, d)
    given = p.groupBy(F.col("frame").alias("f"), F.col("x").alias("u"), F.col("y").alias("v")).agg(F.min("id").alias("pred_id"))
    sq = (F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2
    near = graph.near(g.select(F.col("frame").alias("f"), "x", "y").distinct(), given, 5.5).withColumn("sq", sq).filter("sq <= 25")  # half a pixel more, for rounding
    near = near.groupBy("f", "x", "y").agg(F.min(F.struct("sq", "pred_id", F.col("u").alias("px"), F.col("v").alias("py"))).alias("m"))
    return g.join(near.select(F.col("f").alias("frame"), "x", "y", "m.*"), ["frame", "x", "y"], how)


@query("""WITH c AS (SELECT p.frame, p.id, count(g.id) AS n FROM pred p LEFT JOIN gt g ON p.frame = g.frame AND (g.x - p.x) ** 2 + (g.y - p.y) ** 2 <= 9 GROUP BY 1, 2)
SELECT CASE WHEN n = 0 THEN 'noise' WHEN n = 1 THEN 'single' ELSE 'multi' END AS class, count(*) AS n FROM c GROUP BY 1""", "gt pred")
def region_cardinalities(spark, d):
    """Predictions by the number of true objects near them."""
    g = S.ground_truth(spark, d).select("frame", F.col("x").alias("px"), F.col("y").alias("py"))
    p = S.predictions(spark, d)
    hit = _in_reach(p, g, 3).filter((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2 <= 9).groupBy("frame", "id").agg(F.count(F.lit(1)).alias("n"))
    c = p.select("frame", "id").join(hit, ["frame", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy(F.when(F.col("n") == 0, "noise").when(F.col("n") == 1, "single").otherwise("multi").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT f.frame, o.obj_id AS id, d.x, d.y FROM (SELECT DISTINCT frame FROM du) f CROSS JOIN (SELECT DISTINCT obj_id FROM du) o LEFT JOIN du d ON d.frame = f.frame AND d.obj_id = o.obj_id""", "du")
def trajectory_grid(spark, d, step=1):
    """The dense grid of frames and identities, missing cells null (X1, D17); every ``step``-th frame for X79.

    Identities are dealt to parts by their hash, and each part meets all frames: none is held whole in one place.
    """
    r = S.unique_detections(spark, d)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = r.select(F.col("obj_id").alias("id")).distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    frames = r.select("frame").distinct()
    frames = (frames.filter(F.col("frame") % step == 0) if step > 1 else frames).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    grid = ids.join(frames, "part").select("frame", "id")
    return grid.join(r.select("frame", F.col("obj_id").alias("id"), "x", "y"), ["frame", "id"], "left")


@query("""WITH m AS (SELECT g.frame, g.id AS o, p.id AS h FROM gt g JOIN pred p ON p.frame = g.frame AND p.id = g.id AND (g.x - p.x) ** 2 + (g.y - p.y) ** 2 <= 25),
c AS (SELECT (SELECT count(*) FROM gt) AS n_gt, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM m) AS idtp)
SELECT n_gt, n_pred, idtp, n_pred - idtp AS idfp, n_gt - idtp AS idfn, round(idtp / n_pred, 6) AS idp, round(idtp / n_gt, 6) AS idr, round(2 * idtp / (n_gt + n_pred), 6) AS idf1 FROM c""", "gt pred")
def identity_scores(spark, d):
    """Identity precision, recall and F1 under the one assignment of predicted to true ids that matches most."""
    g, p = S.ground_truth(spark, d), S.predictions(spark, d)
    n = g.agg(F.count(F.lit(1)).alias("n_gt")).crossJoin(p.agg(F.count(F.lit(1)).alias("n_pred")))
    j = n.crossJoin(_assigned(spark, g, p).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("idtp")))
    return j.selectExpr("n_gt", "n_pred", "idtp", "n_pred - idtp AS idfp", "n_gt - idtp AS idfn", "round(idtp / n_pred, 6) AS idp", "round(idtp / n_gt, 6) AS idr", "round(2 * idtp / (n_gt + n_pred), 6) AS idf1")


def _assigned(spark, g, p):
    """One assignment of predicted to true ids over all frames: ``id``, ``h`` and their common frames within 5 pixels, ``n``.

    Spark counts the frames. Ids that votes connect, however far, are one component and one group; its
    assignment holds a square of its own ids.
    """
    reach_workers(spark)
    p = p.select("frame", F.col("id").alias("h"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = _in_reach(g, p, 5).filter((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= 25)
    votes = _written(spark)(near.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")))

    def assign(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernels.best_pairs(b["id"].tolist(), b["h"].tolist(), b["n"].tolist()), columns=["id", "h", "n"])

    return bipartite_components(votes, "id", "h", _written(spark)).groupBy("component").applyInPandas(assign, "id int, h int, n bigint")


@query()
def clear_mot(spark, d):
    """CLEAR-MOT metrics of the whole sequence, matched frame by frame.

    Each frame needs the one before, but only for ids that come near each other in some frame: the
    components of such pairs are matched apart. A task reads its components' sorted frames as a stream and
    holds a frame and the last pairs; Spark counts the matches. Ids that meet no other are spread by their own.
    """
    reach_workers(spark)
    g, p = S.ground_truth(spark, d), S.predictions(spark, d)
    met = _in_reach(g, p.select("frame", F.col("id").alias("h"), F.col("x").alias("px"), F.col("y").alias("py")), 5)
    met = met.filter((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= 25).select("id", "h").distinct()
    parts = _written(spark)(bipartite_components(met, "id", "h", _written(spark)))
    part = lambda c: parts.select(F.col(c).alias("id"), F.struct(F.lit(1).alias("kind"), F.col("component").alias("of")).alias("part")).distinct()
    side = lambda t, c, k: t.select("frame", "id", "x", "y", F.lit(k == 2).alias("truth")).join(part(c), "id", "left").withColumn("part", F.coalesce("part", F.struct(F.lit(k).alias("kind"), F.col("id").cast("bigint").alias("of"))))
    rows = side(g, "id", 2).unionByName(side(p, "h", 3)).select(F.col("part.kind").alias("kind"), F.col("part.of").alias("of"), "frame", "id", "x", "y", "truth")

    def match(batches):
        matcher, rest, now = None, None, None

        def step(part: tuple[int, int], x: pd.DataFrame) -> pd.DataFrame:
            nonlocal matcher, now
            if part != now:
                matcher, now = kernels.MotMatcher(5.0), part
            side = lambda t: {i: (u, v) for i, u, v in x.loc[x["truth"] == t, ["id", "x", "y"]].itertuples(index=False)}
            out = pd.DataFrame(matcher.step(side(True), side(False)), columns=["id", "h", "sq", "switched"])
            return out.assign(frame=x["frame"].iloc[0]).astype({"id": "Int32", "h": "Int32", "sq": "float64"})[["frame", "id", "h", "sq", "switched"]]

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            end = b.iloc[-1]  # the last frame may go on in the next batch
            open_ = (b["kind"] == end["kind"]) & (b["of"] == end["of"]) & (b["frame"] == end["frame"])
            for (kind, of, _), x in b[~open_].groupby(["kind", "of", "frame"], sort=True):
                yield step((kind, of), x)
            rest = b[open_]
        if rest is not None and len(rest):
            yield step((rest["kind"].iloc[0], rest["of"].iloc[0]), rest)

    pairs = rows.repartition("kind", "of").sortWithinPartitions("kind", "of", "frame").mapInPandas(match, "frame int, id int, h int, sq double, switched boolean")
    # predictions without a partner have no true id; they are spread by their own
    pairs = pairs.withColumn("lone", F.when(F.col("id").isNull(), F.col("h")))
    w, hit = Window.partitionBy("id", "lone").orderBy("frame"), F.col("h").isNotNull()
    pairs = pairs.withColumns({"hit": hit, "lost": F.col("id").isNotNull() & hit & ~F.lead(hit).over(w)})
    per = pairs.groupBy("id", "lone").agg(
        F.count("id").alias("objects"), F.count("h").alias("predictions"), F.count("sq").alias("detections"), F.count_if("switched").alias("switches"), F.sum("sq").alias("sq"),
        F.count_if("lost").alias("lost"), F.max_by("hit", "frame").alias("last"),
    )
    true, ratio = F.col("id").isNotNull(), F.col("detections") / F.nullif(F.col("objects"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    t = per.agg(
        total(F.col("detections") - F.col("switches")).alias("num_matches"), total("switches").alias("num_switches"), total(F.col("predictions") - F.col("detections")).alias("num_false_positives"),
        total(F.col("objects") - F.col("detections")).alias("num_misses"), total("objects").alias("num_objects"), total("predictions").alias("num_predictions"),
        total(F.when(true, F.col("lost") - (~F.col("last") & (F.col("detections") > 0)).cast("int"))).alias("num_fragmentations"), total("detections").alias("num_detections"),
        F.count_if(true & (ratio >= 0.8)).cast("double").alias("mostly_tracked"), F.count_if(true & (ratio < 0.2)).cast("double").alias("mostly_lost"),
        F.count_if(true & (ratio >= 0.2) & (ratio < 0.8)).cast("double").alias("partially_tracked"), total("sq").alias("sq"),
    )
    return t.selectExpr(
        "* EXCEPT (sq)", "1 - (num_misses + num_switches + num_false_positives) / greatest(1, num_objects) AS mota", "sq / greatest(1, num_detections) AS motp", "sqrt(sq / greatest(1, num_detections)) AS motp_px",
        "num_detections / greatest(1, num_detections + num_false_positives) AS precision", "num_detections / greatest(1, num_objects) AS recall",
    )


@query()
def identity_assignment(spark, d):
    """Predicted ids assigned to true ids by co-occurrence over all frames."""
    return _assigned(spark, S.ground_truth(spark, d), S.predictions(spark, d))


@query("""SELECT a, b, n, round(m.dist, 4) AS min_dist, m.frame AS min_frame FROM (SELECT a, b, count(*) AS n, min(struct_pack(dist := dist, frame := frame)) AS m
FROM (SELECT a.tracklet_id AS a, b.tracklet_id AS b, a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM tre a JOIN tre b ON a.frame = b.frame AND a.tracklet_id < b.tracklet_id) GROUP BY 1, 2)""", "tre")
def common_frame_distance(spark, d):
    """Least distance of any two tracklets over their common frames, and its first frame (J17); a is the lesser id.

    Pairs that share no frame have no row: ``intervals.path_distances`` gives their 99999 and -1 for pairs that are asked for.
    """
    return intervals.path_distances(intervals.tracklet_regions(S.unique_detections(spark, d))).withColumn("min_dist", _r(F.col("min_dist")))


@query("SELECT obj_id, CAST(n AS BIGINT) AS support, CAST(row_number() OVER (ORDER BY n DESC, obj_id) - 1 AS INT) AS new_id FROM (SELECT obj_id, count(*) AS n FROM du GROUP BY obj_id)", "du")
def remapped_ids(spark, d):
    """Identities renumbered by falling support."""
    s = S.unique_detections(spark, d).groupBy("obj_id").agg(F.count(F.lit(1)).alias("support"))
    return intervals.numbered(s, [F.col("support").desc(), F.col("obj_id")], _written(spark)).select("obj_id", "support", F.col("k").cast("int").alias("new_id"))


@query("""SELECT obj_id, label, n FROM (SELECT obj_id, label, count(*) AS n FROM reg GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, label) = 1""", "reg")
def majority_class(spark, d):
    """The most frequent class of each object, ties to the lower."""
    c = S.regions(spark, d).groupBy("obj_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("obj_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b")).selectExpr("obj_id", "b.label", "-b.m AS n")


@query("""SELECT * FROM ((SELECT 'longest' AS kind, tracklet_id, n FROM tr ORDER BY n DESC, tracklet_id LIMIT 10) UNION ALL (SELECT 'shortest', tracklet_id, n FROM tr ORDER BY n, tracklet_id LIMIT 10))""", "tr")
def extreme_tracklets(spark, d):
    """The ten longest and ten shortest tracklets (K6)."""
    t = intervals.islands(S.unique_detections(spark, d)).select("tracklet_id", "n")
    top = lambda kind, o: t.orderBy(o, "tracklet_id").limit(10).select(F.lit(kind).alias("kind"), "tracklet_id", "n")
    return top("longest", F.col("n").desc()).union(top("shortest", F.col("n")))


@query("""SELECT round(quantile_cont(value, 0.8), 4) AS p80, round(max(value), 4) AS top, event_type FROM events GROUP BY event_type""")
def background_levels(spark, d):
    """80th percentile and maximum of each group, as for background pixels."""
    return S.table(spark, d, "events").groupBy("event_type").agg(_r(F.percentile("value", 0.8)).alias("p80"), _r(F.max("value")).alias("top"))


@query("""SELECT least(9, CAST(floor(x / (SELECT max(x) FROM det) * 10) AS INT)) AS bx, least(9, CAST(floor(y / 100 * 10) AS INT)) AS by, count(*) AS n FROM det GROUP BY 1, 2""", "det")
def position_histogram(spark, d):
    """Two-dimensional histogram, last bin closed."""
    r = S.detections(spark, d)
    top = r.agg(F.max("x").alias("top"))
    b = lambda c: F.least(F.lit(9), F.floor(c * 10).cast("int"))
    return r.crossJoin(F.broadcast(top)).groupBy(b(F.col("x") / F.col("top")).alias("bx"), b(F.col("y") / 100).alias("by")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT obj_id, count(*) AS n, round(corr(x, y), 4) AS r FROM det GROUP BY obj_id HAVING count(*) > 2", "det")
def correlations(spark, d):
    """Correlation of coordinates for each object."""
    return S.detections(spark, d).groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"), _r(F.corr("x", "y")).alias("r")).filter("n > 2")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY obj_id) AS m FROM du) SELECT region_id, obj_id, frame FROM s WHERE m >= 10 AND k > floor(m * 0.1) AND k <= m - floor(m * 0.1)""", "du")
def trimmed_tracks(spark, d):
    """Rows of long tracks without a tenth at either end."""
    w = Window.partitionBy("obj_id")
    s = S.unique_detections(spark, d).withColumns({"k": F.row_number().over(w.orderBy("frame")), "m": F.count(F.lit(1)).over(w)})
    return s.filter("m >= 10 AND k > floor(m * 0.1) AND k <= m - floor(m * 0.1)").select("region_id", "obj_id", "frame")


@query("""SELECT region_id, round(sqrt(dx2 * dx2 + dy2 * dy2), 4) AS d, round((dx1 * dx2 + dy1 * dy2) / s1, 4) AS along, round((dx1 * dy2 - dy1 * dx2) / s1, 4) AS across
FROM (SELECT *, sqrt(dx1 * dx1 + dy1 * dy1) AS s1 FROM (SELECT region_id, x - lag(x) OVER w AS dx1, y - lag(y) OVER w AS dy1, lead(x) OVER w - x AS dx2, lead(y) OVER w - y AS dy2 FROM tre WINDOW w AS (PARTITION BY tracklet_id ORDER BY frame))) WHERE s1 > 0 AND dx2 IS NOT NULL""", "tre")
def movement_descriptors(spark, d):
    """Next step seen along the last one, of three consecutive regions."""
    w = Window.partitionBy("tracklet_id").orderBy("frame")
    t = intervals.tracklet_regions(S.unique_detections(spark, d)).select(
        "region_id", (F.col("x") - F.lag("x").over(w)).alias("a"), (F.col("y") - F.lag("y").over(w)).alias("b"), (F.lead("x").over(w) - F.col("x")).alias("p"), (F.lead("y").over(w) - F.col("y")).alias("q"),
    )
    t = t.withColumn("s", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).filter("s > 0 AND p IS NOT NULL")
    return t.selectExpr("region_id", "round(sqrt(p * p + q * q), 4) AS d", "round((a * p + b * q) / s, 4) AS along", "round((a * q - b * p) / s, 4) AS across")


# Descriptors


@query("SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(v), 5) AS mean, count(*) AS n FROM ev GROUP BY label, i", "ev")
def mean_descriptors(spark, d):
    """Mean descriptor of each identity."""
    e = S.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT label, i, avg(v) AS v FROM ev GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.v - b.v) ** 2)), 4) AS dist, round(1 - sqrt(sum((a.v - b.v) ** 2)) / 3, 4) AS likeness, round(exp(-6.03 * sqrt(sum((a.v - b.v) ** 2))), 4) AS match
FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""", "ev")
def appearance_matrix(spark, d):
    """Distances and likenesses of the identities' mean descriptors."""
    e = S.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    dist = F.sqrt(F.sum((F.col("v") - F.col("v2")) ** 2))
    j = m.join(m.select(F.col("label").alias("b"), "i", F.col("v").alias("v2")), "i").filter("label < b")
    return j.groupBy(F.col("label").alias("a"), "b").agg(_r(dist).alias("dist"), _r(1 - dist / 3).alias("likeness"), _r(F.exp(-6.03 * dist)).alias("match"))


@query()
def descriptor_prototypes(spark, d):
    """At most five prototypes of all descriptors of each identity."""
    reach_workers(spark)
    import numpy as np

    def build(b: pd.DataFrame) -> pd.DataFrame:
        got = kernels.prototypes(np.stack(b.sort_values("vec_id")["embedding"].tolist()).astype(float))
        return pd.DataFrame([(int(b["label"].iloc[0]), i, m.tolist(), n, s) for i, (m, n, s) in enumerate(got)], columns=["label", "proto_id", "descriptor", "weight", "std"])

    return S.table(spark, d, "embeddings").groupBy("label").applyInPandas(build, "label int, proto_id int, descriptor array<double>, weight bigint, std double")


@query("""WITH b AS (SELECT obj_id, CAST(floor((row_number() OVER (PARTITION BY obj_id ORDER BY region_id) - 1) / 120) AS BIGINT) AS block, y / 100 AS p FROM det), s AS (SELECT obj_id, block, sum(p) AS s1, sum(1 - p) AS s2 FROM b GROUP BY 1, 2)
SELECT obj_id, round(least(0.9999999999, avg(1 / (1 + pow(2, s2 - s1)))), 6) AS p1 FROM s GROUP BY obj_id""", "det")
def block_probabilities(spark, d):
    """Probability of an identity from blocks of 120 votes (M7, M8)."""
    w = Window.partitionBy("obj_id").orderBy("region_id")
    b = S.detections(spark, d).select("obj_id", F.floor((F.row_number().over(w) - 1) / 120).alias("block"), (F.col("y") / 100).alias("p"))
    s = b.groupBy("obj_id", "block").agg(F.sum("p").alias("s1"), F.sum(1 - F.col("p")).alias("s2"))
    return s.groupBy("obj_id").agg(F.round(F.least(F.lit(0.9999999999), F.avg(1 / (1 + F.pow(F.lit(2.0), F.col("s2") - F.col("s1"))))), 6).alias("p1"))


@query("""WITH p AS (SELECT q, string_split(w, ':') AS p FROM (SELECT q, unnest(string_split_regex(q, '[ ,]+')) AS w FROM (VALUES ('3:4:19'), ('0:10:100'), ('5:9'), ('1 2 30'), ('4,6,20:22')) t(q))),
s AS (SELECT q, CAST(p[1] AS INT) AS a, CASE WHEN len(p) = 3 THEN CAST(p[2] AS INT) ELSE 1 END AS step, CAST(p[len(p)] AS INT) AS b FROM p) SELECT CAST(a + step * k AS INT) AS frame, q FROM s, (SELECT unnest(range(0, 200)) AS k) WHERE a + step * k <= b""")
def frame_ranges(spark, d):
    """Frame lists written as numbers, start:end or start:step:end, between spaces or commas, ends included."""
    rows = spark.createDataFrame([("3:4:19",), ("0:10:100",), ("5:9",), ("1 2 30",), ("4,6,20:22",)], "q string")
    rows = rows.select("q", F.explode(F.split("q", "[ ,]+")).alias("word")).select("q", F.split("word", ":").cast("array<int>").alias("p"))
    step = F.when(F.size("p") == 3, F.get("p", F.lit(1))).otherwise(1)
    return rows.select(F.explode(F.sequence(F.element_at("p", 1), F.element_at("p", -1), step)).alias("frame"), "q")


@query("""SELECT 0 AS part, region_id FROM det WHERE frame < 50 UNION ALL SELECT 1, region_id + (SELECT count(*) FROM det WHERE frame < 50) FROM det WHERE frame >= 50""", "det")
def rebased_union(spark, d):
    """Two region tables put together, the second's ids moved behind the first's rows (U1, U6, SRC5)."""
    r = S.detections(spark, d)
    first = r.filter("frame < 50").select(F.lit(0).alias("part"), "region_id")
    n = first.agg(F.count(F.lit(1)).alias("n"))
    return first.unionByName(r.filter("frame >= 50").crossJoin(F.broadcast(n)).select(F.lit(1).alias("part"), (F.col("region_id") + F.col("n")).alias("region_id")))


@query("""SELECT 'shared' AS kind, obj_id FROM (SELECT obj_id FROM du WHERE frame < 60 INTERSECT SELECT obj_id FROM du WHERE frame >= 60) UNION ALL SELECT 'first', obj_id FROM (SELECT obj_id FROM du WHERE frame < 60 EXCEPT SELECT obj_id FROM du WHERE frame >= 60)""", "du")
def shared_tracks(spark, d):
    """Identities of two sets: shared and only in the first."""
    r = S.unique_detections(spark, d)
    a, b = r.filter("frame < 60").select("obj_id"), r.filter("frame >= 60").select("obj_id")
    return a.intersect(b).select(F.lit("shared").alias("kind"), "obj_id").unionByName(a.subtract(b).select(F.lit("first").alias("kind"), "obj_id"))


@query("""SELECT t.region_id FROM du t WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.tracklet_id = t.region_id)""", "tr")
def inner_regions(spark, d):
    """Regions that start no tracklet."""
    r = S.unique_detections(spark, d)
    return r.join(intervals.islands(r).select(F.col("tracklet_id").alias("region_id")), "region_id", "left_anti").select("region_id")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(spark, d):
    """Tracklets in time: events of an object without a gap of six hours (2.14)."""
    from trackweave.streaming.tracklets import session_tracklets

    e = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return session_tracklets(e, "user_id", "ts", "6 hours").select("user_id", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))
