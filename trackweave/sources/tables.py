"""Sources and sinks: the driver's tables as detections, regions and tracklets; MOT files; project folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_US, FRAME_US = 1704067200000000, 21600000000
MOT_SCHEMA = "frame int, id int, x double, y double, width double, height double, confidence double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: ``region_id``, ``obj_id``, ``frame`` (six hours each), ``x``, ``y``."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS region_id", "CAST(user_id AS INT) AS obj_id",
        f"CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) / {FRAME_US}) AS INT) AS frame",
        "value AS x", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS y",
    )


def unique_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first detection of each object in each frame."""
    rows = detections(spark, sf_dir)
    least = F.min(F.struct("region_id", "x", "y")).alias("d")
    return rows.groupBy("obj_id", "frame").agg(least).select("d.region_id", "obj_id", "frame", "d.x", "d.y")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with moments, bounding box, label and intensity, derived from the id."""
    return detections(spark, sf_dir).selectExpr(
        "*", "y + 1 AS sxx", "x / 10 + 1 AS syy", "((region_id % 7) - 3) / 10.0D AS sxy", "CAST(50 + region_id % 200 AS BIGINT) AS area",
        "CAST(floor(x) AS INT) AS roi_x", "CAST(floor(y) AS INT) AS roi_y", "CAST(1 + region_id % 20 AS INT) AS roi_w", "CAST(1 + region_id % 15 AS INT) AS roi_h",
        "CAST(region_id % 5 AS INT) AS label", "CAST(region_id % 11 AS INT) AS margin", "CAST(region_id % 256 AS INT) AS min_intensity",
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_detections(spark, sf_dir).selectExpr("frame", "obj_id AS id", "x", "y")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracker's output: some rows are missing, some moved, some have another's id."""
    rows = unique_detections(spark, sf_dir)
    n = rows.agg(F.max("obj_id") + 1).first()[0] or 1
    rows = rows.filter("region_id % 11 <> 0").selectExpr("region_id", "frame", f"CASE WHEN region_id % 97 = 0 THEN (obj_id + 1) % {n} ELSE obj_id END AS id", "x + region_id % 3 AS x", "y")
    least = F.min(F.struct("region_id", "x", "y")).alias("d")
    return rows.groupBy("frame", "id").agg(least).select("frame", "id", "d.x", "d.y")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """A MOT CSV; -1 in x or y means missing and becomes null."""
    rows = spark.read.schema(MOT_SCHEMA).option("header", True).csv(path)
    return rows.withColumns({c: F.when(F.col(c) != -1, F.col(c)) for c in ("x", "y")})


def write_mot(rows: DataFrame, path: str) -> None:
    """Trajectories as MOT CSV files, sorted inside each; missing values become -1."""
    full = {"width": -1.0, "height": -1.0, "confidence": 1.0}
    out = rows.select("frame", "id", *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in ("x", "y")], *[(F.col(c) if c in rows.columns else F.lit(v)).alias(c) for c, v in full.items()])
    out.sortWithinPartitions("frame", "id").write.mode("overwrite").option("header", True).csv(path)


def write_detections(regions: DataFrame, path: str) -> None:
    """Regions as CSV files of frame, centre and box size, sorted by frame inside each."""
    out = regions.select("frame", "x", "y", F.col("roi_w").alias("width"), F.col("roi_h").alias("height"))
    out.sortWithinPartitions("frame").write.mode("overwrite").option("header", True).csv(path)


TRACKLETS_JSON = "tracklet_id bigint, nodes array<bigint>"
GRAPH_JSON = "vertex bigint, out array<struct<dst:bigint,score:double>>"


def write_tracklets_json(rows: DataFrame, path: str) -> None:
    """Tracklets as JSON lines, each with its regions in order. ``rows``: ``tracklet_id``, ``pos``, ``region_id``."""
    nodes = F.sort_array(F.collect_list(F.struct("pos", "region_id")))["region_id"].alias("nodes")
    rows.groupBy("tracklet_id").agg(nodes).write.mode("overwrite").json(path)


def read_tracklets_json(spark: SparkSession, path: str) -> DataFrame:
    """``tracklet_id``, ``pos`` and ``region_id`` of JSON lines; a tracklet without regions has no row."""
    rows = spark.read.schema(TRACKLETS_JSON).json(path)
    return rows.select("tracklet_id", F.posexplode("nodes").alias("pos", "region_id"))


def write_graph_json(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """The region graph as JSON lines: each vertex (``region_id``) with its edges (``src``, ``dst``, ``score``) in order of their targets."""
    out = edges.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(F.struct("dst", "score"))).alias("out"))
    vertices.select(F.col("region_id").alias("vertex")).join(out, "vertex", "left").write.mode("overwrite").json(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (``region_id``) and edges of a graph's JSON lines."""
    rows = spark.read.schema(GRAPH_JSON).json(path)
    return rows.select(F.col("vertex").alias("region_id")), rows.select(F.col("vertex").alias("src"), F.inline("out"))


def read_position_text(spark: SparkSession, path: str, objects: int, folders: list[str] | None = None) -> DataFrame:
    """Another tracker's text: tab-separated lines of a frame number and x, y and certainty of each object; missing places (NaN) give no row.

    ``folders`` names the columns that the folders of the files stand for.
    """
    cells = ", ".join(f"x{i} double, y{i} double, p{i} double" for i in range(objects))
    more = "".join(f", {c} string" for c in folders or [])
    rows = spark.read.schema(f"frame int, {cells}{more}").option("sep", "\t").option("nanValue", "NaN").option("header", True).csv(path)
    each = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"p{i}").alias("certainty")) for i in range(objects)])
    return rows.select("frame", *(folders or []), F.inline(each)).filter("x IS NOT NULL AND NOT isnan(x)")


def save_project(tables: dict[str, DataFrame], path: str) -> None:
    """A project folder: one Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_project(spark: SparkSession, path: str, required: list[str], optional: dict[str, T.StructType | str] | None = None) -> dict[str, DataFrame]:
    """Read a project's tables. A missing required table raises; a missing optional one is empty."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in required}
    for name, schema in (optional or {}).items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], schema)
    return out


def read_wide(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV of columns ``<object>_<property>`` as long rows: ``row``, ``obj``, and a column for each property."""
    wide = spark.read.option("header", True).option("sep", separator).option("inferSchema", True).csv(path).withColumn("row", F.monotonically_increasing_id())
    named = [(c, *c.split("_", 1)) for c in wide.columns if c.split("_", 1)[0].isdigit()]
    objects, props = sorted({o for _, o, _ in named}, key=int), list(dict.fromkeys(p for _, _, p in named))
    have = {(o, p): c for c, o, p in named}
    cells = F.array(*[F.struct(F.lit(int(o)).alias("obj"), *[(F.col(have[o, p]) if (o, p) in have else F.lit(None)).cast("double").alias(p) for p in props]) for o in objects])
    return wide.select("row", F.inline(cells))


def write_evaluation(metrics: DataFrame, folder: str) -> None:
    """Metrics as ``evaluation.csv`` in an experiment's folder: one file by its form, of a row or a few."""
    spark = metrics.sparkSession
    metrics.coalesce(1).write.option("header", True).csv(f"{folder}/written")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/written")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/evaluation.csv"))
    fs.delete(path(f"{folder}/written"), True)


def read_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation CSVs below a folder, tagged by data set, experiment and the date in its name."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "evaluation.csv").csv(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.element_at(parts, -2)
    stamp = F.coalesce(F.try_to_timestamp(F.substring(name, 1, 11), F.lit("yyMMdd_HHmm")), F.try_to_timestamp(F.substring(name, 1, 6), F.lit("yyMMdd")))
    return rows.select("*", name.alias("experiment"), stamp.alias("datetime"))
