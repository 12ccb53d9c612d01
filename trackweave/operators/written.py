"""Tables written to cut a plan's lineage: Parquet in the folder of the session's checkpoints, removed when a later round stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def writer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table once and returns the written one. The checkpoint folder must be set."""
    top = spark.sparkContext.getCheckpointDir().rstrip("/")

    def write(df: DataFrame) -> DataFrame:
        path = f"{top}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    return write


def forget(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing will read any more; others (a plain checkpoint, a plan) are left alone."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
