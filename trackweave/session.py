"""Session helpers: a local session for tests and benchmarks, and the workers' import path."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library's results assume (UTC)."""
    conf = {
        "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed for them (a local checkout)."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([ROOT, *known])
