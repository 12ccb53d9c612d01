"""Shared scratch space: tables that cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a folder of its own; a cluster without
    the setting is refused, because a machine-local folder would not be seen by its executors.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=4)
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="trackweave-")


#: Folders written within ``cleared``, innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that ``stored`` writes meanwhile, at the end or after a failure.

    A caller that writes an operator's result out wraps both; what is returned lazily would lose its tables.
    """
    mine: list[str] = []
    _WRITTEN.append(mine)
    try:
        yield
    finally:
        _WRITTEN.pop()
        for path in mine:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is still there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    Later reads start from the files: nothing is computed twice, and a lost executor costs at
    most the task that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            removed(table.sparkSession, folder)


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send few texts at a time to Python; a session that asks for still smaller batches keeps them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A Python task that gives its free memory back at its end: workers wait for further tasks, beside other stages."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run
