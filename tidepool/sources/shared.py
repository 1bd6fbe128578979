"""The folder that a job's processes share, for tables between its steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidepool-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def until_exit(spark: SparkSession, path: str) -> None:
    """The table at ``path`` is deleted when the driver ends, if not before: frames that are handed out may still read it.

    The session knows its tables; a module's globals would travel to executors with the functions beside them.
    """
    if not hasattr(spark, "_tidepool_tables"):
        spark._tidepool_tables = set()
        atexit.register(_leave, spark)
    spark._tidepool_tables.add(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    getattr(spark, "_tidepool_tables", set()).discard(path)


def _leave(spark: SparkSession) -> None:
    for path in list(spark._tidepool_tables):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before the driver
            return


def park(df: DataFrame, rows: int = 0) -> DataFrame:
    """Writes a frame to the shared folder once and reads it back, so that all that follows sees the same rows and a lost executor costs no recomputation.

    ``rows`` bounds those of a file. Readers fill a task by bytes and count a file as some megabytes at least, so narrow rows need it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidepool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidepool_path = path
    until_exit(spark, path)
    return out


def park_each(spark: SparkSession, makes: list[Callable[[], DataFrame]], at_once: int = 8) -> DataFrame:
    """Frames of one schema in one table, each written by a job of its own, several at a time: one plan of them all would be planned anew after each of its stages."""
    path = f"{shared_folder(spark)}/tidepool-{uuid.uuid4().hex}"
    until_exit(spark, path)

    def write(part: int, make: Callable[[], DataFrame]) -> StructType:
        df = make()
        df.write.option("compression", "zstd").parquet(f"{path}/part={part}")
        return df.schema

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(write), part, make) for part, make in enumerate(makes)]
        schemas = [job.result() for job in jobs]
    out = spark.read.schema(schemas[0]).parquet(path).drop("part")
    out._tidepool_path = path
    return out


def discard(*parked: DataFrame) -> None:
    """Deletes parked tables; only for those that no later job reads, not even to recompute."""
    for df in parked:
        delete(df.sparkSession, df._tidepool_path)
