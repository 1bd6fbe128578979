"""Cutting lineage through the cluster's shared folder, and small job helpers."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_folder, until_exit

def park(df: DataFrame, group_bytes: int = 0) -> DataFrame:
    """Write a frame to the shared folder once and read it back: lineage ends here.

    The table lies on shared storage, so a lost executor costs no recomputation.
    ``group_bytes``: size of row groups, which a writing task holds in memory, if not Parquet's own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidepool-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", max(1, group_bytes >> 12))
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidepool_path = path
    until_exit(spark, path)
    return out


def discard(*parked: DataFrame) -> None:
    """Deletes parked tables; only for those that no later job reads, not even to recompute."""
    for df in parked:
        delete(df.sparkSession, df._tidepool_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until the frame has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_with(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in the one column of ``ids`` (nulls match); all columns stay."""
    (name,) = unused(df, "kept_id")
    ids = ids.toDF(name).distinct()
    return df.join(ids, df["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")


def small_hashes(df: DataFrame, column: str, most: int) -> list[tuple]:
    """A sample for the driver: the distinct values with the smallest hashes, at most ``most``.

    A threshold on the hash, from the number of distinct values, picks the rows in place, so
    no task meets more than the sample.
    """
    hashed = df.select(F.xxhash64(column).alias("h"), column)
    distinct = max(1, hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0])
    share = min(1.0, 0.9 * most / distinct)
    if share < 1 and distinct > most:
        hashed = hashed.filter(F.col("h") < int(-(1 << 63) + share * (1 << 64)))
    picked = hashed.groupBy("h").agg(F.first(column).alias(column)).orderBy("h").limit(most)
    return [(r[1],) for r in picked.collect()]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Asks the driver to forget finished plans, so that Spark's cleaner deletes their shuffle files.

    The first collection lets go of Python's handles, the second of what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
