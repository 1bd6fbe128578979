"""Writing tables out in common formats and reading them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .shared import shared_folder, until_exit

FORMATS = ("csv", "json", "parquet", "orc")


def export(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def load(spark, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True).option("mode", "FAILFAST") if fmt == "csv" else reader).load(path)


def roundtrip(df: DataFrame, fmt: str) -> DataFrame:
    """Through a file format and back, in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    until_exit(spark, path)
    export(df, path, fmt)
    return load(spark, path, fmt, df.schema)
