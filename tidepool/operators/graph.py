"""Funding graphs: degrees, star components, siblings, general components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, until_exit


def qualifying_funders(holders: DataFrame, least: int = 2, share: float = 0.08) -> DataFrame:
    """(token_key, funded_by, degree, total): funders of enough of a token's holders, alone and as a share."""
    degree = holders.groupBy("token_key", "funded_by").agg(F.countDistinct("wallet").alias("degree"))
    total = holders.groupBy("token_key").agg(F.count("*").alias("total"))
    return degree.join(total, "token_key").filter((F.col("degree") >= least) & (F.col("degree") / F.col("total") >= share))


def funder_clusters(holders: DataFrame) -> DataFrame:
    """Holders with their ``component``: a wallet has one funder, so components are stars and need no iteration."""
    good = qualifying_funders(holders).select("token_key", "funded_by", F.lit(True).alias("_good"))
    joined = holders.join(good, ["token_key", "funded_by"], "left")
    return joined.withColumn("component", F.when(F.col("_good"), F.concat(F.lit("f"), F.col("funded_by"))).otherwise(F.concat(F.lit("w"), F.col("wallet")))).drop("_good")


def label_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(v, component) by minimum labels with pointer jumping; each round is written to the shared folder, and no unfinished labels are returned."""
    spark = edges.sparkSession
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    at = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    until_exit(spark, at)

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{at}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{at}/{name}")

    both = kept(both, "edges")
    labels = both.select(F.col("u").alias("v")).distinct().withColumn("c", F.col("v"))
    for number in range(rounds):
        near = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, labels["v"] == near["u"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        labels = kept(step.join(jump, "c").select("v", F.col("cc").alias("c"), (F.col("cc") != F.col("old")).alias("moved")), f"round-{number}")
        if not labels.filter("moved").limit(1).count():
            return labels.select("v", F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
