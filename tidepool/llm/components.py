"""Connected components by alternating large-star and small-star steps, on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, park

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (u, v: long): the smallest vertex reachable.

    Each step keeps, for every vertex, one edge to the least neighbour it knows, so the
    table never outgrows the edges; minima are aggregated before the shuffle. Steps go
    on until the edges form stars.
    """
    edges = park(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        # Large star: every larger neighbour of x moves to the least of x and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = edges.join(least, edges["v"] == least["x"]).select(F.col("u"), F.col("m").alias("v"))
        # x's own edge to m, for x with a smaller neighbour, comes from that neighbour's side.
        large = large.filter("u <> v").distinct()
        # Small star: x's smaller neighbours, and x, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.withColumnRenamed("u", "x"), large["u"] == F.col("x")).select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
        last, edges = edges, park(moved.filter("u <> v").distinct())
        discard(last)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    own = edges.select("u", "v").groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component")
    roots = edges.select("v").distinct().join(own.select("v"), "v", "left_anti").select("v", F.col("v").alias("component"))
    out = park(own.union(roots))
    discard(edges)
    return out
