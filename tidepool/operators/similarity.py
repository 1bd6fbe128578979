"""Similarity: Hamming pairs and clusters, Jaccard of shingles, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import label_components
from .hamming import near_hashes

def sign_bits(embedding: str) -> Column:
    """The signs of a 64-dimensional vector as a 64-bit fingerprint."""
    # The top bit is the sign bit of the long, so shifts wrap as wanted.
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.element_at(embedding, i + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def hamming_pairs(df: DataFrame, id_: str, bits: str, distance: int) -> DataFrame:
    """Pairs (a < b) of rows whose 64-bit fingerprints are within ``distance``, by a search over distinct fingerprints."""
    near = near_hashes(df, bits, distance)
    one = df.select(F.col(id_).alias("i"), F.col(bits).alias("hi"))
    two = df.select(F.col(id_).alias("j"), F.col(bits).alias("hj"))
    apart = near.join(one, F.col("x") == F.col("hi")).join(two, F.col("y") == F.col("hj")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    equal = one.join(two, (F.col("hi") == F.col("hj")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(equal)


def hamming_clusters(df: DataFrame, id_: str, bits: str, distance: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, cluster): connected components of the fingerprints of a key within ``distance``; a cluster is named by its least fingerprint.

    Components are those of distinct fingerprints, so copies of one make no pairs.
    """
    keys = keys or []
    edges = near_hashes(df, bits, distance, keys, forest=True)
    if keys:
        code = F.xxhash64(*keys)  # a vertex is a fingerprint of a key
        edges = edges.select(F.xxhash64(code, "x").alias("u"), F.xxhash64(code, "y").alias("v"))
        vertex = F.xxhash64(code, bits)
    else:
        edges, vertex = edges.select(F.col("x").alias("u"), F.col("y").alias("v")), F.col(bits)
    found = label_components(edges).withColumnsRenamed({"v": "_v", "component": "_c"})
    rows = df.filter(F.col(bits).isNotNull()).withColumn("_vertex", vertex)
    return rows.join(found, F.col("_vertex") == F.col("_v"), "left").select(*keys, id_, F.coalesce("_c", "_vertex").alias("cluster"))


def char_shingles(text: Column, k: int = 4) -> Column:
    """Distinct character k-grams; a shorter text is its own, an empty one has none."""
    # The text is a lambda's argument, so that it isn't computed anew for every gram.
    own = F.transform(F.array(text), lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return F.array_remove(F.array_distinct(F.flatten(own)), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; two empty ones give 1."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def bm25(rows: DataFrame, ids: list[str], text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 scores of the documents that hold one of the terms."""
    words = rows.select(*ids, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("w"))
    lengths = words.groupBy(*ids).agg(F.count("*").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("al"))
    tf = words.filter(F.col("w").isin(terms)).groupBy(*ids, "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "w").join(lengths, ids).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("al")))
    return scored.groupBy(*ids).agg(F.sum(one).alias("score"))
