"""Novelty of texts against a corpus by a packed inverted index of character 4-grams.

The corpus is cut into shards of at most GRAMS grams (or one text), so a shard's index has a
known size and is broadcast: sorted grams, and for each the corpus texts that hold it, as arrays.
Rows pass over a shard in one Arrow pass; a row's overlaps with all texts of the shard
are one count over its grams' postings. No gram is shuffled; what comes back is the best
similarity of a row for each shard. Grams are compared as numbers of 64 bits: exact for
characters of the basic plane, hashed for others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, park

GRAMS = 1 << 22
BLOCK = 4096  # texts of a period on either side of a comparison
K = 4


def grams(text: str) -> np.ndarray:
    """Distinct 4-grams of a text as sorted numbers; a shorter text is its own, an empty one has none."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < K:
        codes = np.append(codes, np.zeros(K - len(codes), np.uint64))
    n = len(codes) - K + 1
    out = np.zeros(n, np.uint64)
    for i in range(K):
        out |= (codes[i : i + n] & np.uint64(0xFFFF)) << np.uint64(16 * i)
    beyond = codes >> np.uint64(16)
    if beyond.any():
        for i in range(K):
            out ^= beyond[i : i + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    return np.unique(out)


def _packed(batches):
    for batch in batches:
        found = [grams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array([len(g) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())], names=["text_id", "n", "grams"])


class Postings:
    """The index of a shard: distinct grams, where their postings begin, the postings, and the texts' sizes."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, texts: np.ndarray, sizes: np.ndarray):
        self.terms, self.starts, self.texts, self.sizes = terms, starts, texts, sizes

    @classmethod
    def of(cls, found: list[np.ndarray]) -> Postings:
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(found), dtype=np.int32), [len(g) for g in found])
        order = np.argsort(every, kind="stable")
        terms, starts = np.unique(every[order], return_index=True)
        return cls(terms, np.append(starts, len(every)), text[order], np.array([len(g) for g in found], np.int64))

    def similarities(self, own: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a set of grams with every text of the shard."""
        if not len(own) or not len(self.terms):
            return np.zeros(len(self.sizes))
        at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        at = at[self.terms[at] == own]
        lo, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        both = np.bincount(self.texts[place], minlength=len(self.sizes))
        return both / (len(own) + self.sizes - both)


def novelty(rows: DataFrame, ids: list[str], corpus: DataFrame, item: str, near: float | None = None) -> DataFrame:
    """(ids, novelty): 1 minus the greatest Jaccard similarity of a text's grams with a corpus text's; a text without grams has 0, an empty corpus gives 1.

    With ``near`` also the number of corpus texts that are more similar than that. Rows that share ids
    are judged as one by their most similar text.
    """
    spark = rows.sparkSession
    named = corpus.select(F.col(item).cast("string").alias("text_id"), "text")
    packed = park(named.mapInArrow(_packed, "text_id string, n long, grams binary").filter("n > 0"))
    total, widest = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    # Twice as many as would do, so that a shard by hash keeps within the bound.
    shards = 1 if total <= GRAMS else 2 * -(-total // GRAMS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*ids).schema)

    def judged(shared):
        def run(batches):
            index = Postings(*shared.value)
            for batch in batches:
                best, close, some = [], [], []
                for text in batch.column("text").to_pylist():
                    own = grams(text or "")
                    like = index.similarities(own)
                    some.append(len(own) > 0)
                    best.append(float(like.max(initial=0.0)))
                    close.append(int(np.count_nonzero(like > near)) if near is not None else 0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(some), pa.array(best, pa.float64()), pa.array(close, pa.int64())], names=[*ids, "some", "best", "close"])

        return run

    out = None
    for s in range(shards):
        held = packed.filter(F.pmod(F.xxhash64("text_id"), F.lit(shards)) == s).select("grams").collect()
        index = Postings.of([np.frombuffer(r.grams, np.uint64) for r in held])
        shared = spark.sparkContext.broadcast((index.terms, index.starts, index.texts, index.sizes))
        found = rows.select(*ids, "text").mapInArrow(judged(shared), f"{kinds}, some boolean, best double, close long")
        out = found if out is None else out.unionByName(found)
    discard(packed)
    out = out.groupBy(*ids).agg(F.max("some").alias("some"), F.max("best").alias("best"), F.sum("close").alias("close"))
    more = [F.col("close").alias("n_near")] if near is not None else []
    return out.select(*ids, F.when(~F.col("some"), 0.0).otherwise(1 - F.col("best")).alias("novelty"), *more)


def _compared(period: str, text: str, near: float):
    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        index, weights = Postings.of([grams(x) for x in held["_text"]]), held["_rows"].to_numpy(np.int64)
        best, close = [], []
        for own in rows[text]:
            like = index.similarities(grams(own))
            best.append(float(like.max(initial=0.0)))
            close.append(int(weights[like > near].sum()))
        return pd.DataFrame({period: rows[period], text: rows[text], "best": best, "close": close})

    return run


def against_last_period(texts: DataFrame, period: str, text: str, count: str, near: float, size: int = BLOCK) -> DataFrame:
    """(period, text, best, close): the greatest similarity of a period's text with one of the period before, and the rows of texts more similar than ``near``.

    ``texts`` holds each distinct text of a period once, with its ``count`` of rows; periods are whole numbers. Every text is held against every one of the
    period before, by blocks of about ``size`` texts on either side: a pair of blocks is a group, and an index of the one is all that it holds.
    """
    blocks = texts.groupBy(period).agg(F.ceil(F.count("*") / size).cast("int").alias("_k"))
    both = blocks.withColumnRenamed("_k", "_chunks").join(blocks.select((F.col(period) + 1).alias(period), F.col("_k").alias("_shards")), period)
    own = lambda k: F.pmod(F.xxhash64(text), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rows = texts.join(F.broadcast(both), period).select(period, text, own("_chunks").alias("_chunk"), every("_shards").alias("_shard"))
    held = texts.withColumn(period, F.col(period) + 1).join(F.broadcast(both), period).select(F.col(period).alias("_p"), F.col(text).alias("_text"), F.col(count).alias("_rows"), own("_shards").alias("_s"), every("_chunks").alias("_c"))
    kind = texts.schema[period].dataType.simpleString()
    found = rows.groupBy(period, "_chunk", "_shard").cogroup(held.groupBy("_p", "_c", "_s")).applyInPandas(_compared(period, text, near), f"{period} {kind}, {text} string, best double, close long")
    return found.groupBy(period, text).agg(F.max("best").alias("best"), F.sum("close").alias("close"))
