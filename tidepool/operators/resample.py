"""Bootstrap by weights: every row draws its weight in every resample from its own key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cumulative probabilities of a Poisson(1) weight of 0, 1, 2, ...
_STEPS = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 8.0)))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(df: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 1337) -> DataFrame:
    """Percentile interval (lo, hi) of the mean by Poisson(1) weights.

    A weight depends on the row's key, the resample and the seed, so the result doesn't
    depend on how rows lie in partitions. A task reads its rows once and hands on two sums a
    resample; null values don't count; without rows both ends are null.
    """

    def sums(batches):
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            keys = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = batch.column("x").to_numpy(zero_copy_only=False)
            for b in range(resamples):
                u = (_mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * resamples + b)) >> np.uint64(11)) * 2.0**-53
                w = np.searchsorted(_STEPS, u, side="right")
                weight[b] += w.sum()
                total[b] += w @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["b", "w", "wx"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("x")).filter("k IS NOT NULL AND x IS NOT NULL")
    means = rows.mapInArrow(sums, "b long, w double, wx double").groupBy("b").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
