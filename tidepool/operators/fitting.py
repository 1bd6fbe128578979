"""Fitting metric weights on all labelled tokens: trials are broadcast, histograms come back.

A token's score is the weighted mean of its readings; an absent reading takes its metric's
mean. What a fit asks of the table is, for each trial, how tokens, labels and ranks of
labels lie over BINS bins of the score: each task sums that for all trials in one pass, the sums are
added up by (trial, bin), and a number of rows that depends on trials and bins alone comes to the
driver. Ranks of labels are counted over ranges once. So no matrix is gathered and no row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, park
from . import sequence

BINS = 4096
# Factors that a weight is tried with, tokens that a fit needs, the share of rank correlation in what is maximised.
FACTORS, LEAST, RANK_SHARE = (0.0, 0.5, 0.8, 1.25, 2.0), 200, 0.4


@dataclass(frozen=True)
class Labelled:
    """A parked row per labelled token: part (train or holdout), features in the order of ``metrics``, label, its rank in the part."""

    rows: DataFrame
    metrics: list[str]
    sizes: dict[str, tuple[int, float, float]]  # rows, sum of squared ranks, sum of labels


def labelled(values: DataFrame, labels: DataFrame) -> Labelled:
    """One token in four is held out, by a hash of its key."""
    means = {r.metric_id: r.m or 0.0 for r in values.groupBy("metric_id").agg(F.avg("normalized").alias("m")).collect()}
    metrics = sorted(means)
    if not metrics:
        return Labelled(values, [], {})
    each = values.groupBy("token_key").agg(*[F.avg(F.when(F.col("metric_id") == m, F.col("normalized"))).alias(f"_m{i}") for i, m in enumerate(metrics)])
    features = F.array(*[F.coalesce(F.col(f"_m{i}"), F.lit(float(means[m]))) for i, m in enumerate(metrics)])
    part = F.when(F.pmod(F.xxhash64("token_key"), F.lit(4)) == 3, "holdout").otherwise("train")
    joined = each.join(labels, "token_key").filter("label IS NOT NULL").select(part.alias("part"), features.alias("features"), F.col("label").cast("double").alias("label"))
    rows = park(sequence.average_rank(park(joined), ["part"], "label", "rank"))
    sizes = {r.part: (r.n, r.r, r.s) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("rank") * F.col("rank")).alias("r"), F.sum("label").alias("s")).collect()}
    return Labelled(rows, metrics, sizes)


def _histograms(shared):
    def run(batches):
        weights = shared.value  # trials x metrics
        sums = np.zeros((len(weights), BINS, 3))
        total = weights.sum(1)
        share = weights / np.where(total > 0, total, 1)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, -1)
            more = [np.ones(len(x)), np.asarray(batch.column("label")), np.asarray(batch.column("rank"))]
            # One fixed order of additions, so that a token falls into the same bin in any batch.
            score = np.zeros((len(weights), len(x)))
            for j in range(x.shape[1]):
                score += share[:, j, None] * x[None, :, j]
            bins = np.clip((score * BINS).astype(np.int64), 0, BINS - 1)
            for t in range(len(weights)):
                for k, v in enumerate(more):
                    sums[t, :, k] += np.bincount(bins[t], v, BINS)
        trial, at = np.nonzero(sums[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(at), *[pa.array(sums[trial, at, k]) for k in range(3)]], names=["trial", "bin", "n", "label", "rank"])

    return run


def objectives(data: Labelled, part: str, trials: np.ndarray) -> np.ndarray:
    """For each trial 0.4 of the rank correlation of score and label and 0.6 of a third of the top decile's lift, held to 0..1.

    Scores count to 1/BINS; tokens of one bin share their rank, and where the decile ends within a bin it takes the bin's mean label.
    """
    size, squares, labels = data.sizes.get(part, (0, 0.0, 0.0))
    out = np.zeros(len(trials))
    if not size:
        return out
    shared = data.rows.sparkSession.sparkContext.broadcast(np.asarray(trials, float))
    found = data.rows.filter(F.col("part") == part).select("features", "label", "rank").mapInArrow(_histograms(shared), "trial long, bin long, n double, label double, rank double")
    rows = found.groupBy("trial", "bin").agg(F.sum("n").alias("n"), F.sum("label").alias("label"), F.sum("rank").alias("rank")).toPandas()  # trials x BINS rows at most
    middle = (size + 1) / 2
    for t, own in rows.sort_values("bin").groupby("trial"):
        n, label, rank = (own[c].to_numpy() for c in ("n", "label", "rank"))
        place = np.cumsum(n) - (n - 1) / 2
        a, b = (n * place * place).sum() - size * middle**2, squares - size * middle**2
        rho = ((place * rank).sum() - size * middle**2) / np.sqrt(a * b) if a > 1e-9 and b > 1e-9 else 0.0
        lift, most = 0.0, size // 10
        if size >= 20 and labels:
            taken = np.clip(most - (np.cumsum(n[::-1]) - n[::-1]), 0, n[::-1])
            lift = (taken * label[::-1] / n[::-1]).sum() / most / (labels / size)
        out[int(t)] = RANK_SHARE * rho + (1 - RANK_SHARE) * min(1.0, max(0.0, lift / 3))
    return out


def ascend(data: Labelled, rounds: int = 3) -> np.ndarray:
    """Weights by coordinate ascent on the training part: of a metric's trials the best is taken, if it is better."""
    w = np.ones(len(data.metrics))
    if data.sizes.get("train", (0,))[0] < LEAST:
        return w
    best = objectives(data, "train", w[None])[0]
    for _ in range(rounds):
        before = best
        for j in range(len(w)):
            trials = np.repeat(w[None], len(FACTORS), 0)
            trials[:, j] = [f * (w[j] or 1.0) for f in FACTORS]
            got = objectives(data, "train", trials)
            k = int(np.argmax(got))
            if got[k] > best + 1e-9 and trials[k].sum() > 0:
                w, best = trials[k], got[k]
        if best == before:
            break
    return w


def fit_weights(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(metric_id, weight, train, holdout); under LEAST training tokens all weights stay 1."""
    data = labelled(values, labels)
    if not data.metrics:
        return values.sparkSession.createDataFrame([], "metric_id string, weight double, train double, holdout double")
    w = ascend(data)
    train, holdout = (float(objectives(data, part, w[None])[0]) for part in ("train", "holdout"))
    rows = [(m, float(v), train, holdout) for m, v in zip(data.metrics, w, strict=True)]
    discard(data.rows)
    return values.sparkSession.createDataFrame(rows, "metric_id string, weight double, train double, holdout double")


def ablate(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(metric_id, delta): what the holdout's objective loses without each metric, all in one pass."""
    data = labelled(values, labels)
    if not data.metrics:
        return values.sparkSession.createDataFrame([], "metric_id string, delta double")
    w = ascend(data)
    trials = np.concatenate((w[None], np.where(np.eye(len(w), dtype=bool), 0.0, w[None])))
    got = objectives(data, "holdout", trials)
    rows = [(m, float(got[0] - got[j + 1])) for j, m in enumerate(data.metrics)]
    discard(data.rows)
    return values.sparkSession.createDataFrame(rows, "metric_id string, delta double")
