"""Multi-index Hamming search over 64-bit fingerprints.

The bits are cut into m bands. Of two fingerprints within a distance d = m r + a, either one
of the first a + 1 bands differs in at most r bits or one of the others in at most r - 1.
So one side is spread to all values within that radius of each of its bands, and an equi-join on
(band, value) finds every pair. Wide bands make buckets small, narrow ones make probes
few; m is chosen for the number of fingerprints. A pair is reported by the first band that
finds it, so nothing has to be made distinct, and equal fingerprints count once.

At wide distances bands hardly prune: at 16, a fingerprint has thousands of probes and meets a tenth of the others.
There the fingerprints are dealt into blocks and each pair of blocks is one group, compared whole by
exclusive or and bit counts; a task holds two blocks and the pairs it has found.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14  # fingerprints of a block
ROW = 500  # fixed value: comparisons in a block that cost as much as a row of a join


def bands(distance: int, m: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of m bands; a band of no use has radius -1."""
    r, a = divmod(distance, m)
    edges = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo, r if i <= a else r - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]


def _probes(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def chosen(distance: int, n: int) -> list[tuple[int, int, int]]:
    """The bands with the least probes and expected candidates for n fingerprints."""

    def cost(m: int) -> float:
        return sum(_probes(w, r) * (1 + n / 2**w) for _, w, r in bands(distance, m))

    return bands(distance, min(range(1, min(distance + 1, 16) + 1), key=cost))


def masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _part(bits: str, lo: int, width: int) -> Column:
    moved = F.call_function("shiftleft", F.col(bits), F.lit(64 - lo - width))
    return F.shiftrightunsigned(moved, 64 - width)


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_hashes(df: DataFrame, bits: str, distance: int, keys: list[str] | None = None, cuts: list[tuple[int, int, int]] | None = None, forest: bool = False) -> DataFrame:
    """(keys, x, y, distance): pairs x < y of different fingerprints of a key within ``distance``; of a ``forest``, at least those that hold components together."""
    keys = keys or []
    own = df.filter(F.col(bits).isNotNull()).select(*keys, F.col(bits).alias("x")).distinct()
    if cuts is None:
        n = max(2, own.count())
        cuts = chosen(distance, n)
        if n / ROW < sum(_probes(w, r) * (1 + n / 2**w) for _, w, r in cuts if r >= 0):
            return in_blocks(own, distance, keys, n, forest=forest)
    used = [(i, *c) for i, c in enumerate(cuts) if c[2] >= 0]
    stored = F.array(*[F.struct(F.lit(i).alias("band"), _part("y", lo, w).alias("value")) for i, lo, w, _ in used])
    probed = F.array(*[F.struct(F.lit(i).alias("band"), _part("x", lo, w).alias("value"), F.array(*[F.lit(m) for m in masks(w, r)]).alias("masks")) for i, lo, w, r in used])
    right = own.withColumnRenamed("x", "y").withColumnsRenamed({k: f"_y{i}" for i, k in enumerate(keys)})
    right = right.select(*[f"_y{i}" for i in range(len(keys))], "y", F.inline(stored))
    left = own.select(*keys, "x", F.inline(probed)).select(*keys, "x", "band", "value", F.explode("masks").alias("mask"))
    left = left.select(*keys, "x", F.col("band").alias("b"), F.col("value").bitwiseXOR(F.col("mask").cast("long")).alias("v"))
    on = (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")) & (F.col("x") < F.col("y"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_y{i}"))
    found = left.join(right, on).withColumn("distance", apart("x", "y")).filter(F.col("distance") <= distance)
    # The first band within its radius reports the pair.
    diff = lambda lo, w: F.bit_count(_part("_xor", lo, w))
    earliest = F.coalesce(*[F.when(diff(lo, w) <= r, i) for i, lo, w, r in used])
    found = found.withColumn("_xor", F.col("x").bitwiseXOR(F.col("y"))).filter(F.col("band") == earliest)
    return found.select(*keys, "x", "y", "distance")


def _joined(parent: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Joins a node to others in place, and says which of them were in parts of their own (the first of each part)."""
    every = np.append(others, one)
    roots = parent[every]
    while (parent[roots] != roots).any():
        roots = parent[roots]
    parent[every] = roots
    parts, first = np.unique(roots[:-1], return_index=True)
    parent[parts] = roots[-1]
    return first[parts != roots[-1]]


def in_blocks(own: DataFrame, distance: int, keys: list[str], n: int, size: int = BLOCK, forest: bool = False) -> DataFrame:
    """(keys, x, y, distance) by comparing all pairs of distinct fingerprints ``x`` of a key, a pair of blocks in a group.

    Of a ``forest``, a group gives only pairs between parts that earlier ones haven't joined: fewer than it has fingerprints, however many are near.
    """
    k = -(-n // size)  # a key's blocks: as many as the whole table has, so none is larger
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = "".join(f"{name} {own.schema[key].dataType.simpleString()}, " for name, key in zip(names, keys, strict=True))
    dealt = own.select(*[F.col(c).alias(name) for c, name in zip(keys, names, strict=True)], "x", F.pmod(F.xxhash64("x"), F.lit(k)).cast("int").alias("_b"))
    # A block meets itself once and every other one: (least, greatest) names the pair.
    placed = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_o")).select(*names, "x", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["_b"].to_numpy() == frame["_i"].iloc[0]
        every = frame["x"].to_numpy(np.int64)
        one = np.sort(every[first])
        alike = frame["_i"].iloc[0] == frame["_j"].iloc[0]
        two = one if alike else every[~first]
        xs, ys, ds = [], [], []
        start = 0 if alike else len(one)  # of ``two`` among the nodes
        parent = np.arange(start + len(two))
        for at, a in enumerate(one):
            after = at + 1 if alike else 0
            others = two[after:]
            apart_ = np.bitwise_count(others.view(np.uint64) ^ np.int64(a).view(np.uint64))
            near = np.flatnonzero(apart_ <= distance)
            if forest and len(near):
                near = near[_joined(parent, at, start + after + near)]
            if len(near):
                xs.append(np.minimum(a, others[near])), ys.append(np.maximum(a, others[near])), ds.append(apart_[near])
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        out = pd.DataFrame({"x": flat(xs, np.int64), "y": flat(ys, np.int64), "distance": flat(ds, np.int32)})
        for name in reversed(names):
            out.insert(0, name, [frame[name].iloc[0]] * len(out))
        return out

    found = placed.groupBy(*names, "_i", "_j").applyInPandas(run, f"{kinds}x long, y long, distance int")
    return found.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def candidates(n: int, cuts: list[tuple[int, int, int]]) -> float:
    """Expected candidate pairs a fingerprint meets among n random ones."""
    return sum(_probes(w, r) * n / 2**w for _, w, r in cuts)
