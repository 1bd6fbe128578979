"""Simhash fingerprints and greedy leader groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.shared import discard, park
from .hamming import near_hashes


LOCAL = 4096  # distinct hashes of a group that one task goes through in order
BUNDLE = 1 << 16  # about the distinct hashes that a task takes at a time, of as many groups as they make
KEPT = 1 << 14  # fingerprints that a worker remembers

_known: dict[str, int] = {}


@F.udf(LongType(), useArrow=False)
def simhash(s: str | None) -> int:
    """64 majority votes over the hashes of a skeleton's character 4-grams; an empty one is 0. Skeletons pass in batches of a hundred rows; a worker remembers those of short ones."""
    if not s:
        return 0
    found = _known.get(s)
    if found is not None:
        return found
    grams = {s[i : i + 4] for i in range(max(1, len(s) - 3))}
    raw = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in sorted(grams)), np.uint8)
    votes = np.unpackbits(raw.reshape(-1, 8), axis=1).mean(0) > 0.5
    found = int(np.packbits(votes).view(">i8")[0])
    if len(s) <= 1000:
        if len(_known) >= KEPT:
            _known.clear()
        _known[s] = found
    return found


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt to all tasks: a small file is one split, and the work on its texts would be one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def fingerprints(rows: DataFrame, skeleton: str, *kept: str) -> DataFrame:
    """(kept, hash) of the skeletons that have a fingerprint."""
    once = F.udf(simhash.func, LongType(), useArrow=False).asNondeterministic()  # else the filter would compute it a second time
    return rows.select(*kept, once(skeleton).alias("hash")).filter("hash <> 0")


def leader_groups(df: DataFrame, group: str, id_: str, hash_: str, distance: int, *more: str) -> DataFrame:
    """(group, id, leader, more): in id order, a row joins the first leader within ``distance``, or leads.

    The same groups as one pass in order gives, found in rounds over a table of neighbours: rows
    with equal hashes go by the first of them; one that has no undecided or leading neighbour before it leads;
    one with a leader before it doesn't. At last each row takes its first leader. A round
    settles at least the first undecided row of every chain of neighbours. Groups of at most
    LOCAL distinct hashes are gone through in order; a task takes about BUNDLE hashes of them at a time.
    """
    rows = park(df.select(group, id_, F.col(hash_).alias("h"), *more))
    every = park(rows.groupBy(group, "h").agg(F.min(id_).alias("v")))
    large = park(every.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL).select(group))
    kind, id_kind = (df.schema[c].dataType.simpleString() for c in (group, id_))
    bundles = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // BUNDLE))
    own = every.join(large, group, "left_anti").withColumn("_b", F.pmod(F.xxhash64(group), F.lit(bundles)))
    led = own.groupBy("_b").applyInPandas(_in_order(group, distance), f"{group} {kind}, h long, leader {id_kind}")
    parked = [rows, every, large]
    if large.limit(1).count():
        slow, more_parked = _in_rounds(every.join(large, group, "left_semi"), group, distance)
        led, parked = led.unionByName(slow.join(every, [group, "v"]).select(group, "h", "leader")), parked + more_parked
    found = park(rows.join(led, [group, "h"]).select(group, id_, "leader", *more))
    discard(*parked)
    return found


def _in_order(group: str, distance: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_g=pd.factorize(frame[group])[0]).sort_values(["_g", "v"])
        own, codes, values = frame["v"].tolist(), frame["_g"].tolist(), frame["h"].to_numpy(np.int64).view(np.uint64)
        leaders, ids, out, n, last = np.zeros(len(own), np.uint64), [], [], 0, None
        for i, g, h in zip(own, codes, values, strict=True):
            if g != last:
                ids, n, last = [], 0, g
            near = np.flatnonzero(np.bitwise_count(leaders[:n] ^ h) <= distance)
            if not len(near):
                leaders[n], n = h, n + 1
                ids.append(i)
            out.append(ids[near[0]] if len(near) else i)
        return pd.DataFrame({group: frame[group].to_numpy(), "h": values.view(np.int64), "leader": out})

    return run


def _in_rounds(heads: DataFrame, group: str, distance: int) -> tuple[DataFrame, list[DataFrame]]:
    """(group, v, leader) for the first rows ``v`` of distinct hashes ``h``, and the tables parked for it."""
    heads = park(heads)
    near = near_hashes(heads, "h", distance, [group])
    named = lambda name: heads.select(F.col(group).alias(f"g_{name}"), F.col("h").alias(f"h_{name}"), F.col("v").alias(name))
    one, two = named("p"), named("q")
    near = near.join(one, F.col(group).eqNullSafe(F.col("g_p")) & (F.col("x") == F.col("h_p"))).join(two, F.col(group).eqNullSafe(F.col("g_q")) & (F.col("y") == F.col("h_q")))
    # An edge goes from the earlier to the later of two.
    edges = park(near.select(F.least("p", "q").alias("early"), F.greatest("p", "q").alias("late"), group))
    later = edges.select(group, F.col("late").alias("v")).distinct()
    leads = park(heads.select(group, "v").join(later, [group, "v"], "left_anti"))
    open_ = park(later)
    parked = [heads, edges, leads, open_]
    while open_.limit(1).count():
        led = edges.join(leads.withColumnRenamed("v", "early"), [group, "early"], "left_semi").select(group, F.col("late").alias("v")).distinct()
        left = park(open_.join(led, [group, "v"], "left_anti"))
        # Of those without a leader before them, the ones without an undecided one lead.
        waits = edges.join(left.withColumnRenamed("v", "early"), [group, "early"], "left_semi").select(group, F.col("late").alias("v")).distinct()
        new = park(left.join(waits, [group, "v"], "left_anti"))
        leads, open_ = park(leads.unionByName(new)), park(left.join(new, [group, "v"], "left_anti"))
        parked += [left, new, leads, open_]
    first = edges.join(leads.withColumnRenamed("v", "early"), [group, "early"], "left_semi").groupBy(group, F.col("late").alias("v")).agg(F.min("early").alias("leader"))
    own = leads.select(group, "v", F.col("v").alias("leader"))
    return first.join(own, [group, "v"], "left_anti").unionByName(own), parked


def template_share(rows: DataFrame, group: str, id_: str, skeleton: str, least: int = 3, distance: int = 8) -> DataFrame:
    """(group, share, n): share of a group's texts in a repeated template: equal skeletons, or leader groups of the rest, of ``least`` texts or more.

    Skeletons of fewer than six characters don't count; a group with fewer than ``least`` others has 0.
    """
    # Filtered after they are written: the filter would be pushed, skeletons and all, before rows are dealt to tasks.
    counts = park(rows.groupBy(group, skeleton).agg(F.count("*").alias("alike"), F.min(id_).alias(id_))).filter(F.length(skeleton) >= 6)
    exact = counts.groupBy(group).agg(F.sum("alike").alias("n"), F.sum(F.when(F.col("alike") >= least, F.col("alike")).otherwise(0)).alias("same"))
    # A skeleton stands for its texts: leaders go by the first text of a hash, and texts are counted by skeleton.
    rest = counts.filter(F.col("alike") < least)
    groups = leader_groups(fingerprints(rest, skeleton, group, id_, "alike"), group, id_, "hash", distance, "alike").groupBy(group, "leader").agg(F.sum("alike").alias("near")).filter(F.col("near") >= least)
    near = groups.groupBy(group).agg(F.sum("near").alias("near"))
    return exact.join(near, group, "left").select(group, F.when(F.col("n") < least, 0.0).otherwise((F.col("same") + F.coalesce("near", F.lit(0))) / F.col("n")).alias("share"), "n")
