"""Sequence operators: gaps, sessions, ranks, nearest-rank percentiles, streaks, drawdown."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.shared import park
from . import ranges


def gaps(df: DataFrame, keys: list[str], at: str, tie: list[str], name: str = "gap") -> DataFrame:
    """Time since the row before, within keys (null for the first)."""
    w = Window.partitionBy(*keys).orderBy(at, *tie)
    return df.withColumn(name, F.col(at) - F.lag(at).over(w))


def sessionize(df: DataFrame, keys: list[str], at: str, tie: list[str], tolerance: float, name: str = "session") -> DataFrame:
    """Numbers sessions within keys: one begins where the gap is over the tolerance."""
    w = Window.partitionBy(*keys).orderBy(at, *tie)
    new = F.when(F.col(at) - F.lag(at).over(w) > tolerance, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles as the value at index round-half-even(f * (n - 1)), per key."""
    return ranges.value_at(df, keys, value, fractions)


def cumulative_share(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the share of a key's rows whose value is no greater; null where the value is null."""
    return ranges.ranked(df, keys, value).withColumn(name, F.col("upto") / F.col("n")).drop("same", "upto", "n")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds ranks with ties sharing their mean; null where the value is null."""
    return ranges.ranked(df, keys, value).withColumn(name, F.col("upto") - (F.col("same") - 1) / 2).drop("same", "upto", "n")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Rank correlation of the rows that have both values."""
    whole = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_rank(average_rank(whole, keys, a, "_a"), keys, b, "_b")
    return ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias(name))


def top_share_lift(df: DataFrame, keys: list[str], by: str, tie: str, value: str, share: int = 10, least: int = 20, name: str = "lift") -> DataFrame:
    """Mean value of the first 1/share of a key's rows in falling order of ``by`` (then ``tie``), over its mean of all; null under ``least`` rows."""
    rows = df.withColumn("_down", -F.col(by))
    rows = ranges.placed(rows, keys, ["_down", tie], "_i")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = ranges.with_keys(rows, keys, sizes)
    lift = F.avg(F.when(F.col("_i") <= F.floor(F.col("_n") / share), F.col(value))) / F.avg(value)
    return rows.groupBy(*keys).agg(F.when(F.max("_n") >= least, lift).alias(name))


def gini(df: DataFrame, keys: list[str], value: str, name: str = "gini") -> DataFrame:
    from ..functions.stats import gini_from

    kept = df.filter(F.col(value) >= 0).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    sums = kept.groupBy(*keys).agg(F.sum(F.col("_i") * F.col(value)).alias("_ix"), F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return sums.select(*keys, gini_from("_ix", "_s", "_n").alias(name))


def max_drawdown(df: DataFrame, keys: list[str], order: list[str], pnl: str) -> DataFrame:
    """Least of equity minus its running peak, both from 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_e", F.sum(pnl).over(w)).withColumn("_p", F.greatest(F.lit(0.0), F.max("_e").over(w)))
    return run.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(F.col("_e") - F.col("_p"))).alias("max_drawdown"))


def leading_streak(df: DataFrame, keys: list[str], order: list[Column], hit: Column, name: str = "streak") -> DataFrame:
    """Rows before the first hit, in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("_seen", F.max(hit.cast("int")).over(w))
    return seen.groupBy(*keys).agg(F.count_if(F.col("_seen") == 0).alias(name))


TASK = 1 << 17  # rows that a task holds at a time where places or values are compared


def earlier_share(rows: DataFrame, keys: list[str], order: list[str], id_: str, value: str) -> DataFrame:
    """(id, earlier, lower): the key's rows before in order, and those of them whose value is no greater."""
    return earlier_counts(rows.select(*keys, *[c for c in dict.fromkeys([*order, id_, value]) if c not in keys]), keys, order, value).select(id_, "earlier", "lower")


def earlier_rank(rows: DataFrame, at: str, id_: str, value: str, task: int = TASK) -> DataFrame:
    """Adds ``earlier``: rows before in (at, id_) order, and ``lower``: those of them whose value is no greater."""
    return earlier_counts(rows, [], [at, id_], value, task)


def earlier_counts(rows: DataFrame, keys: list[str], order: list[str], value: str, task: int = TASK) -> DataFrame:
    """Adds ``earlier``: the key's rows before in order, and ``lower``: those of them whose value is no greater; a null value is no one's, and counts none.

    The whole table is sorted by (keys, order) into blocks, and its values, once for each block that holds them, by (keys,
    value) into bands; a task holds one of either. A row counts those of its own block there. Of earlier blocks it counts
    those of its own band in the band, and those of lower bands in a table with a row for each block and band.
    So a row is shuffled four times, however many there are, and ties of either kind may be many.
    """
    spark = rows.sparkSession
    rows = park(rows)
    n = rows.count()
    task = max(task, n >> 10)  # the table of blocks and bands has at most about a million rows
    parts = lambda k: max(1, -(-k // task), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-k // 8192)))
    sort = [F.col(c).asc_nulls_first() for c in keys]
    blocks = rows.repartitionByRange(parts(n), *sort, *[F.col(c) for c in order]).withColumn("_b", F.spark_partition_id()).sortWithinPartitions(*sort, *order)
    more = StructType([StructField("_i", LongType()), StructField("_c", LongType()), StructField("_w", LongType()), StructField("_own", LongType())])
    blocks = park(blocks.mapInArrow(_in_block(keys, value), StructType([*rows.schema.fields, StructField("_b", IntegerType()), *more.fields])))
    held = blocks.filter("_w > 0").select(*keys, value, "_b", "_c", "_w")
    bands = held.repartitionByRange(parts(held.count()), *sort, value).withColumn("_s", F.spark_partition_id()).sortWithinPartitions(*sort, value)
    bands = park(bands.mapInArrow(_in_band(keys, value), StructType([*held.schema.fields, StructField("_s", IntegerType()), StructField("_past", LongType())])))
    below = park(_below(bands, keys))
    named = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
    below = below.select(*named, F.col("_b").alias("_hb"), F.col("_s").alias("_hs"), "_below")
    past = bands.join(F.broadcast(below), ranges._same(keys) & (F.col("_b") == F.col("_hb")) & (F.col("_s") == F.col("_hs")), "left")
    past = past.select(F.col("_b").alias("_pb"), F.col("_c").alias("_pc"), (F.col("_past") + F.coalesce("_below", F.lit(0))).alias("_past"))
    sizes = blocks.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    started = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only keys that lie in several blocks have rows before a block.
    before = sizes.select(*named, F.col("_b").alias("_hb"), started.alias("_before")).filter("_before > 0")
    out = blocks.join(F.broadcast(before), ranges._same(keys) & (F.col("_b") == F.col("_hb")), "left").join(past, (F.col("_b") == F.col("_pb")) & (F.col("_c") == F.col("_pc")), "left")
    earlier = F.coalesce("_before", F.lit(0)) + F.col("_i")
    return out.select(*rows.columns, earlier.alias("earlier"), (F.col("_own") + F.coalesce("_past", F.lit(0))).alias("lower"))


def _below(bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _b, _s, _below): of a block and band, the weights of the key's earlier blocks in lower bands, where there are any."""
    cells = bands.groupBy(*keys, "_b", "_s").agg(F.sum("_w").alias("_w"))
    spans = cells.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("_b", "_s") for n, f in (("lo", F.min), ("hi", F.max))]).filter("_lo_b < _hi_b AND _lo_s < _hi_s")
    span = lambda c: F.explode(F.sequence(F.col(f"_lo{c}"), F.col(f"_hi{c}"))).alias(c)
    grid = spans.select("*", span("_b")).select(*keys, "_b", span("_s"))
    named = cells.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_b").alias("_hb"), F.col("_s").alias("_hs"), "_w")
    full = grid.join(named, ranges._same(keys) & (F.col("_b") == F.col("_hb")) & (F.col("_s") == F.col("_hs")), "left")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lower = full.withColumn("_lower", F.sum("_w").over(upto(Window.partitionBy(*keys, "_b").orderBy("_s"))))
    found = lower.withColumn("_below", F.sum("_lower").over(upto(Window.partitionBy(*keys, "_s").orderBy("_b"))))
    return found.select(*keys, "_b", "_s", "_below").filter("_below > 0")


def _changed(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the row before in one of the columns; nulls are alike, and so are NaNs."""
    out = np.zeros(table.num_rows, bool)
    for name in columns:
        own = table.column(name).combine_chunks()
        one, two = own.slice(1), own.slice(0, max(0, len(own) - 1))
        differs = np.asarray(pc.fill_null(pc.not_equal(one, two), False)) | (np.asarray(one.is_null()) != np.asarray(two.is_null()))
        if pa.types.is_floating(own.type):
            nan = lambda x: np.asarray(pc.fill_null(pc.is_nan(x), False))
            differs &= ~(nan(one) & nan(two))
        out[1:] |= differs
    return out


def _no_greater(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place the weights of smaller places whose code is no greater: two places meet at the highest bit in which they differ."""
    place, out, at = np.argsort(code, kind="stable"), np.zeros(len(code), np.int64), np.arange(len(code))
    for bit in reversed(range(max(1, len(code) - 1).bit_length())):
        # By the bits above this one, and in each such group by code.
        late, start = (place >> bit & 1).astype(bool), place >> (bit + 1) << (bit + 1)
        run = np.concatenate(([0], np.cumsum(np.where(late, 0, weight[place]))))
        out[place[late]] += (run[:-1] - run[start])[late]
        few = np.concatenate(([0], np.cumsum(~late)))
        early = few[:-1] - few[start]  # of the group, before this one
        to = np.where(late, start + (1 << bit) + (at - start - early), start + early)
        moved = np.empty_like(place)
        moved[to] = place
        place = moved
    return out


def _in_block(keys: list[str], value: str):
    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        n = table.num_rows
        own = table.column(value).combine_chunks()
        some = np.asarray(own.is_valid())
        key = np.cumsum(_changed(table, keys))
        first = np.searchsorted(key, key)
        kinds = np.unique(np.asarray(pc.fill_null(own, 0)), return_inverse=True)[1] + 1
        kinds[~some] = 0
        code = np.unique(key.astype(np.int64) * (n + 1) + kinds, return_inverse=True)[1].astype(np.int64)
        weight = some.astype(np.int64)
        counted = np.concatenate(([0], np.cumsum(weight)))
        within = np.where(some, _no_greater(code, weight) - counted[first], 0)
        # One row of each value of a key carries how many there are; nulls carry none.
        alone = np.zeros(n, np.int64)
        lead = np.unique(code, return_index=True)[1]
        alone[lead] = np.bincount(code)
        alone[~some] = 0
        for name, column in (("_i", np.arange(n) - first), ("_c", code), ("_w", alone), ("_own", within)):
            table = table.append_column(name, pa.array(column, pa.int64()))
        yield from table.to_batches(10_000)

    return run


def _in_band(keys: list[str], value: str):
    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        key, code = np.cumsum(_changed(table, keys)), np.cumsum(_changed(table, [*keys, value]))
        block, weight = (table.column(c).to_numpy().astype(np.int64) for c in ("_b", "_w"))
        # A block's greater values come first, so that none of its own is counted.
        turn = np.lexsort((-code, block, key))
        first = np.searchsorted(key[turn], key[turn])
        counted = np.concatenate(([0], np.cumsum(weight[turn])))
        found = np.empty(len(turn), np.int64)
        found[turn] = _no_greater(code[turn], weight[turn]) - counted[first]
        yield from table.append_column("_past", pa.array(found, pa.int64())).to_batches(10_000)

    return run
