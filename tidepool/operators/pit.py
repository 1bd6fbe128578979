"""Point-in-time reads: what was known at an instant, latest versions and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def pit_filter(df: DataFrame, t, lookback=None, as_of: str = "as_of", observed_at: str = "observed_at") -> DataFrame:
    """Rows that had happened and were known at t; no older than ``lookback``, if given."""
    t = t if isinstance(t, Column) else F.lit(t)
    out = df.filter((F.col(as_of) <= t) & (F.col(observed_at) <= t))
    return out if lookback is None else out.filter(F.col(as_of) >= t - lookback)


def ranked_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order (Spark prunes to k before and after the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def latest_by(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest version columns."""
    return ranked_by(df, keys, [F.col(c).desc_nulls_last() for c in version])


def latest_slice(df: DataFrame, keys: list[str], at: str = "as_of") -> DataFrame:
    """All rows of each key's latest instant."""
    return df.withColumn("_last", F.max(at).over(Window.partitionBy(*keys))).filter(F.col(at) == F.col("_last")).drop("_last")


def _as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: list[str], ways: dict[str, bool]) -> DataFrame:
    """The left rows with a struct of the nearest right row for each way (True: strictly after, False: at or before).

    Both sides go through one shuffle on the keys, and on ranges of time for keys with a large
    share of the rows (see ``ranges``). A row without a time is near none, on either side.
    """
    right = right.filter(F.col(at).isNotNull())
    payload = [c for c in right.columns if c not in keys and c != at]
    found = F.struct(*[F.col(c).alias(f"_r_{c}") for c in (at, *payload)])
    r = right.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], found.alias("_found"))
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(tie)], F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = r.unionByName(l, allowMissingColumns=True)
    # At equal times right rows come first, so those at the left row's time are before it and never after it.
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    rows = ranges.last_seen(both, keys, order, {n: ("_found", later) for n, later in ways.items()}).filter("_side = 1")
    return rows.withColumns({n: F.when(F.col("_t").isNotNull(), F.col(n)) for n in ways})


def _one_way(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: list[str] | None, later: bool) -> DataFrame:
    rows = _as_of(left, right, keys, at, tie or [], {"_match": later})
    return rows.select("_l.*", *[F.col(f"_match._r_{c}").alias(f"right_{c}") for c in (at, *[c for c in right.columns if c not in keys and c != at])])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str = "as_of", tie: list[str] | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (right_* columns; null if none)."""
    return _one_way(left, right, keys, at, tie, False)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str = "as_of", tie: list[str] | None = None) -> DataFrame:
    """Each left row with the first right row strictly after it."""
    return _one_way(left, right, keys, at, tie, True)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str = "as_of", tie: list[str] | None = None) -> DataFrame:
    """Each left row with the nearest right row on either side, found in one pass; the earlier one on ties."""
    rows = _as_of(left, right, keys, at, tie or [], {"_back": False, "_ahead": True})
    nearer = F.col("_ahead").isNotNull() & (F.col("_back").isNull() | (F.col(f"_ahead._r_{at}") - F.col(f"_l.{at}") < F.col(f"_l.{at}") - F.col(f"_back._r_{at}")))
    rows = rows.withColumn("_match", F.when(nearer, F.col("_ahead")).otherwise(F.col("_back")))
    return rows.select("_l.*", *[F.col(f"_match._r_{c}").alias(f"right_{c}") for c in right.columns if c not in keys])


def band_join(left: DataFrame, right: DataFrame, key: str, width: int, at: str = "as_of", right_at: str = "as_of") -> DataFrame:
    """Pairs with right.at <= left.at <= right.at + width. A time bucket is part of the equi-key, so a hot key spreads."""
    bucket = F.floor(F.col(at) / width)
    l = left.withColumn("_b", bucket)
    r = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    r = r.withColumn("_rb", F.explode(F.array(F.floor(F.col(f"right_{right_at}") / width), F.floor(F.col(f"right_{right_at}") / width) + 1)))
    on = (F.col(key) == F.col(f"right_{key}")) & (F.col("_b") == F.col("_rb")) & F.col(at).between(F.col(f"right_{right_at}"), F.col(f"right_{right_at}") + width)
    return l.join(r, on).drop("_b", "_rb")
