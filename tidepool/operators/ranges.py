"""Order within keys when a key may hold a third of all rows: windows over ranges of hot keys, carried from range to range.

A window over a key is one task's work. Here a key with more than ROWS rows (or its share of
the shuffle, if that is more) is cut into ranges of the order column, at quantiles that Spark
sketches for those keys alone; a window then runs on (key, range), and what a range needs
from earlier ones comes from a table with a row for each range: sums for running totals,
the last row for as-of joins. There are at most as many hot keys as shuffle partitions
and about two ranges a partition, so that table is broadcast. Without hot keys the plan is the
plain window. Rows of a key with equal order values stay together; ties that may be
many are counted before (``ranked``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import park

ROWS = 1 << 17
RANGES = 256  # of one key at most


def hot_cuts(df: DataFrame, keys: list[str], by: str, weight: Column | None = None) -> DataFrame | None:
    """(keys, _cuts): for keys with too many rows for one task, ascending values of ``by`` at which they are cut; None without such keys."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_k"))
    totals = counts.agg(F.sum("_k"), F.max("_k")).first()
    share = max(ROWS, (totals[0] or 0) // parts)
    if (totals[1] or 0) <= share:
        return None
    # At most total / share keys, that is, at most as many as shuffle partitions.
    hot = counts.filter(F.col("_k") > share)
    named = hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_k")
    own = df.join(F.broadcast(named), _same(keys))
    n = F.ceil(F.max("_k") / share)
    sketch = own.groupBy(*keys).agg(F.percentile_approx(F.col(by).cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("_q"), n.alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES) / F.col("_n")).cast("int"))
    return sketch.select(*keys, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0)).alias("_cuts"))


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return on


def with_keys(df: DataFrame, keys: list[str], more: DataFrame) -> DataFrame:
    """Joins a table with a row for each key; null keys match."""
    named = more.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    return df.join(named, _same(keys)).drop(*[f"_h{i}" for i in range(len(keys))])


def range_of(value: Column, cuts: Column) -> Column:
    """Number of cuts that are no greater than a value, by bisection; 0 without cuts and for null."""
    steps = F.array(*[F.lit(1 << i) for i in range(8, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value), at + step).otherwise(at))
    return F.when(cuts.isNull() | value.isNull(), 0).otherwise(found)


def ranged(df: DataFrame, keys: list[str], by: str, cuts: DataFrame) -> DataFrame:
    """Adds ``_hot`` and ``_range`` (0 for keys that aren't hot)."""
    named = cuts.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_cuts")
    joined = df.join(F.broadcast(named), _same(keys), "left")
    return joined.select(*df.columns, F.col("_cuts").isNotNull().alias("_hot"), range_of(F.col(by).cast("double"), F.col("_cuts")).alias("_range"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], peers: bool = False) -> DataFrame:
    """Adds running sums within keys, up to and including the row (or, with ``peers``, its equals in order).

    The order is ascending, nulls first; its first column decides the ranges and must be a number.
    """

    def over(cols: list[str]):
        w = Window.partitionBy(*cols).orderBy(*order)
        return w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)

    cuts = hot_cuts(df, keys, order[0])
    if cuts is None:
        return df.withColumns({n: F.sum(c).over(over(keys)) for n, c in sums.items()})
    rows = ranged(df.withColumns({f"_s_{n}": c for n, c in sums.items()}), keys, order[0], cuts)
    totals = rows.filter("_hot").groupBy(*keys, "_range").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
    joined = rows.join(F.broadcast(before), _same(keys) & (F.col("_range") == F.col("_r")), "left")
    # A sum over no row but nulls is null, in the range and before it alike.
    both = lambda n: F.when(F.col(f"_b_{n}").isNull(), F.sum(f"_s_{n}").over(over([*keys, "_range"]))).otherwise(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_s_{n}").over(over([*keys, "_range"])), F.lit(0)))
    return joined.select(*df.columns, *[both(n).alias(n) for n in sums])


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds the row's number within its key, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def distinct_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, same, upto): each distinct value that isn't null, its rows, and the rows with no greater one.

    Values are counted before they are ordered, so a value that many rows share is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("same"))
    return running(counts, keys, [value], {"upto": F.col("same")})


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``same`` (rows with an equal value), ``upto`` (with no greater one) and ``n`` (with any); null and 0 where the value is null."""
    found = distinct_values(df, keys, value)
    sizes = found.groupBy(*keys).agg(F.sum("same").alias("_size"))
    names = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
    joined = df.join(found.select(*names, F.col(value).alias("_value"), "same", "upto"), _same(keys) & (F.col(value) == F.col("_value")), "left")
    joined = joined.drop("_value", *[f"_h{i}" for i in range(len(keys))])
    out = joined.join(sizes.select(*names, "_size"), _same(keys), "left")
    return out.select(*df.columns, "same", "upto", F.coalesce("_size", F.lit(0)).alias("n"))


def value_at(df: DataFrame, keys: list[str], value: str, picks: dict[str, float]) -> DataFrame:
    """(keys, n, picks): the value at index round-half-even(f * (n - 1)) of each key."""
    found = distinct_values(df, keys, value)
    sizes = found.groupBy(*keys).agg(F.sum("same").alias("n"))
    names = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
    joined = found.join(sizes.select(*names, "n"), _same(keys)).drop(*[f"_h{i}" for i in range(len(keys))])
    index = lambda f: F.bround((F.col("n") - 1) * f, 0)
    held = lambda f: (index(f) >= F.col("upto") - F.col("same")) & (index(f) < F.col("upto"))
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(held(f), F.col(value))).alias(name) for name, f in picks.items()])


def last_seen(df: DataFrame, keys: list[str], order: list[str], found: dict[str, tuple[str, bool]]) -> DataFrame:
    """Adds columns: (what, later) gives the nearest ``what`` that isn't null, at or before the row in order, or, if ``later``, at or after it."""

    def over(cols: list[str], by: list[str], later: bool):
        return Window.partitionBy(*cols).orderBy(*[F.desc(c) if later else F.asc(c) for c in by])

    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    cuts = hot_cuts(df, keys, order[0])
    if cuts is None:
        return df.withColumns({n: F.last(what, True).over(upto(over(keys, order, later))) for n, (what, later) in found.items()})
    rows = ranged(df, keys, order[0], cuts)
    nearest = {n: (F.min_by if later else F.max_by)(what, F.when(F.col(what).isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n, (what, later) in found.items()}
    edges = rows.filter("_hot").groupBy(*keys, "_range").agg(*nearest.values())
    carried = {n: F.last(f"_e_{n}", True).over(over(keys, ["_range"], later).rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}") for n, (_, later) in found.items()}
    before = edges.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *carried.values())
    joined = rows.join(F.broadcast(before), _same(keys) & (F.col("_range") == F.col("_r")), "left")
    own = [F.coalesce(F.last(what, True).over(upto(over([*keys, "_range"], order, later))), f"_c_{n}").alias(n) for n, (what, later) in found.items()]
    return joined.select(*df.columns, *own)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the row's number in an order over the whole table, from 1: rows are sorted into ranges, and ranges are counted.

    The order must tell all rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = park(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = rows.groupBy("_part").agg(F.count("*").alias("_k")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(counts), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_before") + own).alias(name))


def folded(df: DataFrame, keys: list[str], order: list[str], scale: Column, shift: Column, start: Column, lowest: float = float("-inf"), highest: float = float("inf"), name: str = "folded") -> DataFrame:
    """(keys, name): x -> clamp(scale x + shift) over a key's rows in order, from ``start`` (an aggregate of the key); scales aren't negative.

    Such maps compose to maps of the same kind: first within ranges of at most ROWS rows, or a
    share of the shuffle, then over the ranges of a key.
    """
    cuts = hot_cuts(df, keys, order[0])
    rows = df.withColumns({"_a": scale.cast("double"), "_b": shift.cast("double")})
    rows = rows.withColumn("_range", F.lit(0)) if cuts is None else ranged(rows, keys, order[0], cuts)
    clamp = lambda v: F.greatest(F.lit(lowest), F.least(F.lit(highest), v))
    whole = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def step(m: Column, x: Column) -> Column:
        # An end that is infinite stays so under any scale but 0.
        end = lambda v: clamp(F.when(x["_a"] == 0, x["_b"]).otherwise(x["_a"] * v + x["_b"]))
        return F.struct((x["_a"] * m["a"]).alias("a"), (x["_a"] * m["b"] + x["_b"]).alias("b"), end(m["lo"]).alias("lo"), end(m["hi"]).alias("hi"))

    def then(m: Column, x: Column) -> Column:
        held = lambda v: F.greatest(x["lo"], F.least(x["hi"], F.when(x["a"] == 0, x["b"]).otherwise(x["a"] * v + x["b"])))
        return F.struct((x["a"] * m["a"]).alias("a"), (x["a"] * m["b"] + x["b"]).alias("b"), held(m["lo"]).alias("lo"), held(m["hi"]).alias("hi"))

    parts = rows.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(F.struct(*order, "_a", "_b"))).alias("_rows"))
    parts = parts.select(*keys, "_range", F.aggregate("_rows", whole, step).alias("_map"))
    maps = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "_map"))).alias("_maps")).select(*keys, F.aggregate(F.transform("_maps", lambda x: x["_map"]), whole, then).alias("_m"))
    begun = with_keys(maps, keys, df.groupBy(*keys).agg(start.cast("double").alias("_start")))
    return begun.select(*keys, F.greatest(F.col("_m.lo"), F.least(F.col("_m.hi"), F.col("_m.a") * F.col("_start") + F.col("_m.b"))).alias(name))
