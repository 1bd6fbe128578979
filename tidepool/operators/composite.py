"""The two-level score: confidence-weighted metrics within families, families by budget; and the readings as they stood at instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CONFIDENCE = {"verified": 1.0, "high": 1.0, "medium": 0.7, "low": 0.35, "stale": 0.15}


def usable(normalized: str = "normalized", confidence: str = "confidence") -> Column:
    """A reading counts if it has a value and is neither missing nor stale."""
    return F.col(normalized).isNotNull() & F.coalesce(~F.col(confidence).isin("missing", "stale"), F.lit(False))


def picked(column: str, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def composite(rows: DataFrame, keys: list[str], weights: dict[str, float], budgets: dict[str, float], rest: float) -> DataFrame:
    """(keys, composite, coverage, n): a family's readings share its budget by weight and confidence.

    Rows have metric_id, family, normalized and confidence. Sums by family are all that is needed, so there is no window;
    a family without usable weight leaves its budget to the others. No usable reading gives a null composite.
    """
    weight = F.when(usable(), picked("metric_id", weights, 1.0) * picked("confidence", CONFIDENCE, 0.0))
    families = rows.withColumn("_w", weight).groupBy(*keys, "family").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("normalized")).alias("x"), F.count_if(usable()).alias("k"), F.count("*").alias("n"))
    share = F.when(F.col("w") > 0, picked("family", budgets, rest))
    found = families.groupBy(*keys).agg(F.sum(share * F.col("x") / F.col("w")).alias("s"), F.sum(share).alias("b"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return found.select(*keys, (F.col("s") / F.col("b")).alias("composite"), (F.col("k") / F.col("n")).alias("coverage"), "n")


def at_instants(rows: DataFrame, keys: list[str], instants: list[int], at: str, tie: str, values: list[str], name: str = "t") -> DataFrame:
    """(keys, name, values): for each instant the last row of a key at or before it; keys without one yet are left out.

    A row counts for the first instant that isn't before it; each key keeps one row an
    instant at most, and instants look back over those, so rows aren't copied to every later instant.
    """
    ticks = F.array(*[F.lit(t).cast("long") for t in sorted(instants)])
    due = F.array_min(F.filter(ticks, lambda t: t >= F.col(at)))
    last = F.max(F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), *values)).alias("_row")
    kept = rows.withColumn("_due", due).filter("_due IS NOT NULL").groupBy(*keys, "_due").agg(last)
    every = kept.groupBy(*keys).agg(F.collect_list(F.struct("_due", "_row")).alias("_seen"))  # a row an instant at most
    stood = F.transform(ticks, lambda t: F.struct(t.alias(name), F.array_max(F.filter("_seen", lambda x: x["_due"] <= t))["_row"].alias("_row")))
    out = every.select(*keys, F.inline(F.filter(stood, lambda x: x["_row"].isNotNull())))
    return out.select(*keys, name, *[f"_row.{v}" for v in values])
