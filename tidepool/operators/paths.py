"""Price paths from several sources, and the outcomes they label.

A point has token_key, as_of, id, price, high, liquidity, market_cap, stage (0 before launch, 1
on the curve, 2 near its end, 3 graduated, 4 dead, 5 rugged), progress, source and ``candle``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pit, sequence

POINT = ("token_key", "as_of", "id", "price", "high", "liquidity", "market_cap", "stage", "progress", "source", "candle")


@dataclass(frozen=True)
class Policy:
    """Thresholds of a label (fixed values)."""

    bucket: float = 30.0
    t0_lag: float = 900.0
    size: float = 0.25
    native_usd: float = 150.0
    virtual: float = 30.0
    on_curve: float = 85.0
    graduation: float = 0.999
    survival: float = 0.5
    residual: float = 500.0
    collapse: float = 0.25
    horizons: tuple[tuple[str, float], ...] = (("survived_1h", 3600.0), ("survived_24h", 86_400.0), ("survived_7d", 604_800.0))


def candle_points(payloads: DataFrame) -> DataFrame:
    """Points from payloads (token_key, id, candles: array of timestamp, close, high): one a timestamp, that with the greatest high."""
    rows = payloads.select("token_key", "id", F.posexplode("candles").alias("k", "c")).filter((F.col("c.close") > 0) & F.col("c.timestamp").isNotNull())
    best = pit.ranked_by(rows.withColumn("at", F.col("c.timestamp")), ["token_key", "at"], [F.coalesce("c.high", F.lit(0.0)).desc(), F.col("id").asc(), F.col("k").asc()])
    none = F.lit(None).cast("double")
    return best.select("token_key", F.col("at").alias("as_of"), "id", F.col("c.close").alias("price"), F.greatest("c.close", F.coalesce("c.high", F.lit(0.0))).alias("high"), none.alias("liquidity"), none.alias("market_cap"), F.lit(1).alias("stage"), none.alias("progress"), F.lit("candles").alias("source"), F.lit(True).alias("candle"))


def price_path(points: DataFrame, created: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(token_key, created_at, as_of, price, high, liquidity, market_cap, stage, progress, source): one point a moment.

    Points from before a token's creation (less a bucket) aren't its own. At one instant an observation comes
    before a candle. Points no further than a bucket apart are one moment: figures are medians, stage and
    progress the most advanced, time and source those of the point nearest the median price.
    """
    p = policy or Policy()
    own = points.filter("price > 0").join(created.select("token_key", "created_at"), "token_key").filter(F.col("as_of") >= F.col("created_at") - p.bucket)
    merged = pit.ranked_by(own, ["token_key", "as_of"], [F.col("candle").asc(), F.col("id").asc()])
    moments = sequence.sessionize(merged, ["token_key"], "as_of", [], p.bucket, "moment")
    middle = moments.groupBy("token_key", "moment").agg(F.median("price").alias("p"), F.median("high").alias("h"), F.median("liquidity").alias("l"), F.median("market_cap").alias("m"), F.max("stage").alias("s"), F.max("progress").alias("g")).withColumnsRenamed({"token_key": "t", "moment": "k"})
    both = moments.join(middle, (F.col("token_key") == F.col("t")) & (F.col("moment") == F.col("k")))
    nearest = F.min_by(F.struct("as_of", "source"), F.struct(F.abs(F.col("price") - F.col("p")), "as_of"))
    same = [F.first(c).alias(c) for c in ("created_at", "p", "h", "l", "m", "s", "g")]
    found = both.groupBy("token_key", "moment").agg(nearest.alias("r"), *same)
    return found.select("token_key", "created_at", F.col("r.as_of").alias("as_of"), F.col("p").alias("price"), F.greatest("p", "h").alias("high"), F.col("l").alias("liquidity"), F.col("m").alias("market_cap"), F.col("s").alias("stage"), F.col("g").alias("progress"), F.col("r.source").alias("source"))


def quote_reserve(p: Policy, stage: Column, progress: Column, liquidity: Column) -> Column:
    """Depth on the quote side: the curve's virtual reserve and what progress says it has taken in, or half the pool's liquidity."""
    half = F.coalesce(liquidity, F.lit(0.0)) / 2 / p.native_usd
    taken_in = F.when(progress.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(p.on_curve), progress * p.on_curve)))
    on_curve = p.virtual + F.coalesce(taken_in, F.greatest(F.lit(1.0), half))
    return F.when(stage.isin(1, 2), on_curve).otherwise(F.greatest(F.lit(1e-6), half))


def outcomes(path: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(token_key, multiple, realizable, to_peak, peak_cap, final_cap, graduated, graduated_at, horizons, rugged) of each path.

    A path that begins later than t0_lag after creation has no t0 price, so neither multiples nor survival.
    ``realizable`` is the best sale of the position along the path into a constant product at the
    point's high; survival compares the point nearest the horizon, on either side, if the path reaches it.
    """
    p = policy or Policy()
    at = F.col("as_of")
    lived = [F.min_by("price", F.struct(F.abs(at - F.col("created_at") - h), at)).alias(f"_{name}") for name, h in p.horizons]
    ends = F.when(F.col("liquidity").isNotNull(), at)
    found = path.groupBy("token_key").agg(
        F.first("created_at").alias("created_at"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by("price", at).alias("first_price"),
        F.max("high").alias("peak"), F.min_by(at, F.struct(-F.col("high"), at)).alias("peak_at"),
        F.max("market_cap").alias("peak_cap"), F.max_by("market_cap", F.when(F.col("market_cap").isNotNull(), at)).alias("final_cap"),
        F.min(F.when((F.col("stage") == 3) | (F.col("progress") >= p.graduation), at)).alias("graduated_at"),
        F.max("stage").alias("last_stage"), F.count("liquidity").alias("depths"), F.max("liquidity").alias("deepest"), F.max_by("liquidity", ends).alias("depth"), *lived,
    )
    known = found.withColumn("t0", F.when(F.col("first_at") - F.col("created_at") <= p.t0_lag, F.col("first_price")))
    tokens = p.size / F.col("t0")
    reserve = quote_reserve(p, F.col("stage"), F.col("progress"), F.col("liquidity"))
    sale = reserve * F.col("tokens") / (reserve / F.col("high") + F.col("tokens"))
    best = path.join(known.filter("t0 is not null").select(F.col("token_key").alias("t"), tokens.alias("tokens")), F.col("token_key") == F.col("t")).groupBy("token_key").agg((F.max(sale) / p.size).alias("realizable"))
    span = F.col("last_at") - F.col("created_at")
    survived = [F.coalesce((span >= h) & (F.col(f"_{name}") >= p.survival * F.col("t0")), F.lit(False)).alias(name) for name, h in p.horizons]
    withdrawn = (F.col("depths") >= 2) & (F.col("deepest") > p.residual) & (F.col("depth") <= p.residual) & (F.col("depth") <= p.collapse * F.col("deepest"))
    return known.join(best, "token_key", "left").select(
        "token_key", (F.col("peak") / F.col("t0")).alias("multiple"), "realizable", F.when(F.col("t0").isNotNull(), F.col("peak_at") - F.col("created_at")).alias("to_peak"), "peak_cap", "final_cap",
        F.col("graduated_at").isNotNull().alias("graduated"), "graduated_at", *survived, ((F.col("last_stage") >= 4) | F.coalesce(withdrawn, F.lit(False))).alias("rugged"),
    )
