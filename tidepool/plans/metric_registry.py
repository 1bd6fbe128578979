"""The registry of metrics: what each measures, how its raw value becomes a reading, and plugins.

A metric is a function of the tables that gives (token_key, raw, evidence); the registry adds
direction, logistic parameters, the earliest age and the least evidence. ``evaluate`` runs each
of them in a job of its own, then reads all alike: a reading is the percentile among the metric's peers where there are
PEERS of them, else a logistic of the raw value; bearish metrics are turned round; and
confidence falls with thin evidence, youth and degraded sources.
"""

from __future__ import annotations

from collections import UserDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import ranges
from ..sources.shared import park_each
from . import metrics, signals
from .registry import OVER, Kept, Tables, key

PEERS = 30
DIRECTIONS = ("bullish", "bearish", "non_monotonic")


@dataclass(frozen=True)
class Metric:
    id: str
    family: str
    direction: str
    gameability: str
    compute: Callable[[Tables], DataFrame]
    midpoint: float = 0.5
    steepness: float = 6.0
    earliest: float = 0.0
    least: int = 1
    sources: tuple[str, ...] = ()


#: What a metric must have before it may enter.
_SOUND = (
    ("an id of its own", lambda m: m.id not in ("", "unset")),
    ("a note on how it can be gamed", lambda m: bool(m.gameability)),
    (f"a direction out of {DIRECTIONS}", lambda m: m.direction in DIRECTIONS),
)


class MetricRegistry(UserDict):
    """A mapping from ids to metrics, in the order in which they came; unsound metrics and second ones of an id are refused."""

    def __init__(self, *metrics: Metric):
        super().__init__()
        self.add(*metrics)

    def __setitem__(self, id: str, metric: Metric) -> None:
        lacks = [need for need, holds in _SOUND if not holds(metric)]
        if id in self.data:
            lacks.append("an id that isn't taken")
        if lacks:
            raise ValueError(f"metric {id!r} needs " + ", ".join(lacks))
        super().__setitem__(id, metric)

    def add(self, *metrics: Metric) -> None:
        for m in metrics:
            self[m.id] = m

    def custom(self, id: str, family: str = "custom", direction: str = "bullish", gameability: str = "A signal of the user's own.", **more):
        """Enters a function of the tables as a metric."""

        def enter(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.add(Metric(id, family, direction, gameability, fn, **more))
            return fn

        return enter

    def where(self, kept: Callable[[Metric], bool]) -> MetricRegistry:
        """A registry of the metrics for which ``kept`` holds."""
        return MetricRegistry(*filter(kept, self.values()))

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(m.id, m.family, m.direction, float(m.midpoint), float(m.steepness), float(m.earliest), m.least) for m in self.values()]
        return spark.createDataFrame(rows, "metric_id string, family string, direction string, midpoint double, steepness double, earliest double, least long")

    def evaluate(self, t: Tables, ages: DataFrame, degraded: tuple[str, ...] = ()) -> DataFrame:
        """(token_key, metric_id, family, raw, evidence, normalized, confidence); ages: (token_key, age)."""
        def rows_of(m: Metric) -> DataFrame:
            own = m.compute(t).select("token_key", F.col("raw").cast("double").alias("raw"), F.col("evidence").cast("long").alias("evidence"))
            extra = {"metric_id": m.id, "family": m.family, "bearish": m.direction == "bearish", "mid": float(m.midpoint), "k": float(m.steepness), "earliest": float(m.earliest), "least": m.least, "dark": any(s in degraded for s in m.sources)}
            return own.withColumns({n: F.lit(v) for n, v in extra.items()})

        rows = park_each(ages.sparkSession, [partial(rows_of, m) for m in self.values()]).withColumn("raw", F.when(~F.isnan("raw") & (F.abs("raw") != float("inf")), F.col("raw")))
        # A metric has one for each token, so its percentiles come from counted values in ranges, not from one task's window.
        rows = ranges.ranked(rows, ["metric_id"], "raw").withColumnRenamed("n", "peers").withColumn("rank", F.col("upto") / F.col("peers"))
        rows = rows.join(ages.select("token_key", "age"), "token_key", "left")
        value = F.when(F.col("peers") >= PEERS, F.col("rank")).otherwise(S.logistic("raw", "mid", "k"))
        trust = confidence(F.col("raw"), F.col("evidence"), F.col("age"), F.col("earliest"), F.col("least"), F.col("dark"))
        rows = rows.withColumn("confidence", trust)
        reading = F.when(F.col("raw").isNotNull() & (F.col("confidence") != "missing"), S.clamp(F.when(F.col("bearish"), 1 - value).otherwise(value)))
        return rows.select("token_key", "metric_id", "family", "raw", "evidence", reading.alias("normalized"), "confidence")


def confidence(raw: Column, evidence: Column, age: Column, earliest: Column, least: Column, dark: Column) -> Column:
    """missing, low, medium or high."""
    return F.when(raw.isNull() | (evidence <= 0), "missing").when((age < earliest) | dark | (evidence < least), "low").when(evidence < least * 3, "medium").otherwise("high")


# Family, direction, midpoint, steepness, earliest age in seconds and least evidence of each metric.
_TABLE = (
    ("reply_template_ratio", "social_authenticity", "bearish", 0.25, 9.0, 90, 12), ("engagement_depth_ratio", "social_authenticity", "bullish", 0.12, 14.0, 180, 8), ("engager_age_dispersion", "social_authenticity", "bullish", 0.55, 8.0, 180, 10),
    ("reply_rhythm_naturalness", "social_authenticity", "bullish", 0.35, 7.0, 240, 10), ("follower_engagement_coherence", "social_authenticity", "bullish", 0.5, 6.0, 180, 6), ("conviction_language_share", "social_authenticity", "bullish", 0.12, 16.0, 300, 10),
    ("mention_author_diversity", "social_authenticity", "bullish", 12.0, 0.16, 300, 12), ("social_velocity_acceleration", "social_authenticity", "bullish", 0.0, 2.5, 420, 12), ("purchased_follower_signal", "social_authenticity", "bearish", 0.15, 14.0, 120, 1),
    ("identity_discontinuity", "social_authenticity", "bearish", 0.35, 8.0, 120, 3), ("organic_media_production_rate", "community_production", "bullish", 4.0, 0.4, 600, 3), ("derivative_remix_depth", "community_production", "bullish", 0.35, 7.0, 900, 6),
    ("cross_platform_propagation_lag", "community_production", "bullish", 0.0, 1.4, 900, 2), ("unpaid_promoter_share", "community_production", "bullish", 0.55, 7.0, 600, 8), ("community_content_originality", "community_production", "bullish", 0.62, 8.0, 600, 10),
    ("funder_graph_dispersion", "onchain_topology", "bullish", 14.0, 0.14, 180, 8), ("fresh_wallet_ratio", "onchain_topology", "bearish", 0.45, 9.0, 120, 10), ("sniper_supply_share", "onchain_topology", "bearish", 0.18, 14.0, 60, 5),
    ("bundle_supply_share", "onchain_topology", "bearish", 0.15, 16.0, 60, 6), ("smart_wallet_participation", "onchain_topology", "bullish", 0.06, 24.0, 120, 6), ("early_holder_retention", "onchain_topology", "bullish", 0.55, 8.0, 420, 6),
    ("holder_distribution_health", "onchain_topology", "bullish", 0.5, 6.0, 180, 8), ("narrative_novelty", "narrative", "bullish", 0.72, 9.0, 0, 20), ("meta_alignment", "narrative", "bullish", 0.2, 9.0, 0, 3), ("ticker_contention", "narrative", "bearish", 2.0, 0.7, 0, 1),
    ("launch_timing_quality", "narrative", "bullish", 0.35, 7.0, 0, 5), ("description_substance", "narrative", "bullish", 0.4, 8.0, 0, 1), ("deployer_lineage", "team_credibility", "bullish", 0.0, 2.0, 0, 1), ("deployer_behaviour_now", "team_credibility", "bullish", 0.0, 3.0, 60, 1),
    ("insider_supply_overhang", "team_credibility", "bearish", 0.12, 18.0, 120, 5), ("realizable_exit_depth", "execution_quality", "bullish", 3.0, 0.5, 30, 1), ("entry_contention", "execution_quality", "non_monotonic", 0.5, 6.0, 60, 8),
    ("buy_pressure_quality", "execution_quality", "bullish", 0.3, 7.0, 120, 10), ("price_stability_under_flow", "execution_quality", "bullish", 0.0, 1.2, 300, 4),
)
#: How each family can be gamed; a metric of one's own says so itself.
_GAMED = {
    "social_authenticity": "Accounts and engagement can be bought in matched proportion, at a cost; templates and ages give rented ones away.", "community_production": "Makers can be hired; few hands and reused material show.", "onchain_topology": "Wallets and funders can be multiplied; funding graphs and sizes tie them.",
    "narrative": "Names and texts are free to choose; copies and stuffing lower novelty.", "team_credibility": "A new deployer has no record; its funder's wallets count as it.", "execution_quality": "Volume can be traded with oneself; round trips and sizes are taken out.",
}


def _registered(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: OVER[name](t)


assert signals.T == metrics.T
REGISTRY = MetricRegistry(*(Metric(n, family, way, _GAMED[family], _registered(n), mid, k, early, least) for n, family, way, mid, k, early, least in _TABLE))


@key("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', '{d}', {m}e0, {k}e0, {e}.0e0, CAST({c} AS BIGINT))" for n, f, d, m, k, e, c in _TABLE) + ") v(metric_id, family, direction, midpoint, steepness, earliest, least)")
def metric_catalogue(t):
    return REGISTRY.catalogue(t.spark)


def _readings(t):
    kept = Kept(t)
    ages = kept("v_launches").select("token_key", (F.lit(metrics.T) - F.col("created_at")).alias("age"))
    readings = REGISTRY.evaluate(kept, ages)
    kept.discard("v_launches")
    return readings


@key()
def metric_normalize(t):
    """Readings of all metrics for all tokens."""
    return _readings(t).filter("normalized IS NOT NULL").select("metric_id", "token_key", F.round("normalized", 6).alias("normalized"))


@key()
def metric_confidence(t):
    return _readings(t).select("metric_id", "token_key", "confidence")
