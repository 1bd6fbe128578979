"""Scores as they stood on a grid of instants, and what is told of them (survey section M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.composite import at_instants, composite, usable
from . import decisions  # noqa: F401  (its vetoes are read here)
from .registry import ORACLES, QUERIES, key

TICKS = (500_000, 1_000_000, 1_500_000, 2_000_000)
# Fixed values.
WEIGHTS, BUDGETS, REST = {"purchase": 1.5, "view": 0.05}, {"topology": 0.45, "execution": 0.45}, 0.1

_STOOD = f""", stood AS (SELECT s.*, g.t FROM (SELECT unnest([{', '.join(map(str, TICKS))}]) AS t) g JOIN v_scores s ON s.as_of <= g.t QUALIFY row_number() OVER (PARTITION BY s.token_key, s.metric_id, g.t ORDER BY s.as_of DESC, s.event_id DESC) = 1),
good AS (SELECT *, CASE metric_id WHEN 'purchase' THEN 1.5e0 WHEN 'view' THEN 0.05e0 ELSE 1e0 END * CASE confidence WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.7e0 WHEN 'low' THEN 0.35e0 END AS w FROM stood WHERE normalized IS NOT NULL AND confidence NOT IN ('missing', 'stale')),
shared AS (SELECT *, w / sum(w) OVER (PARTITION BY token_key, t, family) * CASE WHEN family IN ('topology', 'execution') THEN 0.45e0 ELSE 0.1e0 END AS share FROM good),
scored AS (SELECT token_key, t, sum(share * normalized) / sum(share) AS composite, count(*) AS k FROM shared GROUP BY token_key, t),
ticks AS (SELECT n.token_key, n.t, composite, coalesce(k, 0) / n.n AS coverage, n.n AS metrics FROM (SELECT token_key, t, count(*) AS n FROM stood GROUP BY token_key, t) n LEFT JOIN scored s ON s.token_key = n.token_key AND s.t = n.t)"""


def _stood(t):
    return at_instants(t("v_scores"), ["token_key", "metric_id"], list(TICKS), "as_of", "event_id", ["event_id", "family", "normalized", "confidence"])


def _ticks(t):
    return composite(_stood(t), ["token_key", "t"], WEIGHTS, BUDGETS, REST)


@key(f"{_STOOD} SELECT token_key, t, round(composite, 9) AS composite, round(coverage, 9) AS coverage, metrics FROM ticks", "v_scores")
def replay_ticks(t):
    """The two-level score of every token at every tick, from what was known by then."""
    return _ticks(t).select("token_key", "t", F.round("composite", 9).alias("composite"), F.round("coverage", 9).alias("coverage"), F.col("n").alias("metrics"))


@key(f"{_STOOD} SELECT t, count(*) AS decisions, round(avg(composite), 9) AS mean, round(avg(coverage), 9) AS coverage, max(metrics) AS metrics FROM ticks GROUP BY t", "v_scores")
def backtest_scores(t):
    return _ticks(t).groupBy("t").agg(F.count("*").alias("decisions"), F.round(F.avg("composite"), 9).alias("mean"), F.round(F.avg("coverage"), 9).alias("coverage"), F.max("n").alias("metrics"))


_VETOES = "SELECT token_key, unnest(string_split(vetoes, ',')) AS veto FROM ({}) WHERE vetoes <> ''"


@key(f"SELECT veto, count(*) AS n, min(token_key) AS first_token FROM ({_VETOES.format(ORACLES['veto_set'])}) GROUP BY veto")
def veto_histogram(t):
    """How many tokens each hard refusal holds back."""
    each = _vetoes(t).groupBy("veto")
    return each.agg(F.count("*").alias("n"), F.min("token_key").alias("first_token"))


def _vetoes(t):
    found = QUERIES["veto_set"](t.spark, t.sf_dir).filter("vetoes <> ''")
    return found.select("token_key", F.explode(F.split("vetoes", ",")).alias("veto"))


@key(f"""{_STOOD}, last AS (SELECT * FROM stood WHERE t = {TICKS[-1]}), good2 AS (SELECT * FROM shared WHERE t = {TICKS[-1]}),
top AS (SELECT token_key, metric_id AS evidence, CASE WHEN normalized >= 0.5e0 THEN 'for' ELSE 'against' END AS direction, round(share * normalized, 9) AS part FROM good2 QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY share * normalized DESC, metric_id) <= 8),
refused AS ({_VETOES.format(ORACLES['veto_set'])})
SELECT token_key, 'metric' AS kind, evidence, direction, part FROM top UNION ALL SELECT r.token_key, 'veto', veto, 'against', NULL FROM refused r JOIN (SELECT DISTINCT token_key FROM last) USING (token_key)
UNION ALL SELECT token_key, 'missing', CAST(count(*) FILTER (WHERE normalized IS NULL OR confidence IN ('missing', 'stale')) AS VARCHAR), NULL, NULL FROM last GROUP BY token_key""", "v_scores")
def evidence_rank(t):
    """A token's eight largest contributions at the last tick, its vetoes, and how many of its metrics are missing."""
    last = _stood(t).filter(F.col("t") == TICKS[-1])
    families = Window.partitionBy("token_key", "family")
    from ..operators.composite import CONFIDENCE, picked

    good = last.filter(usable()).withColumn("w", picked("metric_id", WEIGHTS, 1.0) * picked("confidence", CONFIDENCE, 0.0))
    part = F.col("w") / F.sum("w").over(families) * picked("family", BUDGETS, REST) * F.col("normalized")
    order = Window.partitionBy("token_key").orderBy(F.desc("part"), "metric_id")
    top = good.withColumn("part", part).withColumn("i", F.row_number().over(order)).filter("i <= 8")
    top = top.select("token_key", F.lit("metric").alias("kind"), F.col("metric_id").alias("evidence"), F.when(F.col("normalized") >= 0.5, "for").otherwise("against").alias("direction"), F.round("part", 9).alias("part"))
    none = F.lit(None)
    refused = _vetoes(t).join(last.select("token_key").distinct(), "token_key", "left_semi").select("token_key", F.lit("veto").alias("kind"), F.col("veto").alias("evidence"), F.lit("against").alias("direction"), none.cast("double").alias("part"))
    missing = last.groupBy("token_key").agg(F.count_if(~usable()).cast("string").alias("evidence")).select("token_key", F.lit("missing").alias("kind"), "evidence", none.cast("string").alias("direction"), none.cast("double").alias("part"))
    return top.unionByName(refused).unionByName(missing)
