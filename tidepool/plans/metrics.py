"""The signal metrics (survey section K), for all tokens in one plan each.

A metric is a relation (token_key, raw, evidence); raw is null where inputs fall short,
never 0. ``metric_normalize`` and ``metric_confidence`` apply to all of them alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from .registry import plan

T = 1500
_SEEN = f"SELECT * FROM v_trades WHERE as_of <= {T} AND observed_at <= {T}"
_CLAMP = "greatest(0e0, least(1e0, {}))"


def _metric(name: str, sql: str, *views: str, digits: int = 6, own=None) -> None:
    plan(name, f"WITH m AS ({sql}) SELECT token_key, round(raw, {digits}) AS raw, evidence FROM m", *views, own=own)


_WILSON = "greatest(0e0, least(1e0, ({k} / {n} + 1.9208e0 / {n} - 1.96e0 * sqrt(({k} / {n} * (1 - {k} / {n}) + 0.9604e0 / {n}) / {n})) / (1 + 3.8416e0 / {n})))"


def _wilson(k: str, n: str) -> str:
    return _WILSON.format(k=f"CAST({k} AS DOUBLE)", n=f"CAST({n} AS DOUBLE)")


# --- holders and trades --------------------------------------------------------------------

_CLUSTER = """SELECT h.token_key, h.wallet, h.share, CASE WHEN q.funded_by IS NOT NULL THEN h.funded_by ELSE 1000000 + h.wallet END AS cluster FROM v_holders h
 LEFT JOIN (SELECT d.token_key, d.funded_by FROM (SELECT token_key, funded_by, count(DISTINCT wallet) AS degree FROM v_holders GROUP BY token_key, funded_by) d
   JOIN (SELECT token_key, count(*) AS total FROM v_holders GROUP BY token_key) n ON d.token_key = n.token_key WHERE degree >= 2 AND CAST(degree AS DOUBLE) / total >= 0.08e0) q
 ON h.token_key = q.token_key AND h.funded_by = q.funded_by"""
plan("funder_clusters", f"SELECT token_key, cluster, count(*) AS wallets, round(sum(share), 6) AS share FROM ({_CLUSTER}) x GROUP BY token_key, cluster", "v_holders")
_metric("funder_graph_dispersion", f"SELECT token_key, CASE WHEN sum(n) >= 6 THEN sum(s) * sum(s) / sum(s * s) END AS raw, CAST(sum(n) AS BIGINT) AS evidence FROM (SELECT token_key, cluster, sum(share) AS s, count(*) AS n FROM ({_CLUSTER}) c GROUP BY token_key, cluster) x GROUP BY token_key", "v_holders", digits=9)
_GINI = "SELECT token_key, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1e0) / count(*) AS g, count(*) AS k, CASE WHEN count(*) <= 1 THEN 0e0 ELSE -sum(x / t * ln(x / t)) / ln(CAST(count(*) AS DOUBLE)) END AS e FROM (SELECT token_key, x, row_number() OVER (PARTITION BY token_key ORDER BY x) AS i, sum(x) OVER (PARTITION BY token_key) AS t FROM ({src}) s) r GROUP BY token_key"
_metric("holder_distribution_health", f"SELECT a.token_key, CASE WHEN a.k >= 8 THEN 0.5e0 * (1 - c.g) * (1 - 2 * greatest(0e0, c.g - a.g)) + 0.3e0 * greatest(0e0, least(1e0, c.e)) + 0.2e0 * (c.k / (c.k + 25e0)) END AS raw, a.k AS evidence FROM ({_GINI.format(src='SELECT token_key, share AS x FROM v_holders')}) a JOIN ({_GINI.format(src=f'SELECT token_key, sum(share) AS x FROM ({_CLUSTER}) q GROUP BY token_key, cluster')}) c ON a.token_key = c.token_key", "v_holders")
plan("tradeable_holders", "WITH k AS (SELECT token_key, wallet, share FROM v_holders WHERE share > 0 AND lower(label) <> 'machinery'), s AS (SELECT token_key, sum(share) AS total FROM k GROUP BY token_key) SELECT k.token_key, k.wallet, round(CASE WHEN abs(total - 1) < 1e-6 THEN share ELSE share / total END, 9) AS share FROM k JOIN s ON k.token_key = s.token_key", "v_holders")
_metric("entry_contention", f"SELECT token_key, CASE WHEN count(*) >= 6 AND count(DISTINCT wallet) >= 4 THEN exp(-pow((log10(median(fee) * 100 + 1) - 0.5e0) / 0.45e0, 2) / 2) * (0.4e0 + 0.6e0 * (count(DISTINCT wallet) / (count(DISTINCT wallet) + 12e0))) END AS raw, count(*) AS evidence FROM ({_SEEN}) v WHERE as_of >= {T} - 600 GROUP BY token_key", "v_trades")

# --- snapshots -----------------------------------------------------------------------------

_ES = "SELECT * FROM v_snapshots WHERE as_of <= 1000000 AND observed_at <= 1000000"
_metric("realizable_exit_depth", f"SELECT token_key, min(liquidity) * (0.25e0 + 0.75e0 * max(progress)) * (0.05e0 / 1.05e0) / 40 AS raw, count(*) AS evidence FROM ({_ES}) s WHERE as_of >= 700000 GROUP BY token_key", "v_snapshots")

def _price_stability(t):
    """A token whose least price is 0 has moved without bound."""
    g = t("v_snapshots").filter("as_of <= 1000000 AND observed_at <= 1000000").groupBy("token_key").agg(F.max("price").alias("hi"), F.min("price").alias("lo"), F.sum("liquidity").alias("flow"), F.count("*").alias("evidence"))
    moved = S.ln(1 + S.quotient("flow", F.abs(S.ln(S.quotient("hi", "lo"))))) - 3
    raw = F.when(F.col("evidence") >= 3, F.when(F.col("hi") == F.col("lo"), S.ln(1 + F.col("flow"))).otherwise(moved))
    return g.select("token_key", F.round(raw, 6).alias("raw"), "evidence")


_metric("price_stability_under_flow", f"SELECT token_key, CASE WHEN count(*) >= 3 THEN CASE WHEN max(price) = min(price) THEN ln(1e0 + sum(liquidity)) ELSE ln(1e0 + sum(liquidity) / abs(ln(max(price) / min(price)))) - 3 END END AS raw, count(*) AS evidence FROM ({_ES}) s GROUP BY token_key", "v_snapshots", own=_price_stability)
_metric("launch_timing_quality", f"SELECT token_key, 0.5e0 * {_CLAMP.format('avg(CASE WHEN progress >= 0.95e0 THEN 1e0 ELSE 0e0 END) / 0.02e0')} + 0.3e0 * (sum(liquidity) / (sum(liquidity) + 750000e0)) + 0.2e0 * (1 - count(*) / (count(*) + 400e0)) AS raw, count(*) AS evidence FROM ({_ES}) s GROUP BY token_key", "v_snapshots")

# --- posts ---------------------------------------------------------------------------------

_metric("mention_author_diversity", "SELECT token_key, CASE WHEN sum(c) < 8 THEN NULL WHEN count(*) < 3 THEN 1e0 ELSE exp(-sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) / n))) * (0.5e0 + 0.5e0 * avg(CASE WHEN c > 1 THEN 1e0 ELSE 0e0 END)) END AS raw, CAST(sum(c) AS BIGINT) AS evidence FROM (SELECT token_key, author, count(*) AS c, sum(count(*)) OVER (PARTITION BY token_key) AS n FROM v_posts GROUP BY token_key, author) x GROUP BY token_key", "v_posts")
_metric("derivative_remix_depth", "SELECT token_key, CASE WHEN count(*) <= 1 THEN 0e0 ELSE -sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) / n)) / ln(CAST(count(*) AS DOUBLE)) * (count(*) / (count(*) + 8e0)) END AS raw, CAST(sum(c) AS BIGINT) AS evidence FROM (SELECT token_key, text, count(*) AS c, sum(count(*)) OVER (PARTITION BY token_key) AS n FROM v_posts GROUP BY token_key, text) x GROUP BY token_key", "v_posts")
plan("team_accounts", "SELECT DISTINCT l.token_key, lower('@' || s_name) AS handle FROM v_launches l JOIN supplier ON s_suppkey = l.deployer", "v_launches")
