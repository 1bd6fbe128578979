"""Scoring, vetoes, screening and execution (survey section L), and graph exports (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import pit
from .registry import key, plan

# Confidence weights, family budgets and metric weights of the two-level score.
_CONF = "CASE confidence WHEN 'verified' THEN 1e0 WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.7e0 WHEN 'low' THEN 0.35e0 WHEN 'stale' THEN 0.15e0 ELSE 0e0 END"
_BUDGET = "CASE family WHEN 'topology' THEN 0.45e0 WHEN 'execution' THEN 0.45e0 ELSE 0.1e0 END"
_WEIGHT = "CASE metric_id WHEN 'purchase' THEN 1.5e0 WHEN 'view' THEN 0.05e0 ELSE 1e0 END"
_USABLE = f"SELECT token_key, event_id, metric_id, family, normalized, confidence, {_WEIGHT} * {_CONF} AS w FROM v_scores WHERE normalized IS NOT NULL AND confidence NOT IN ('missing', 'stale')"
_SHARE = f"SELECT token_key, event_id, metric_id, family, normalized, w / fam * {_BUDGET} AS share FROM (SELECT *, sum(w) OVER (PARTITION BY token_key, family) AS fam FROM ({_USABLE}) u) x WHERE fam > 0"
_COMPOSITE = f"SELECT s.token_key, sum(share * normalized) / sum(share) AS composite, count(*) / CAST(max(n) AS DOUBLE) AS coverage FROM ({_SHARE}) s JOIN (SELECT token_key, count(*) AS n FROM v_scores GROUP BY token_key) a ON a.token_key = s.token_key GROUP BY s.token_key"

plan("composite_score", f"SELECT token_key, round(composite, 6) AS composite, round(coverage, 9) AS coverage FROM ({_COMPOSITE}) c", "v_scores")
plan("usable_values", f"SELECT token_key, count(*) AS usable, round(sum(w), 6) AS weight FROM ({_USABLE}) u GROUP BY token_key", "v_scores")
plan("wash_filter", "WITH v AS (SELECT token_key, wallet, sum(amount_native) AS x, count(*) AS n FROM v_trades GROUP BY token_key, wallet), r AS (SELECT token_key, x, n, row_number() OVER (PARTITION BY token_key ORDER BY x) AS i, row_number() OVER (PARTITION BY token_key ORDER BY x DESC) AS j FROM v), g AS (SELECT token_key, sum(n) AS trades, count(*) AS k, sum(CASE WHEN j <= 2 THEN x ELSE 0e0 END) / sum(x) AS top2, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1e0) / count(*) AS gini FROM r GROUP BY token_key) SELECT token_key, CAST(trades AS BIGINT) AS trades, round(top2, 6) AS top2, trades >= 6 AND (top2 >= 0.75e0 OR (gini >= 0.9e0 AND k > 3)) AS washed FROM g", "v_trades")
plan("curve_stage", "SELECT event_id, round(least(1e0, liquidity / 4000e0), 9) AS progress, least(1e0, liquidity / 4000e0) > 0.85e0 AS late, source = 'purchase' AS suffix_ok FROM v_snapshots", "v_snapshots")

def _bundle_sybil(t):
    """Shares are added in the order of wallets, so that sums at a threshold are the same in every run."""
    run = Window.partitionBy("token_key").orderBy("wallet").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda label: F.sum(F.when(F.col("label") == label, F.col("share"))).over(run)
    rows = t("v_holders").select("token_key", "wallet", part("FURNITURE").alias("b"), part("BUILDING").alias("i"))
    g = rows.groupBy("token_key").agg(*[F.coalesce(F.max_by(c, "wallet"), F.lit(0.0)).alias(c) for c in ("b", "i")])
    b, i = F.col("b"), F.col("i")
    return g.select("token_key", F.round(b, 9).alias("bundled"), F.round(i, 9).alias("insider"), ((b >= 0.25) | ((b >= 0.2) & (i >= 0.2))).alias("sybil"))


plan("bundle_sybil", "SELECT token_key, round(b, 9) AS bundled, round(i, 9) AS insider, b >= 0.25e0 OR (b >= 0.2e0 AND i >= 0.2e0) AS sybil FROM (SELECT token_key, coalesce(sum(CASE WHEN label = 'FURNITURE' THEN share END), 0e0) AS b, coalesce(sum(CASE WHEN label = 'BUILDING' THEN share END), 0e0) AS i FROM v_holders GROUP BY token_key) x", "v_holders", own=_bundle_sybil)
plan("screen", "SELECT token_key, event_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY token_key ORDER BY rank DESC, event_id) AS i FROM (SELECT token_key, event_id, price / (price + 100e0) + 0.3e0 * progress + CASE WHEN source = 'signup' THEN 0.2e0 ELSE 0e0 END - 0.1e0 * (event_id % 3) AS rank FROM v_snapshots WHERE liquidity >= 400 AND as_of >= 1000000) a) b WHERE i = 1 ORDER BY rank DESC, token_key LIMIT 40", "v_snapshots")
plan("ticker_index", "SELECT symbol, count(*) AS tokens, min(token_key) AS first_token, round(sum(price), 2) AS liquidity FROM v_launches WHERE created_at <= 900 AND created_at >= 300 GROUP BY symbol", "v_launches")
plan("confluence_boost", "SELECT t.token_key, count(DISTINCT t.wallet) AS matches, round(CASE WHEN count(DISTINCT t.wallet) >= 2 THEN greatest(0.99e0, 0.6e0 * max(c_acctbal) / 10000) ELSE 0.45e0 * max(c_acctbal) / 10000 END, 9) AS boost FROM v_trades t JOIN customer ON c_custkey = t.wallet WHERE c_acctbal > 9500 AND side = 'buy' GROUP BY t.token_key", "v_trades")
plan("fill_sim", "SELECT event_id, round(tokens * (1 - 0.013e0), 6) AS tokens, round((d / tokens / (x / y) - 1) * 10000, 4) AS bps, (d / tokens / (x / y) - 1) * 10000 > 350 AS rejected FROM (SELECT event_id, 30e0 + event_id % 85 AS x, 1000e0 + event_id % 777 AS y, 0.2e0 + event_id % 3 AS d, (1000e0 + event_id % 777) - (30e0 + event_id % 85) * (1000e0 + event_id % 777) / ((30e0 + event_id % 85) + (0.2e0 + event_id % 3)) AS tokens FROM events) q")
plan("contention", "SELECT token_key, round(least(1e0, greatest(0e0, log10(1 + median(fee) * 100) / 1.5e0)), 6) AS contention FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500 AND as_of >= 1200 GROUP BY token_key", "v_trades")
plan("kill_switch", "SELECT token_key, round(min(m), 6) AS worst, max(CASE WHEN e AND e1 AND e2 THEN 1 ELSE 0 END) AS tripped FROM (SELECT token_key, avg(price) OVER (PARTITION BY token_key ORDER BY as_of, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m, source = 'error' AS e, lag(source) OVER (PARTITION BY token_key ORDER BY as_of, event_id) = 'error' AS e1, lag(source, 2) OVER (PARTITION BY token_key ORDER BY as_of, event_id) = 'error' AS e2 FROM v_snapshots) x GROUP BY token_key", "v_snapshots")

def _fill_calibration(t):
    """What buys paid over the snapshots of the three seconds before, in basis points, and what was modelled; a snapshot's price may be 0."""
    buys = t("v_trades").filter("side = 'buy'").select("token_key", (F.col("as_of") * 1000).alias("as_of"), "amount_native", "amount_token", "discount")
    pairs = pit.band_join(buys, t("v_snapshots").select("token_key", "as_of", "price"), "token_key", 3000)
    paid = (S.quotient(S.quotient("amount_native", "amount_token"), "right_price") - 1) * 10_000
    g = pairs.agg(F.count("*").alias("n"), F.avg(paid).alias("o"), F.avg(F.col("discount") * 10_000).alias("m"))
    return g.select("n", F.round("o", 4).alias("observed"), F.round("m", 4).alias("modelled"), F.round(F.col("o") - F.col("m"), 4).alias("gap"))


plan("fill_calibration", "SELECT count(*) AS n, round(avg(o), 4) AS observed, round(avg(m), 4) AS modelled, round(avg(o) - avg(m), 4) AS gap FROM (SELECT (t.amount_native / t.amount_token / s.price - 1) * 10000 AS o, t.discount * 10000 AS m FROM v_trades t JOIN v_snapshots s ON s.token_key = t.token_key AND s.as_of <= t.as_of * 1000 AND t.as_of * 1000 <= s.as_of + 3000 WHERE side = 'buy') x", "v_trades", "v_snapshots", own=_fill_calibration)
plan("revenue_share", "SELECT c_mktsegment AS tier, count(*) AS n, round(sum(o_totalprice * CASE WHEN c_acctbal > 5000 THEN 0.005e0 ELSE 0.01e0 END), 2) AS fees, round(sum(o_totalprice * CASE WHEN c_acctbal > 5000 THEN 0.005e0 ELSE 0.01e0 END * 0.2e0), 2) AS referral FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
plan("authority_audit", "SELECT p_partkey, score, CASE WHEN score <= 40 OR p_partkey % 7 = 0 THEN 'critical' WHEN score <= 80 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN p_size < 5 THEN 'QUARANTINE' WHEN score <= 40 THEN 'VETO' ELSE 'APPROVE' END AS verdict FROM (SELECT p_partkey, p_size, 100 - CASE WHEN p_partkey % 5 = 0 THEN 40 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 THEN 50 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 20 ELSE 0 END AS score FROM part) x")


@key("SELECT count(*) AS accounts, round(sum(c_custkey * 0.002e0), 6) AS total, round(sum(c_custkey * 0.002e0) * 0.9e0, 6) AS owner_part FROM customer LEFT JOIN (SELECT DISTINCT wallet FROM v_trades) t ON wallet = c_custkey WHERE wallet IS NULL", "v_trades")
def reclaim_scan(t):
    idle = t("customer").join(t("v_trades").select("wallet"), F.col("c_custkey") == F.col("wallet"), "left_anti")
    total = F.sum(F.col("c_custkey") * F.lit(0.002))
    return idle.agg(F.count("*").alias("accounts"), F.round(total, 6).alias("total"), F.round(total * F.lit(0.9), 6).alias("owner_part"))


plan("reputation_veto", "WITH bad AS (SELECT deployer FROM v_outcomes WHERE rugged GROUP BY deployer HAVING count(*) >= 5) SELECT l.token_key, l.deployer FROM v_launches l WHERE l.deployer IN (SELECT deployer FROM bad)", "v_outcomes")
plan("funder_apply", "SELECT h.token_key, h.wallet, CASE WHEN f.wallets >= 1100 THEN NULL ELSE h.funded_by END AS funded_by, CASE WHEN f.wallets >= 1100 THEN 'cex' ELSE 'wallet' END AS kind FROM v_holders h JOIN (SELECT funded_by, count(*) AS wallets FROM v_holders GROUP BY funded_by) f ON f.funded_by = h.funded_by", "v_holders")
plan("team_wallets", "SELECT DISTINCT h.token_key, h.wallet FROM v_holders h JOIN v_holders d ON d.token_key = h.token_key AND d.funded_by = h.funded_by WHERE d.wallet % 100 = h.token_key % 100 OR h.label = 'BUILDING'", "v_holders")
plan("funding_cabal", "SELECT DISTINCT h.token_key FROM v_holders h JOIN v_launches l ON l.token_key = h.token_key JOIN supplier ON s_suppkey = l.deployer WHERE s_nationkey = h.funded_by", "v_holders", "v_launches")
plan("topology_edges", "WITH h AS (SELECT token_key, wallet, funded_by, share, row_number() OVER (PARTITION BY token_key ORDER BY share DESC, wallet) AS i FROM v_holders) SELECT token_key, 'holds' AS kind, wallet AS source, token_key AS target FROM h WHERE i <= 40 UNION ALL SELECT DISTINCT token_key, 'funded', funded_by AS source, wallet AS target FROM h WHERE i <= 40", "v_holders")


@key()
def phash_clusters(t):
    """Clusters of two or more image hashes."""
    from ..operators.similarity import hamming_clusters, sign_bits

    found = hamming_clusters(t("embeddings").select("vec_id", sign_bits("embedding").alias("h")), "vec_id", "h", 17)
    named = found.groupBy("cluster").agg(F.min("vec_id").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return found.join(named, "cluster").select(F.col("vec_id").alias("v"), "component")
