"""Statistics and curves (survey section H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import sequence
from .registry import key

_X = "(event_id % 23 - 11) / 10.0"


def _x(t):
    return t("events").select("event_id", "value", ((F.col("event_id") % 23 - 11) / 10.0).alias("x"))


@key(f"SELECT event_id, greatest(0, least(1, {_X})) AS v FROM events")
def clamp(t):
    return _x(t).select("event_id", S.clamp("x").alias("v"))


@key(f"SELECT event_id, round(1 / (1 + exp(-greatest(-60, least(60, 7 * ({_X} - 0.3))))), 9) AS v FROM events")
def logistic(t):
    return _x(t).select("event_id", F.round(S.logistic("x", 0.3, 7.0), 9).alias("v"))


@key(f"SELECT event_id, round(CASE WHEN {_X} <= 0 THEN 0.0 ELSE {_X} / ({_X} + 0.8) END, 9) AS v FROM events")
def saturating(t):
    return _x(t).select("event_id", F.round(S.saturating("x", 0.8), 9).alias("v"))


@key("SELECT token_key, round(greatest(0, least(1, (p + z2 / 2 / n - 1.96 * sqrt((p * (1 - p) + z2 / 4 / n) / n)) / (1 + z2 / n))), 9) AS v FROM (SELECT token_key, count(*) AS n, CAST(count(*) FILTER (WHERE source = 'click') AS DOUBLE) / count(*) AS p, 1.96 * 1.96 AS z2 FROM v_snapshots GROUP BY ALL)", "v_snapshots")
def wilson(t):
    g = t("v_snapshots").groupBy("token_key").agg(F.count_if(F.col("source") == "click").alias("k"), F.count("*").alias("n"))
    return g.select("token_key", F.round(S.wilson("k", "n"), 9).alias("v"))


@key(", q AS (SELECT source, count(*) AS n, avg(price) AS m, quantile_cont(price, 0.25) AS q1, median(price) AS q2, quantile_cont(price, 0.75) AS q3 FROM v_snapshots GROUP BY ALL) SELECT source, round(CASE WHEN n < 4 THEN m ELSE q2 END, 6) AS mid, round(CASE WHEN n < 4 OR q3 - q1 < 1e-9 OR q3 <= q2 THEN 1.0 ELSE least(50, greatest(0.001, ln(3) / (q3 - q2))) END, 9) AS k FROM q", "v_snapshots")
def calibrate_logistic(t):
    q = t("v_snapshots").groupBy("source").agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    flat = (F.col("n") < 4) | (q3 - q1 < 1e-9) | (q3 <= q2)
    return q.select("source", F.round(F.when(F.col("n") < 4, F.col("m")).otherwise(q2), 6).alias("mid"), F.round(F.when(flat, 1.0).otherwise(F.least(F.lit(50.0), F.greatest(F.lit(0.001), S.LN_3 / (q3 - q2)))), 9).alias("k"))


@key(", m AS (SELECT source, median(price) AS med, stddev_pop(price) AS sd FROM v_snapshots GROUP BY ALL), d AS (SELECT s.source, median(abs(price - med)) AS mad FROM v_snapshots s JOIN m ON s.source = m.source GROUP BY ALL) SELECT event_id, round((price - med) / CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 WHEN sd > 1e-9 THEN sd ELSE 1 END, 6) AS z FROM v_snapshots s JOIN m ON s.source = m.source JOIN d ON s.source = d.source", "v_snapshots")
def robust_z(t):
    m = t("v_snapshots").groupBy("source").agg(F.median("price").alias("med"), F.stddev_pop("price").alias("sd"))
    rows = t("v_snapshots").join(F.broadcast(m), "source")
    d = rows.groupBy("source").agg(F.median(F.abs(F.col("price") - F.col("med"))).alias("mad"))
    scale = F.when(F.col("mad") * 1.4826 > 1e-9, F.col("mad") * 1.4826).when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    return rows.join(F.broadcast(d), "source").select("event_id", F.round((F.col("price") - F.col("med")) / scale, 6).alias("z"))


@key("SELECT token_key, round(2 * sum(i * balance) / (count(*) * sum(balance)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT token_key, balance, row_number() OVER (PARTITION BY token_key ORDER BY balance) AS i FROM v_holders) GROUP BY token_key", "v_holders")
def gini(t):
    return sequence.gini(t("v_holders"), ["token_key"], "balance").select("token_key", F.round("gini", 6).alias("gini"))


def _shares(t):
    return t("v_holders").groupBy("token_key").agg(F.count("*").alias("n"), F.sum(F.col("share") * F.col("share")).alias("sq"), F.sum("share").alias("s"), F.sum(F.col("share") * F.ln("share")).alias("plogp"))


@key("SELECT token_key, round(sum(share * share) / (sum(share) * sum(share)), 9) AS hhi FROM v_holders GROUP BY token_key", "v_holders")
def herfindahl(t):
    return _shares(t).select("token_key", F.round(S.herfindahl("sq", "s"), 9).alias("hhi"))


@key("SELECT token_key, round(CASE WHEN count(*) <= 1 THEN 0.0 ELSE -sum(share * ln(share)) / ln(count(*)) END, 9) AS entropy FROM v_holders GROUP BY token_key", "v_holders")
def entropy(t):
    return _shares(t).select("token_key", F.round(S.entropy_from("plogp", "n"), 9).alias("entropy"))


@key("SELECT token_key, round((sum(share) * sum(share)) / sum(share * share), 8) AS k FROM v_holders GROUP BY token_key", "v_holders")
def effective_number(t):
    return _shares(t).select("token_key", F.round(1 / S.herfindahl("sq", "s"), 8).alias("k"))


@key("SELECT source, round(CASE WHEN n < 30 THEN 0.0 ELSE least(1, x / 40) END, 6) AS deviation FROM (SELECT source, max(n) AS n, sum((c - n * ln(1 + 1.0 / d) / ln(10)) * (c - n * ln(1 + 1.0 / d) / ln(10)) / (n * ln(1 + 1.0 / d) / ln(10))) AS x FROM (SELECT s.source, d, n, count(v.price) AS c FROM (SELECT source, count(*) AS n FROM v_snapshots GROUP BY ALL) s CROSS JOIN (SELECT unnest(range(1, 10)) AS d) q LEFT JOIN v_snapshots v ON v.source = s.source AND CAST(left(replace(ltrim(CAST(v.price AS VARCHAR), '0.'), '.', ''), 1) AS INTEGER) = d GROUP BY ALL) GROUP BY source)", "v_snapshots")
def benford(t):
    digits = t("v_snapshots").groupBy("source", S.leading_digit("price").alias("d")).agg(F.count("*").alias("c"))
    n = t("v_snapshots").groupBy("source").agg(F.count("*").alias("n"))
    grid = n.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(9))))
    want = F.col("n") * F.log10(1 + 1.0 / F.col("d"))
    x = grid.join(digits, ["source", "d"], "left").groupBy("source", "n").agg(F.sum(F.pow(F.coalesce("c", F.lit(0)) - want, F.lit(2)) / want).alias("x"))
    return x.select("source", F.round(F.when(F.col("n") < 30, 0.0).otherwise(F.least(F.lit(1.0), F.col("x") / 40)), 6).alias("deviation"))


@key("SELECT source, round(avg(CASE WHEN abs(price / 0.1 - round_even(price / 0.1, 0)) < 1e-6 OR abs(price / 0.5 - round_even(price / 0.5, 0)) < 1e-6 OR abs(price - round_even(price, 0)) < 1e-6 THEN 1.0 ELSE 0.0 END), 9) AS share FROM v_snapshots GROUP BY source", "v_snapshots")
def round_number_share(t):
    return t("v_snapshots").groupBy("source").agg(F.round(F.avg(F.when(S.is_round("price"), 1.0).otherwise(0.0)), 9).alias("share"))


@key("SELECT author, round(CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS DOUBLE) / sum(k), 9) AS share FROM (SELECT author, text, count(*) AS k FROM v_posts GROUP BY ALL) GROUP BY author", "v_posts")
def duplicate_share(t):
    k = t("v_posts").groupBy("author", "text").agg(F.count("*").alias("k"))
    return k.groupBy("author").agg(F.round(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k"), 9).alias("share"))


@key(", b AS (SELECT token_key, list(DISTINCT wallet) FILTER (WHERE side = 'buy') AS a, list(DISTINCT wallet) FILTER (WHERE side = 'sell') AS b FROM v_trades GROUP BY ALL) SELECT token_key, round(coalesce(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0), 0), 9) AS j FROM b", "v_trades")
def jaccard(t):
    from ..operators.similarity import jaccard as j

    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("wallet")))
    return t("v_trades").groupBy("token_key").agg(side("buy").alias("a"), side("sell").alias("b")).select("token_key", F.round(j(F.col("a"), F.col("b")), 9).alias("j"))


@key()
def bootstrap_ci(t):
    from ..operators.resample import bootstrap

    return bootstrap(t("v_snapshots").filter("source = 'purchase'"), "event_id", "price")


@key("SELECT event_id, round(greatest(0, least(0.05, 0.25 * (p - (1 - p) / (0.5 + event_id % 5)))), 9) AS size FROM (SELECT event_id, event_id % 100 / 100.0 AS p FROM events)")
def kelly_size(t):
    return t("events").select("event_id", F.round(S.kelly(F.col("event_id") % 100 / 100.0, 0.5 + F.col("event_id") % 5), 9).alias("size"))


@key("SELECT event_id, round(y - x * y / (x + d), 6) AS tokens, round((d / (y - x * y / (x + d)) / (x / y) - 1) * 10000, 4) AS bps, round(x * 350 / 10000, 6) AS max_size FROM (SELECT event_id, 30.0 + event_id % 85 AS x, 1000.0 + event_id % 777 AS y, 0.5 + event_id % 4 AS d FROM events)")
def curve_impact(t):
    e = t("events").select("event_id", (30.0 + F.col("event_id") % 85).alias("x"), (1000.0 + F.col("event_id") % 777).alias("y"), (0.5 + F.col("event_id") % 4).alias("d"))
    return e.select("event_id", F.round(S.tokens_out("x", "y", "d"), 6).alias("tokens"), F.round(S.impact_bps("x", "y", "d"), 4).alias("bps"), F.round(F.col("x") * 350 / 10000, 6).alias("max_size"))


@key("SELECT event_id, round(sol, 6) AS sol, round(sol / price, 6) AS tokens FROM (SELECT event_id, price, CASE WHEN progress < 0.95 THEN 30 + greatest(0, least(85, progress * 85)) ELSE 0.5 * liquidity / price END AS sol FROM v_snapshots)", "v_snapshots")
def curve_reserves(t):
    sol = F.when(F.col("progress") < 0.95, 30 + S.clamp(F.col("progress") * 85, 0.0, 85.0)).otherwise(S.quotient(0.5 * F.col("liquidity"), "price"))
    return t("v_snapshots").select("event_id", F.round(sol, 6).alias("sol"), S.rounded(S.quotient(sol, "price"), 6).alias("tokens"))


@key()
def phash_bits(t):
    from ..functions.images import phash

    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("embedding", (i % 64) + 1) * 127 + 128)
    return t("embeddings").select("vec_id", phash(pixels).alias("hash"))
