"""Wallets, labelling, evaluation, ranking and memory (survey section M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import key, plan, written



@key("SELECT c_custkey AS wallet, q.before, count(t.wallet) AS prior FROM customer CROSS JOIN (SELECT 600 AS before UNION ALL SELECT 1200) q LEFT JOIN v_trades t ON t.wallet = c_custkey AND t.as_of < q.before AND t.observed_at <= floor(q.before / 60) * 60 GROUP BY c_custkey, q.before", "v_trades")
def wallet_priors(t):
    """Trades of a wallet that were over and known before each moment: one pass over the trades with a sum a moment."""
    moments = (600, 1200)
    known = [F.sum(F.when((F.col("as_of") < m) & (F.col("observed_at") <= m // 60 * 60), 1).otherwise(0)).alias(f"at_{m}") for m in moments]
    counts = t("v_trades").groupBy("wallet").agg(*known)
    rows = t("customer").select(F.col("c_custkey").alias("wallet")).join(counts, "wallet", "left")
    per = F.array(*[F.struct(F.lit(m).alias("before"), F.coalesce(f"at_{m}", F.lit(0)).alias("prior")) for m in moments])
    return rows.select("wallet", F.inline(per))


@key(""", d AS (SELECT o.token_key, o.created_at, count(t.wallet) AS m, o.multiple FROM v_outcomes o LEFT JOIN v_trades t ON t.token_key = o.token_key AND t.as_of <= o.created_at + 300 AND t.observed_at <= o.created_at + 300 GROUP BY o.token_key, o.created_at, o.multiple),
c AS (SELECT CAST(floor(created_at / 300) AS BIGINT) AS b, count(*) AS launches FROM v_launches GROUP BY 1)
SELECT a.token_key, a.m AS metrics, round(coalesce(a.multiple, 0e0), 9) AS label, CASE WHEN launches >= 300 THEN 'hot' WHEN launches <= 100 THEN 'dead' ELSE 'normal' END AS regime, CAST(count(p.token_key) AS BIGINT) AS peers, round(CASE WHEN count(p.token_key) = 0 THEN 0.5e0 ELSE count(*) FILTER (WHERE p.m <= a.m) / CAST(count(p.token_key) AS DOUBLE) END, 6) AS peer
FROM d a LEFT JOIN d p ON p.created_at < a.created_at OR (p.created_at = a.created_at AND p.token_key < a.token_key) LEFT JOIN c ON c.b = CAST(floor(a.created_at / 300) AS BIGINT) GROUP BY a.token_key, a.m, a.multiple, launches""", "v_outcomes")
def training_examples(t):
    """A row per labelled token at launch + 300 s: what was known then, its rank among the tokens launched before it (never later ones), the regime of its period, and the label."""
    from ..operators.sequence import earlier_rank

    t = written(t, v_trades="token_key as_of observed_at", v_launches="token_key deployer created_at")
    seen = t("v_trades").join(t("v_outcomes").select("token_key", "created_at"), "token_key").filter((F.col("as_of") <= F.col("created_at") + 300) & (F.col("observed_at") <= F.col("created_at") + 300)).groupBy("token_key").agg(F.count("*").alias("m"))
    rows = t("v_outcomes").select("token_key", "created_at", "multiple").join(seen, "token_key", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    ranked = earlier_rank(rows, "created_at", "token_key", "m")
    period = t("v_launches").groupBy(F.floor(F.col("created_at") / 300).alias("b")).agg(F.count("*").alias("launches"))
    out = ranked.join(period, F.floor(F.col("created_at") / 300) == F.col("b"), "left")
    regime = F.when(F.col("launches") >= 300, "hot").when(F.col("launches") <= 100, "dead").otherwise("normal")
    share = F.when(F.col("earlier") == 0, 0.5).otherwise(F.col("lower") / F.col("earlier"))
    return out.select("token_key", F.col("m").alias("metrics"), F.round(F.coalesce("multiple", F.lit(0.0)), 9).alias("label"), regime.alias("regime"), F.col("earlier").alias("peers"), F.round(share, 6).alias("peer"))


plan("denomination", "SELECT token_key, CASE WHEN count(CASE WHEN event_id % 4 <> 0 THEN price END) < count(price) * 0.7e0 THEN 'usd' ELSE 'native' END AS denomination FROM v_snapshots GROUP BY token_key", "v_snapshots")
_LABEL = "SELECT token_key, max(progress) >= 0.999e0 AS graduated, max(price) AS peak, max_by(price, as_of * 100000 + event_id % 100000) AS final FROM v_snapshots GROUP BY token_key"
#: Points of the path: snapshots, candles of three a row of one source, and creation up to 1,200 seconds before the first; twenty minutes of events count as a second.
_STAGE = "CASE WHEN token_key % 29 = 0 AND progress > 0.9e0 THEN 5 WHEN progress >= 0.97e0 THEN 3 WHEN progress >= 0.9e0 THEN 2 ELSE 1 END"
_PATH_SQL = f""", pts AS (SELECT token_key, CAST(floor(as_of / 1200) AS BIGINT) AS as_of, event_id AS id, price, price AS high, CASE WHEN event_id % 6 > 0 THEN liquidity * 30 END AS liquidity, CASE WHEN event_id % 4 > 0 THEN price * 1000 END AS market_cap, {_STAGE} AS stage, progress, source, 0 AS candle FROM v_snapshots WHERE source <> 'error'),
raw AS (SELECT token_key, event_id AS id, k, CAST(floor(as_of / 12000) AS BIGINT) * 10 + 10 * k AS as_of, price + k AS price, greatest(price + k, (price + k) * (1 + (event_id + k) % 4 / 10e0)) AS high FROM v_snapshots, (SELECT unnest([0, 1, 2]) AS k) WHERE source = 'error' AND price + k > 0),
cnd AS (SELECT token_key, as_of, id, price, high, NULL AS liquidity, NULL AS market_cap, 1 AS stage, NULL AS progress, 'candles' AS source, 1 AS candle FROM raw QUALIFY row_number() OVER (PARTITION BY token_key, as_of ORDER BY (price) * (1 + (id + k) % 4 / 10e0) DESC, id, k) = 1),
born AS (SELECT token_key, CAST(floor(min(as_of) / 1200) AS BIGINT) - token_key % 7 * 200 AS created_at FROM v_snapshots GROUP BY token_key),
own AS (SELECT x.*, created_at FROM (SELECT * FROM pts UNION ALL SELECT * FROM cnd) x JOIN born USING (token_key) WHERE price > 0 AND as_of >= created_at - 30 QUALIFY row_number() OVER (PARTITION BY token_key, as_of ORDER BY candle, id) = 1),
mom AS (SELECT *, sum(f) OVER (PARTITION BY token_key ORDER BY as_of) AS moment FROM (SELECT *, CASE WHEN as_of - lag(as_of) OVER (PARTITION BY token_key ORDER BY as_of) > 30 THEN 1 ELSE 0 END AS f FROM own)),
mid AS (SELECT *, median(price) OVER w AS p, greatest(median(price) OVER w, median(high) OVER w) AS h, median(liquidity) OVER w AS l, median(market_cap) OVER w AS m, max(stage) OVER w AS s, max(progress) OVER w AS g FROM mom WINDOW w AS (PARTITION BY token_key, moment)),
path AS (SELECT token_key, created_at, as_of, p AS price, h AS high, l AS liquidity, m AS market_cap, s AS stage, g AS progress, source FROM mid QUALIFY row_number() OVER (PARTITION BY token_key, moment ORDER BY abs(price - p), as_of) = 1)"""


def _path(t, policy):
    from ..operators import paths

    s = t("v_snapshots")
    at = F.floor(F.col("as_of") / 1200).cast("long")
    seen = s.filter("source <> 'error'").select("token_key", at.alias("as_of"), F.col("event_id").alias("id"), "price", F.col("price").alias("high"), F.when(F.col("event_id") % 6 > 0, F.col("liquidity") * 30).alias("liquidity"), F.when(F.col("event_id") % 4 > 0, F.col("price") * 1000).alias("market_cap"), F.expr(_STAGE).alias("stage"), "progress", "source", F.lit(False).alias("candle"))
    candle = lambda k: F.struct((F.floor(F.col("as_of") / 12000) * 10 + 10 * k).cast("long").alias("timestamp"), (F.col("price") + k).alias("close"), ((F.col("price") + k) * (1 + (F.col("event_id") + k) % 4 / 10)).alias("high"))
    payloads = s.filter("source = 'error'").select("token_key", F.col("event_id").alias("id"), F.array(candle(0), candle(1), candle(2)).alias("candles"))
    born = s.groupBy("token_key").agg((F.floor(F.min("as_of") / 1200) - F.col("token_key") % 7 * 200).cast("long").alias("created_at"))
    return paths.price_path(seen.unionByName(paths.candle_points(payloads)), born, policy)


@key(f"{_PATH_SQL} SELECT token_key, as_of, round(price, 6) AS price, round(high, 6) AS high, round(liquidity, 4) AS liquidity, round(market_cap, 3) AS market_cap, CAST(stage AS INTEGER) AS stage, progress, source FROM path", "v_snapshots")
def price_path(t):
    """Snapshots and candles as one path a token, one point a moment."""
    return _path(t, None).select("token_key", "as_of", F.round("price", 6).alias("price"), F.round("high", 6).alias("high"), F.round("liquidity", 4).alias("liquidity"), F.round("market_cap", 3).alias("market_cap"), F.col("stage").cast("int").alias("stage"), "progress", "source")


_HORIZONS = (("survived_1h", 600.0), ("survived_24h", 1500.0), ("survived_7d", 2100.0))


@key(f"""{_PATH_SQL}, ends AS (SELECT token_key, any_value(created_at) AS created_at, min(as_of) AS first_at, max(as_of) AS last_at, arg_min(price, as_of) AS first_price, max(high) AS peak, max(market_cap) AS peak_cap, max(stage) AS last_stage, count(liquidity) AS depths, max(liquidity) AS deepest,
 min(as_of) FILTER (WHERE stage = 3 OR progress >= 0.999) AS graduated_at FROM path GROUP BY token_key),
t0 AS (SELECT e.*, CASE WHEN first_at - created_at <= 900 THEN first_price END AS t0, (SELECT min(as_of) FROM path p WHERE p.token_key = e.token_key AND p.high = e.peak) AS peak_at,
 (SELECT market_cap FROM path p WHERE p.token_key = e.token_key AND market_cap IS NOT NULL ORDER BY as_of DESC LIMIT 1) AS final_cap, (SELECT liquidity FROM path p WHERE p.token_key = e.token_key AND liquidity IS NOT NULL ORDER BY as_of DESC LIMIT 1) AS depth,
 {', '.join(f"(SELECT price FROM path p WHERE p.token_key = e.token_key ORDER BY abs(as_of - e.created_at - {h}), as_of LIMIT 1) AS p_{n}" for n, h in _HORIZONS)} FROM ends e),
curve AS (SELECT p.token_key, p.high, 0.25e0 / t0 AS q, CASE WHEN stage IN (1, 2) THEN 30 + CASE WHEN progress IS NULL THEN greatest(1e0, coalesce(liquidity, 0) / 300) ELSE least(85e0, greatest(0e0, 85 * progress)) END ELSE greatest(1e-6, coalesce(liquidity, 0) / 300) END AS x FROM path p JOIN t0 USING (token_key) WHERE t0 IS NOT NULL),
sold AS (SELECT token_key, max(x - x * (x / high) / (x / high + q)) / 0.25e0 AS realizable FROM curve GROUP BY token_key)
SELECT token_key, round(peak / t0, 6) AS multiple, round(realizable, 6) AS realizable, CASE WHEN t0 IS NOT NULL THEN peak_at - created_at END AS to_peak, round(peak_cap, 3) AS peak_cap, round(final_cap, 3) AS final_cap, graduated_at IS NOT NULL AS graduated, graduated_at,
 {', '.join(f"coalesce(last_at - created_at >= {h} AND p_{n} >= 0.5e0 * t0, false) AS {n}" for n, h in _HORIZONS)}, last_stage >= 4 OR coalesce(depths >= 2 AND deepest > 500 AND depth <= 500 AND depth <= 0.25e0 * deepest, false) AS rugged FROM t0 LEFT JOIN sold USING (token_key)""", "v_snapshots")
def outcome_label(t):
    """Multiples, the best sale, graduation, survival and withdrawal of every path; horizons in the path's own time."""
    from ..operators import paths

    policy = paths.Policy(horizons=_HORIZONS)
    found = paths.outcomes(_path(t, policy), policy)
    digits = {"multiple": 6, "realizable": 6, "peak_cap": 3, "final_cap": 3}
    return found.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in found.columns])


plan("rug_label", f"SELECT token_key, peak > 100 AND final <= 30 AND final <= 0.25e0 * peak AND NOT graduated AS rugged FROM ({_LABEL}) l", "v_snapshots")
plan("training_label", "SELECT token_key, round(least(CASE WHEN rugged THEN 0.2e0 ELSE 1e0 END, greatest(0e0, least(1e0, ln(1 + coalesce(nullif(realizable, 0), nullif(multiple, 0), 0e0)) / ln(21e0)))), 9) AS label FROM v_outcomes", "v_outcomes")
_CORR = "SELECT metric_id, a, b FROM (SELECT metric_id, rank() OVER (PARTITION BY metric_id ORDER BY normalized) + (count(*) OVER (PARTITION BY metric_id, normalized) - 1) / 2e0 AS a, rank() OVER (PARTITION BY metric_id ORDER BY label) + (count(*) OVER (PARTITION BY metric_id, label) - 1) / 2e0 AS b FROM (SELECT metric_id, normalized, event_id % 37 AS label FROM v_scores WHERE normalized IS NOT NULL) x) y"
plan("metric_lift", f"SELECT metric_id, count(*) AS n, round(corr(a, b), 6) AS rho, CASE WHEN count(*) < 200 THEN 'thin' WHEN corr(a, b) > 0.02e0 THEN 'helps' WHEN corr(a, b) < -0.02e0 THEN 'hurts' ELSE 'neutral' END AS state FROM ({_CORR}) z GROUP BY metric_id", "v_scores")
plan("metric_ic", f"SELECT metric_id, round(corr(a, b), 6) AS ic FROM ({_CORR}) z GROUP BY metric_id", "v_scores")
plan("regime_counts", "SELECT regime, count(*) AS n, count(*) >= 200 AS fits FROM (SELECT CASE WHEN size > 40 THEN 'hot' WHEN size < 10 THEN 'dead' ELSE 'normal' END AS regime FROM v_launches) x GROUP BY regime", "v_launches")
_FOLDS = "SELECT fold, fold * 150 AS train_start, fold * 150 + 300 AS test_start, fold * 150 + 450 AS test_end, fold * 150 + 300 - 40 AS cutoff FROM (SELECT DISTINCT CAST(floor(created_at / 150) AS BIGINT) AS fold FROM v_launches) f"
plan("plan_folds", f"SELECT fold, train_start, cutoff, test_start, test_end FROM ({_FOLDS}) f", "v_launches")
plan("fold_split", f"SELECT fold, count(CASE WHEN o.created_at < cutoff AND o.labeled_at < test_start THEN 1 END) AS train, count(CASE WHEN o.created_at >= test_start THEN 1 END) AS test FROM ({_FOLDS}) f JOIN v_outcomes o ON o.created_at >= f.train_start AND o.created_at < f.test_end GROUP BY fold", "v_outcomes")
_PNL = "SELECT wallet % 20 AS account, token_key, wallet, sum(CASE WHEN side = 'sell' THEN amount_native ELSE -amount_native END) AS pnl, max(as_of) AS closed FROM v_trades GROUP BY token_key, wallet"
plan("backtest_summary", f"SELECT account, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 9) AS win_rate, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0e0 END), 0), 9) AS profit_factor, round(avg(pnl), 4) AS expectancy FROM ({_PNL}) p GROUP BY account", "v_trades")
plan("baselines", "SELECT 'buy_all' AS strategy, count(*) AS n, round(avg(multiple), 6) AS mean FROM v_outcomes UNION ALL SELECT 'random', count(*), round(avg(multiple), 6) FROM v_outcomes WHERE token_key * 7919 % 100 < 35 UNION ALL SELECT 'volume', count(*), round(avg(o.multiple), 6) FROM v_outcomes o JOIN (SELECT token_key, sum(amount_native) AS v FROM v_trades GROUP BY token_key) t ON t.token_key = o.token_key WHERE t.v >= (SELECT median(v) FROM (SELECT sum(amount_native) AS v FROM v_trades GROUP BY token_key) m)", "v_outcomes", "v_trades")
plan("edge_verdict", "SELECT min(b.mean) < s.mean AS beats_one, max(b.mean) < s.mean AS beats_all FROM (SELECT avg(multiple) AS mean FROM v_outcomes UNION ALL SELECT avg(multiple) FROM v_outcomes WHERE token_key * 7919 % 100 < 35) b CROSS JOIN (SELECT avg(multiple) AS mean FROM v_outcomes WHERE graduated) s GROUP BY s.mean", "v_outcomes")
plan("metric_coverage", "SELECT metric_id, count(*) AS evaluated, count(normalized) AS usable, round(count(normalized) / CAST(count(*) AS DOUBLE), 9) AS coverage, min(CASE WHEN normalized IS NULL THEN event_id END) AS first_absent FROM v_scores GROUP BY metric_id", "v_scores")
plan("channel_candidates", "SELECT author, count(DISTINCT token_key) AS tokens FROM (SELECT author, token_key FROM v_posts WHERE n_chars > 800 UNION ALL SELECT author, (token_key + 7) % 50 FROM v_posts WHERE is_repost) x GROUP BY author HAVING count(DISTINCT token_key) >= 2", "v_posts")
plan("channel_drop", "SELECT author, median(likes) AS median_likes, round(avg(CASE WHEN likes > 48 THEN 1e0 ELSE 0e0 END), 9) AS led, CASE WHEN count(*) >= 3 AND median(likes) <= 40 THEN 'weak' WHEN count(*) < 3 THEN 'thin' ELSE 'kept' END AS state FROM v_posts GROUP BY author", "v_posts")
_MEM = "SELECT event_id, source AS kind, as_of, least(1e0, price / 80e0) AS confidence, (2500000 - as_of) / 3600e0 AS age FROM v_snapshots"
plan("memory_recall", f"SELECT event_id, round(confidence * pow(0.5e0, age / 72e0), 6) AS score FROM ({_MEM}) m WHERE confidence * pow(0.5e0, age / 72e0) >= 0.35e0 ORDER BY confidence * pow(0.5e0, age / 72e0) DESC, event_id LIMIT 24", "v_snapshots")
plan("memory_scd2", "SELECT token_key, source, event_id, as_of AS valid_from, lead(as_of) OVER (PARTITION BY token_key, source ORDER BY as_of, event_id) AS valid_until FROM v_snapshots", "v_snapshots")
plan("heuristics", "SELECT source, metric, side, count(*) AS n, round(least(0.95e0, 0.4e0 + 0.12e0 * ln(CAST(count(*) AS DOUBLE)) / ln(2e0)), 9) AS confidence FROM (SELECT source, token_key % 10 AS metric, CASE WHEN price < 50 THEN 'low' ELSE 'high' END AS side FROM v_snapshots) x GROUP BY source, metric, side HAVING count(*) >= 3", "v_snapshots")
plan("integrity_flags", "SELECT source, CASE WHEN count(*) < 100 THEN 'alarm' WHEN count(*) < 2500 THEN 'warn' ELSE 'ok' END AS volume, CASE WHEN count(DISTINCT round(price, 0)) < 10 THEN 'alarm' ELSE 'ok' END AS spread, CASE WHEN max(as_of) < 2400000 THEN 'warn' ELSE 'ok' END AS freshness FROM v_snapshots GROUP BY source", "v_snapshots")


@key("SELECT token_key, as_of, 'trade' AS kind, count(*) AS n FROM v_trades GROUP BY token_key, as_of UNION ALL SELECT token_key, as_of, 'snapshot', count(*) FROM v_snapshots GROUP BY token_key, as_of UNION ALL SELECT token_key, created_at, 'launch', count(*) FROM v_launches GROUP BY token_key, created_at", "v_launches", "v_snapshots")
def autopsy_timeline(t):
    kinds = (("v_trades", "as_of", "trade"), ("v_snapshots", "as_of", "snapshot"), ("v_launches", "created_at", "launch"))
    trades, snaps, launches = (t(v).groupBy("token_key", F.col(at).alias("as_of")).agg(F.count("*").alias("n")).select("token_key", "as_of", F.lit(kind).alias("kind"), "n") for v, at, kind in kinds)
    return trades.unionByName(snaps).unionByName(launches)


plan("token_compare", "WITH s AS (SELECT token_key, metric_id, avg(normalized) AS v FROM v_scores WHERE token_key IN (3, 4) GROUP BY token_key, metric_id) SELECT a.metric_id, round(a.v, 9) AS a, round(b.v, 9) AS b, round(a.v - b.v, 9) AS delta FROM s a JOIN s b ON a.metric_id = b.metric_id WHERE a.token_key = 3 AND b.token_key = 4", "v_scores")
plan("threshold_sensitivity", "SELECT q.f, count(*) AS entries, round(avg(s.v), 9) AS mean FROM (SELECT token_key, avg(normalized) AS v FROM v_scores GROUP BY token_key) s CROSS JOIN (SELECT 0.5e0 AS f UNION ALL SELECT 0.75e0 UNION ALL SELECT 0.9e0 UNION ALL SELECT 1e0 UNION ALL SELECT 1.1e0 UNION ALL SELECT 1.25e0) q WHERE s.v >= 0.165e0 * q.f GROUP BY q.f", "v_scores")
plan("meme_lineage", "SELECT text_key, count(*) AS n, min(post_id) AS root, round(count(DISTINCT author) / CAST(count(*) AS DOUBLE), 9) AS originality FROM (SELECT post_id, author, md5(text) AS text_key FROM v_posts) x GROUP BY text_key HAVING count(*) > 1", "v_posts")
plan("recent_publication", "SELECT l.token_key FROM v_launches l WHERE EXISTS (SELECT 1 FROM v_trades t WHERE t.token_key = l.token_key AND t.as_of >= 1500 - 24 AND t.as_of <= 1500)", "v_launches")


@key("SELECT token_key, '[' || metric_id || ':' || CAST(event_id AS VARCHAR(20)) || ']' AS fact FROM v_scores WHERE confidence = 'high' UNION ALL SELECT token_key, '[holder:' || CAST(wallet AS VARCHAR(20)) || ']' FROM v_holders WHERE share > 0.5e0", "v_scores", "v_holders")
def fact_citations(t):
    scores = t("v_scores").filter("confidence = 'high'").select("token_key", F.concat(F.lit("["), "metric_id", F.lit(":"), F.col("event_id").cast("string"), F.lit("]")).alias("fact"))
    holders = t("v_holders").filter("share > 0.5").select("token_key", F.concat(F.lit("[holder:"), F.col("wallet").cast("string"), F.lit("]")).alias("fact"))
    return scores.unionByName(holders)


plan("session_totals", "SELECT source, count(*) AS sweeps, sum(CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) * 1 AS failed, count(DISTINCT token_key) AS tokens FROM v_snapshots GROUP BY source".replace("sum(CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) * 1", "count(CASE WHEN event_id % 19 = 0 THEN 1 END)"), "v_snapshots")
plan("corpus_growth", "SELECT b.source, b.n AS before, a.n AS after, a.n - b.n AS delta FROM (SELECT source, count(*) AS n FROM v_snapshots WHERE as_of < 1000000 GROUP BY source) b JOIN (SELECT source, count(*) AS n FROM v_snapshots GROUP BY source) a ON a.source = b.source", "v_snapshots")
plan("suggest_ids", "SELECT want, id FROM (SELECT q.want, n.id, row_number() OVER (PARTITION BY q.want ORDER BY levenshtein(q.want, n.id), n.id) AS i FROM (SELECT 'purchse' AS want UNION ALL SELECT 'clik') q CROSS JOIN (SELECT DISTINCT event_type AS id FROM events) n) x WHERE i <= 3")


@key("SELECT token_key, round(greatest(0, least(1, 0.5e0 + 0.08e0 * ups - 0.12e0 * downs)), 6) AS confidence FROM (SELECT token_key, count(*) FILTER (WHERE source = 'click') AS ups, count(*) FILTER (WHERE source = 'none') AS downs FROM v_snapshots GROUP BY token_key)", "v_snapshots")
def memory_feedback(t):
    """Confidence from 0.5 on, up or down by each verdict and held between 0 and 1 at each."""
    from ..operators.ranges import folded

    step = F.when(F.col("source") == "click", 0.08).when(F.col("source") == "none", -0.12).otherwise(0.0)
    found = folded(t("v_snapshots"), ["token_key"], ["event_id"], F.lit(1.0), step, F.first(F.lit(0.5)), 0.0, 1.0)
    return found.select("token_key", F.round("folded", 6).alias("confidence"))


@key()
def weight_fit(t):
    from ..operators.fitting import fit_weights

    return fit_weights(t("v_scores").filter("normalized IS NOT NULL").select("token_key", "metric_id", "normalized"), t("v_outcomes").select("token_key", F.coalesce("multiple", F.lit(0.0)).alias("label")))


@key()
def ablation(t):
    from ..operators.fitting import ablate

    return ablate(t("v_scores").filter("normalized IS NOT NULL").select("token_key", "metric_id", "normalized"), t("v_outcomes").select("token_key", F.coalesce("multiple", F.lit(0.0)).alias("label")))
