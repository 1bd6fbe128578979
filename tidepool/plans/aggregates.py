"""Aggregations, sorts, limits and set operations (survey sections D and F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pit, ranges, sequence
from .registry import key

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@key(" UNION ALL ".join(f"SELECT '{x}' AS tab, count(*) AS n FROM {x}" for x in _TABLES))
def table_counts(t):
    return reduce(lambda a, b: a.union(b), [t(x).agg(F.lit(x).alias("tab"), F.count("*").alias("n")) for x in _TABLES])


@key("SELECT wallet, min(as_of) AS first_seen, max(as_of) AS last_seen, count(*) AS trades, count(DISTINCT token_key) AS tokens FROM v_trades GROUP BY wallet", "v_trades")
def wallet_profiles(t):
    return t("v_trades").groupBy("wallet").agg(F.min("as_of").alias("first_seen"), F.max("as_of").alias("last_seen"), F.count("*").alias("trades"), F.countDistinct("token_key").alias("tokens"))


@key("SELECT funded_by, count(DISTINCT wallet) AS wallets FROM v_holders GROUP BY funded_by HAVING count(DISTINCT wallet) >= 25", "v_holders")
def funder_fanout(t):
    return t("v_holders").groupBy("funded_by").agg(F.countDistinct("wallet").alias("wallets")).filter("wallets >= 25")


@key("SELECT author, count(*) AS posts, count(DISTINCT text) AS texts, count(*) FILTER (WHERE is_repost) AS reposts, count(*) FILTER (WHERE parent_id IS NULL) AS top_level, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE n_chars < 200) AS short, CAST(sum(likes) AS BIGINT) AS likes FROM v_posts GROUP BY author", "v_posts")
def post_integrity(t):
    return t("v_posts").groupBy("author").agg(F.count("*").alias("posts"), F.countDistinct("text").alias("texts"), F.count_if("is_repost").alias("reposts"), F.count_if(F.col("parent_id").isNull()).alias("top_level"), F.countDistinct("lang").alias("langs"), F.count_if(F.col("n_chars") < 200).alias("short"), F.sum("likes").alias("likes"))


@key(", w AS (SELECT metric_id, max(as_of) - 300000 AS since FROM v_scores GROUP BY ALL) SELECT s.metric_id, count(*) AS n, count(DISTINCT round(raw, 1)) AS spread FROM v_scores s JOIN w ON s.metric_id = w.metric_id AND as_of >= since GROUP BY s.metric_id", "v_scores")
def metric_spread(t):
    since = t("v_scores").groupBy("metric_id").agg((F.max("as_of") - 300_000).alias("since"))
    return t("v_scores").join(F.broadcast(since), "metric_id").filter("as_of >= since").groupBy("metric_id").agg(F.count("*").alias("n"), F.countDistinct(F.round("raw", 1)).alias("spread"))


_NEAREST = "SELECT {k}, max(n) AS n, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.9, 0) THEN v END) AS p90 FROM (SELECT {k}, v, row_number() OVER (PARTITION BY {k} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM ({src}) WHERE v IS NOT NULL) GROUP BY {k}"


@key(_NEAREST.format(k="source", src="SELECT source, observed_at - as_of + event_id % 50 AS v FROM v_snapshots"), "v_snapshots")
def observation_latency(t):
    rows = t("v_snapshots").select("source", (F.col("observed_at") - F.col("as_of") + F.col("event_id") % 50).alias("v"))
    return sequence.nearest_rank(rows, ["source"], "v", {"p50": 0.5, "p90": 0.9})


@key(", a AS (" + _NEAREST.format(k="g", src="SELECT 1 AS g, multiple AS v FROM v_outcomes") + "), b AS (" + _NEAREST.format(k="g", src="SELECT 1 AS g, realizable AS v FROM v_outcomes") + ") SELECT a.n, a.p50, a.p90, b.n AS n2, b.p50 AS q50, b.p90 AS q90, (SELECT count(*) FROM v_outcomes WHERE multiple IS NOT NULL AND realizable IS NOT NULL) AS paired FROM a CROSS JOIN b", "v_outcomes")
def outcome_spread(t):
    rows = t("v_outcomes").withColumn("g", F.lit(1))
    pick = {"p50": 0.5, "p90": 0.9}
    a = sequence.nearest_rank(rows, ["g"], "multiple", pick).select("n", "p50", "p90")
    b = sequence.nearest_rank(rows, ["g"], "realizable", pick).select(F.col("n").alias("n2"), F.col("p50").alias("q50"), F.col("p90").alias("q90"))
    paired = rows.agg(F.count_if(F.col("multiple").isNotNull() & F.col("realizable").isNotNull()).alias("paired"))
    return a.crossJoin(b).crossJoin(paired)


@key("SELECT role, count(*) AS n, round(avg(len(text)), 6) AS mean_length FROM conversations GROUP BY role")
def memory_stats(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@key(", p AS (SELECT token_key, progress FROM v_snapshots WHERE as_of <= 1000000 AND observed_at <= 1000000 QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY as_of DESC, event_id DESC) = 1) SELECT count(*) AS launches, round(avg(CASE WHEN progress >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS graduation_rate, round(count(*) / (1000000 / 3600.0), 6) AS per_hour FROM p", "v_snapshots")
def market_regime(t):
    last = pit.latest_by(pit.pit_filter(t("v_snapshots"), 1_000_000), ["token_key"], ["as_of", "event_id"])
    return last.agg(F.count("*").alias("launches"), F.round(F.avg(F.when(F.col("progress") >= 0.95, 1.0).otherwise(0.0)), 6).alias("graduation_rate"), F.round(F.count("*") / (1_000_000 / 3600.0), 6).alias("per_hour"))


@key("SELECT wallet % 10 AS account, count(*) AS n, count(*) FILTER (WHERE side = 'buy') AS buys, round(sum(CASE WHEN side = 'sell' THEN amount_native ELSE 0 END) - sum(CASE WHEN side = 'buy' THEN amount_native ELSE 0 END), 2) AS cash, round(avg(CASE WHEN side = 'sell' THEN 1.0 ELSE 0.0 END), 6) AS sell_rate FROM v_trades GROUP BY ALL", "v_trades")
def portfolio_summary(t):
    sell, buy = F.col("side") == "sell", F.col("side") == "buy"
    cash = F.sum(F.when(sell, F.col("amount_native")).otherwise(0)) - F.sum(F.when(buy, F.col("amount_native")).otherwise(0))
    return t("v_trades").groupBy((F.col("wallet") % 10).alias("account")).agg(F.count("*").alias("n"), F.count_if(buy).alias("buys"), F.round(cash, 2).alias("cash"), F.round(F.avg(F.when(sell, 1.0).otherwise(0.0)), 6).alias("sell_rate"))


@key("SELECT token_key, round(avg(normalized) FILTER (WHERE family = 'social'), 9) AS social, round(avg(normalized) FILTER (WHERE family = 'execution'), 9) AS execution, round(avg(normalized) FILTER (WHERE family = 'topology'), 9) AS topology FROM v_scores GROUP BY token_key", "v_scores")
def family_scores(t):
    wide = t("v_scores").groupBy("token_key").pivot("family", ["social", "execution", "topology"]).agg(F.avg("normalized"))
    return wide.select("token_key", *[F.round(c, 9).alias(c) for c in ("social", "execution", "topology")])


@key("SELECT source, round(quantile_cont(price, 0.25), 6) AS q1, round(quantile_cont(price, 0.5), 6) AS q2, round(quantile_cont(price, 0.75), 6) AS q3 FROM v_snapshots GROUP BY source", "v_snapshots")
def quartiles(t):
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t("v_snapshots").groupBy("source").agg(q.alias("q")).select("source", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@key("SELECT token_key, event_id, price FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY price DESC, as_of, event_id) = 1", "v_snapshots")
def peak_point(t):
    best = F.max_by(F.struct("event_id", "price"), F.struct("price", F.negative("as_of"), F.negative("event_id")))
    return t("v_snapshots").groupBy("token_key").agg(best.alias("b")).select("token_key", "b.event_id", "b.price")


@key(", c AS (SELECT token_key, metric_id, count(*) AS n, count(normalized) AS u FROM v_scores GROUP BY ALL) SELECT metric_id, round(sum(CAST(u AS DOUBLE) / n * n) / sum(n), 6) AS coverage FROM c GROUP BY metric_id", "v_scores")
def pooled_coverage(t):
    c = t("v_scores").groupBy("token_key", "metric_id").agg(F.count("*").alias("n"), F.count("normalized").alias("u"))
    return c.groupBy("metric_id").agg(F.round(F.sum(F.col("u") / F.col("n") * F.col("n")) / F.sum("n"), 6).alias("coverage"))


@key("SELECT source, bool_and(price > 0) AS ok, bool_or(event_id % 97 = 0) AS degraded FROM v_snapshots GROUP BY source", "v_snapshots")
def surface_flags(t):
    return t("v_snapshots").groupBy("source").agg(F.bool_and(F.col("price") > 0).alias("ok"), F.bool_or(F.col("event_id") % 97 == 0).alias("degraded"))


@key("SELECT source, event_id, as_of FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY source ORDER BY as_of DESC, event_id DESC) = 1", "v_snapshots")
def surface_latest(t):
    return pit.latest_by(t("v_snapshots"), ["source"], ["as_of", "event_id"]).select("source", "event_id", "as_of")


@key("SELECT launchpad, symbol, count(*) AS n, round(sum(price), 2) AS price FROM v_launches GROUP BY ROLLUP (launchpad, symbol)", "v_launches")
def regime_rollup(t):
    return t("v_launches").rollup("launchpad", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@key("SELECT launchpad, size % 3 AS class, count(*) AS n FROM v_launches GROUP BY CUBE (launchpad, class)", "v_launches")
def regime_cube(t):
    return t("v_launches").withColumn("class", F.col("size") % 3).cube("launchpad", "class").agg(F.count("*").alias("n"))


# --- sorts, limits, sets -------------------------------------------------------------------


@key("SELECT author, row_number() OVER (ORDER BY measured DESC, median DESC, n DESC, author) AS place FROM (SELECT author, count(*) > 45 AS measured, median(likes) AS median, count(*) AS n FROM v_posts GROUP BY author)", "v_posts")
def channel_rank(t):
    stats = t("v_posts").groupBy("author").agg((F.count("*") > 45).alias("measured"), F.median("likes").alias("median"), F.count("*").alias("n"))
    order = [F.desc("measured"), F.desc("median"), F.desc("n"), F.asc("author")]
    return ranges.numbered(stats, order).select("author", "place")


@key("SELECT token_key, event_id, normalized FROM v_scores WHERE normalized IS NOT NULL ORDER BY normalized DESC, event_id LIMIT 40", "v_scores")
def recent_scores(t):
    return t("v_scores").filter("normalized IS NOT NULL").select("token_key", "event_id", "normalized").orderBy(F.desc("normalized"), "event_id").limit(40)


@key("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 60")
def case_sort(t):
    return t("orders").orderBy(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus").limit(60)


@key("SELECT token_key, string_agg(source, ',' ORDER BY seen) AS reasons FROM (SELECT token_key, source, min(event_id) AS seen FROM v_snapshots GROUP BY ALL) GROUP BY token_key", "v_snapshots")
def veto_dedupe(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "source"))), lambda x: x["source"])
    return t("v_snapshots").groupBy("token_key").agg(F.array_join(F.array_distinct(ordered), ",").alias("reasons"))


@key("SELECT * FROM (SELECT token_key, event_id, price FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY price DESC, event_id) = 1) ORDER BY price DESC, token_key LIMIT 30", "v_snapshots")
def screen_dedupe(t):
    best = pit.ranked_by(t("v_snapshots"), ["token_key"], [F.desc("price"), F.asc("event_id")])
    return best.select("token_key", "event_id", "price").orderBy(F.desc("price"), "token_key").limit(30)


_POINTS = ", p AS (SELECT token_key, as_of // 3600 AS slot_at, price, event_id, 0 AS prio FROM v_snapshots WHERE source = 'view' UNION ALL SELECT token_key, as_of // 3600, price * 2, event_id, 1 FROM v_snapshots WHERE source = 'click')"


def _points(t):
    rows = t("v_snapshots").withColumn("slot_at", F.floor(F.col("as_of") / 3600))
    a = rows.filter("source = 'view'").select("token_key", "slot_at", "price", "event_id", F.lit(0).alias("prio"))
    b = rows.filter("source = 'click'").select("token_key", "slot_at", (F.col("price") * 2).alias("price"), "event_id", F.lit(1).alias("prio"))
    return a.unionByName(b)


@key(f"{_POINTS} SELECT token_key, slot_at, price FROM p QUALIFY row_number() OVER (PARTITION BY token_key, slot_at ORDER BY prio, event_id) = 1", "v_snapshots")
def merge_points(t):
    return pit.ranked_by(_points(t), ["token_key", "slot_at"], [F.asc("prio"), F.asc("event_id")]).select("token_key", "slot_at", "price")


_BUY, _SELL = "SELECT DISTINCT wallet FROM v_trades WHERE side = 'buy'", "SELECT DISTINCT wallet FROM v_trades WHERE side = 'sell'"


def _sides(t):
    rows = t("v_trades")
    return rows.filter("side = 'buy'").select("wallet"), rows.filter("side = 'sell'").select("wallet")


@key(f"{_BUY} EXCEPT {_SELL}", "v_trades")
def cohort_except(t):
    a, b = _sides(t)
    return a.distinct().exceptAll(b.distinct())


@key(f"{_BUY} INTERSECT {_SELL}", "v_trades")
def set_intersect(t):
    a, b = _sides(t)
    return a.intersect(b)


@key(f"{_BUY} UNION {_SELL}", "v_trades")
def set_union(t):
    a, b = _sides(t)
    return a.union(b).distinct()


@key("SELECT token_key, as_of // 86400 AS day, max(price) AS high FROM v_snapshots GROUP BY ALL", "v_snapshots")
def candle_dedupe(t):
    return t("v_snapshots").groupBy("token_key", F.floor(F.col("as_of") / 86400).alias("day")).agg(F.max("price").alias("high"))


@key("SELECT c_custkey AS channel FROM (SELECT c_custkey, min(prio) AS prio FROM (SELECT c_custkey, 0 AS prio FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 5000) GROUP BY c_custkey) WHERE c_custkey % 3 <> 0 ORDER BY prio, c_custkey LIMIT 200")
def watchlist_seed(t):
    c = t("customer")
    both = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0).alias("prio")).union(c.filter("c_acctbal > 5000").select("c_custkey", F.lit(1)))
    dropped = c.filter("c_custkey % 3 = 0").select("c_custkey")
    kept = both.groupBy("c_custkey").agg(F.min("prio").alias("prio")).join(dropped, "c_custkey", "left_anti")
    return kept.orderBy("prio", "c_custkey").limit(200).select(F.col("c_custkey").alias("channel"))


@key("SELECT author, post_id FROM v_posts QUALIFY row_number() OVER (PARTITION BY author, token_key % 5 ORDER BY likes DESC, post_id) = 1", "v_posts")
def best_parse(t):
    rows = t("v_posts").withColumn("g", F.col("token_key") % 5)
    return pit.ranked_by(rows, ["author", "g"], [F.desc("likes"), F.asc("post_id")]).select("author", "post_id")


@key("SELECT post_id FROM v_chat WHERE contains(text, '$CLICK') OR contains(text, '/77') OR symbol = 'signup'", "v_chat")
def about_token(t):
    return t("v_chat").filter(F.col("text").contains("$CLICK") | F.col("text").contains("/77") | (F.col("symbol") == "signup")).select("post_id")
