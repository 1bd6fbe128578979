"""Regimes, vetoes, gates, entries and exits (survey section L), in DataFrame functions; the twins are SQL of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import key, written
from .scoring import _COMPOSITE
from .signals import prior_counts

# Graduation rates that part regimes, and factors on family weights.
HOT, DEAD = 0.010, 0.0035
ADJUST = {"hot": {"social": 1.2, "topology": 0.9, "execution": 0.9}, "normal": {}, "dead": {"social": 0.9, "topology": 1.2, "execution": 1.3}}
FAMILIES = {"topology": 0.45, "execution": 0.45, "social": 0.1}
# Thresholds of vetoes and of the entry gate.
TOP10, INSIDER, BUNDLE, DEV_BUNDLE, TEMPLATE = 0.55, 0.30, 0.35, 0.25, 0.75
MIN_COVERAGE, ENTER, EXIT = 0.40, 0.75, 0.45


def _label(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate >= HOT, "hot").when(rate <= DEAD, "dead").otherwise("normal")


_RATE = "SELECT CAST(floor(created_at / 200) AS BIGINT) AS period, avg(CASE WHEN token_key % 5 = 0 AND token_key % 31 = 0 THEN 1e0 ELSE 0e0 END) AS rate FROM v_launches GROUP BY 1"
_REGIME = f"SELECT period, rate, CASE WHEN rate >= {HOT} THEN 'hot' WHEN rate <= {DEAD} THEN 'dead' ELSE 'normal' END AS regime FROM ({_RATE}) q"


@key(f", r AS ({_REGIME}), w AS (SELECT period, regime, family, base * f AS w FROM r JOIN (VALUES " + ", ".join(f"('{g}', '{f}', {b}e0, {ADJUST[g].get(f, 1.0)}e0)" for g in ADJUST for f, b in FAMILIES.items()) + ") v(kind, family, base, f) ON kind = regime) SELECT period, regime, family, round(w / sum(w) OVER (PARTITION BY period), 9) AS weight FROM w", "v_launches")
def regime_weights(t):
    """The regime of each period by its graduation rate, and the family weights renormalised for it."""
    grown = F.when((F.col("token_key") % 5 == 0) & (F.col("token_key") % 31 == 0), 1.0).otherwise(0.0)
    rates = t("v_launches").groupBy(F.floor(F.col("created_at") / 200).alias("period")).agg(F.avg(grown).alias("rate"))
    factor = {f: F.when(F.col("regime") == "hot", ADJUST["hot"].get(f, 1.0)).when(F.col("regime") == "dead", ADJUST["dead"].get(f, 1.0)).otherwise(1.0) * b for f, b in FAMILIES.items()}
    total = sum(factor.values(), F.lit(0.0))
    per = F.array(*[F.struct(F.lit(f).alias("family"), F.round(w / total, 9).alias("weight")) for f, w in factor.items()])
    return rates.select("period", _label(F.col("rate")).alias("regime")).select("period", "regime", F.inline(per))


# In the engine's order; a reason met twice counts once.
_VETO_SQL = (
    ("mint_revoked = false", "mint_authority_live"), ("freeze_revoked = false", "freeze_authority_live"), ("transfer_fee_bps > 0", "transfer_tax_present"), ("lp_burned < 0.5 AND graduated", "lp_not_burned"),
    (f"top10 > CASE WHEN graduated THEN {TOP10} ELSE least(0.90, {TOP10} + 0.30) END", "holder_concentration_extreme"), (f"insider > {INSIDER}", "insider_supply_excessive"), (f"bundled > {BUNDLE}", "bundle_supply_excessive"), ("dev_sold", "dev_already_sold"),
    ("rugs >= 1", "deployer_prior_rugs"), (f"bundled >= {DEV_BUNDLE} OR (bundled >= 0.20 AND insider >= 0.20)", "dev_bundler_sybil"), ("twins > 0", "copycat_honeypot"), ("washed", "wash_trading_detected"), ("progress > 0.85", "curve_stage_out_of_bounds"),
    (f"template >= {TEMPLATE} AND template_confidence NOT IN ('missing', 'low')", "social_engagement_inauthentic"), ("depth < 1.0 OR liquidity < 8000", "liquidity_below_floor"), ("age < 60", "age_below_floor"), ("holder_count < 85 OR (age >= 300 AND holder_count < 120) OR (age >= 600 AND holder_count < 200)", "holders_too_low_for_age"),
)
_WASH = "SELECT token_key, sum(n) >= 6 AND (sum(CASE WHEN j <= 2 THEN x ELSE 0e0 END) / sum(x) >= 0.75 OR (2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1e0) / count(*) >= 0.9 AND count(*) > 3)) AS washed FROM (SELECT *, row_number() OVER (PARTITION BY token_key ORDER BY x, wallet) AS i, row_number() OVER (PARTITION BY token_key ORDER BY x DESC, wallet DESC) AS j FROM (SELECT token_key, wallet, sum(amount_native) AS x, count(*) AS n FROM v_trades GROUP BY token_key, wallet) a) b GROUP BY token_key"
_RUGS = "SELECT l.token_key, count(o.token_key) AS rugs FROM v_launches l LEFT JOIN v_outcomes o ON o.deployer = l.deployer AND o.labeled_at < l.created_at AND o.rugged AND o.token_key <> l.token_key GROUP BY l.token_key"
_TWINS = "SELECT token_key, row_number() OVER (PARTITION BY symbol, name ORDER BY created_at, token_key) - 1 AS twins FROM v_launches"


@key(f""", x AS (SELECT s.*, rugs, twins, coalesce(washed, false) AS washed FROM v_security s LEFT JOIN ({_RUGS}) r ON r.token_key = s.token_key LEFT JOIN ({_TWINS}) c ON c.token_key = s.token_key LEFT JOIN ({_WASH}) w ON w.token_key = s.token_key)
SELECT token_key, CASE WHEN halted THEN 'kill_switch' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _VETO_SQL)}], lambda v: v IS NOT NULL), ',') END AS vetoes FROM x""", "v_security", "v_outcomes")
def veto_set(t):
    """All hard refusals of each token, in order; a halted engine gives that alone."""
    t = written(t, v_trades="token_key wallet side amount_token amount_native as_of observed_at", v_launches="token_key symbol name deployer price created_at")
    trades = t("v_trades").groupBy("token_key", "wallet").agg(F.sum("amount_native").alias("x"), F.count("*").alias("n"))
    up = Window.partitionBy("token_key").orderBy("x", "wallet")
    sizes = trades.withColumn("i", F.row_number().over(up)).withColumn("k", F.count("*").over(Window.partitionBy("token_key")))
    wash = sizes.groupBy("token_key").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("x").alias("all"), F.sum(F.when(F.col("i") > F.col("k") - 2, F.col("x")).otherwise(0.0)).alias("top2"), F.sum(F.col("i") * F.col("x")).alias("ix"))
    gini = 2 * F.col("ix") / (F.col("k") * F.col("all")) - (F.col("k") + 1.0) / F.col("k")
    wash = wash.select("token_key", ((F.col("n") >= 6) & ((F.col("top2") / F.col("all") >= 0.75) | ((gini >= 0.9) & (F.col("k") > 3)))).alias("washed"))
    rugs = prior_counts(t("v_launches").select("token_key", "deployer", "created_at"), t("v_outcomes"), "deployer", "created_at", "labeled_at", rugs=F.col("rugged").cast("int")).select("token_key", "rugs")
    twins = t("v_launches").select("token_key", (F.row_number().over(Window.partitionBy("symbol", "name").orderBy("created_at", "token_key")) - 1).alias("twins"))
    x = t("v_security").join(rugs, "token_key", "left").join(twins, "token_key", "left").join(wash, "token_key", "left")
    c = F.col
    young = F.when(c("graduated"), TOP10).otherwise(round(min(0.90, TOP10 + 0.30), 9))  # 0.85, which the sum of doubles is not
    few = (c("holder_count") < 85) | ((c("age") >= 300) & (c("holder_count") < 120)) | ((c("age") >= 600) & (c("holder_count") < 200))
    rules = [
        (~c("mint_revoked"), "mint_authority_live"), (~c("freeze_revoked"), "freeze_authority_live"), (c("transfer_fee_bps") > 0, "transfer_tax_present"), ((c("lp_burned") < 0.5) & c("graduated"), "lp_not_burned"),
        (c("top10") > young, "holder_concentration_extreme"), (c("insider") > INSIDER, "insider_supply_excessive"), (c("bundled") > BUNDLE, "bundle_supply_excessive"), (c("dev_sold"), "dev_already_sold"),
        (c("rugs") >= 1, "deployer_prior_rugs"), ((c("bundled") >= DEV_BUNDLE) | ((c("bundled") >= 0.20) & (c("insider") >= 0.20)), "dev_bundler_sybil"), (c("twins") > 0, "copycat_honeypot"), (c("washed"), "wash_trading_detected"), (c("progress") > 0.85, "curve_stage_out_of_bounds"),
        ((c("template") >= TEMPLATE) & ~c("template_confidence").isin("missing", "low"), "social_engagement_inauthentic"), (c("depth") < 1.0, "liquidity_below_floor"), (c("liquidity") < 8000, "liquidity_below_floor"), (c("age") < 60, "age_below_floor"), (few, "holders_too_low_for_age"),
    ]
    found = F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(when, name) for when, name in rules]))), ",")
    return x.select("token_key", F.when(c("halted"), "kill_switch").otherwise(found).alias("vetoes"))


@key(f", t AS ({_TWINS}) SELECT token_key, twins FROM t WHERE twins > 0", "v_launches")
def copycat(t):
    """Tokens whose symbol and name an earlier launch has, with the number of those."""
    earlier = F.row_number().over(Window.partitionBy("symbol", "name").orderBy("created_at", "token_key")) - 1
    return t("v_launches").select("token_key", earlier.cast("long").alias("twins")).filter("twins > 0")


def composites(t) -> DataFrame:
    """(token_key, composite, coverage): the two-level score, by sums within families and then over them."""
    weight = F.when(F.col("metric_id") == "purchase", 1.5).when(F.col("metric_id") == "view", 0.05).otherwise(1.0)
    trust = F.when(F.col("confidence").isin("verified", "high"), 1.0).when(F.col("confidence") == "medium", 0.7).when(F.col("confidence") == "low", 0.35).otherwise(0.0)
    usable = F.col("normalized").isNotNull() & ~F.col("confidence").isin("missing", "stale")
    rows = t("v_scores").withColumn("w", F.when(usable, weight * trust))
    by = rows.groupBy("token_key", "family").agg(F.count("*").alias("n"), F.count("w").alias("k"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("normalized")).alias("x"))
    budget = F.when(F.col("family").isin("topology", "execution"), 0.45).otherwise(0.1)
    live = F.col("w") > 0
    g = by.groupBy("token_key").agg(F.sum(F.when(live, budget * F.col("x") / F.col("w"))).alias("s"), F.sum(F.when(live, budget)).alias("b"), F.sum(F.when(live, F.col("k")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
    return g.filter("b IS NOT NULL").select("token_key", (F.col("s") / F.col("b")).alias("composite"), (F.col("k") / F.col("n")).alias("coverage"))


@key(f"SELECT token_key, CASE WHEN token_key % 9 = 0 THEN 'vetoed' WHEN coverage < {MIN_COVERAGE} THEN 'thin' WHEN composite >= {ENTER} THEN 'enter' WHEN composite < {EXIT} THEN 'exit' ELSE 'hold' END AS decision FROM ({_COMPOSITE}) c", "v_scores")
def entry_gate(t):
    vetoed = F.col("token_key") % 9 == 0
    return composites(t).select("token_key", F.when(vetoed, "vetoed").when(F.col("coverage") < MIN_COVERAGE, "thin").when(F.col("composite") >= ENTER, "enter").when(F.col("composite") < EXIT, "exit").otherwise("hold").alias("decision"))


@key(f"SELECT token_key, CASE WHEN token_key % 9 = 0 THEN 'vetoed' WHEN coverage < 0.4 THEN 'thin evidence' WHEN composite >= 0.75 THEN 'strong' WHEN composite >= 0.6 THEN 'good' WHEN composite >= 0.45 THEN 'mixed' ELSE 'weak' END AS band FROM ({_COMPOSITE}) c", "v_scores")
def verdict_band(t):
    c = F.col("composite")
    return composites(t).select("token_key", F.when(F.col("token_key") % 9 == 0, "vetoed").when(F.col("coverage") < 0.4, "thin evidence").when(c >= 0.75, "strong").when(c >= 0.6, "good").when(c >= 0.45, "mixed").otherwise("weak").alias("band"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY token_key, metric_id ORDER BY as_of DESC, event_id DESC) AS i FROM v_scores"


@key(f""", l AS (SELECT token_key, metric_id, normalized, normalized IS NOT NULL AND confidence NOT IN ('missing', 'stale') AS usable FROM ({_LAST}) q WHERE i = 1), u AS (SELECT *, row_number() OVER (PARTITION BY token_key ORDER BY normalized DESC, metric_id) AS up, row_number() OVER (PARTITION BY token_key ORDER BY normalized, metric_id) AS down FROM l WHERE usable),
p AS (SELECT token_key, string_agg(metric_id || ' ' || CAST(CAST(round(normalized * 100, 0) AS BIGINT) AS VARCHAR), '; ' ORDER BY up) FILTER (WHERE up <= 6) AS top, string_agg('weak: ' || metric_id, '; ' ORDER BY down) FILTER (WHERE down <= 2 AND normalized < 0.35) AS weak FROM u GROUP BY token_key), m AS (SELECT token_key, count(*) FILTER (WHERE NOT usable) AS missing FROM l GROUP BY token_key)
SELECT m.token_key, concat_ws('; ', top, weak, CASE WHEN missing > 0 THEN CAST(missing AS VARCHAR) || ' metrics unavailable' END) AS text FROM m LEFT JOIN p ON p.token_key = m.token_key""", "v_scores")
def explain(t):
    """The strongest six readings of a token in order, its two weakest under 0.35, and how many are missing."""
    last = F.max(F.struct("as_of", "event_id", "normalized", "confidence"))
    rows = t("v_scores").groupBy("token_key", "metric_id").agg(last.alias("x")).select("token_key", "metric_id", "x.normalized", (F.col("x.normalized").isNotNull() & ~F.col("x.confidence").isin("missing", "stale")).alias("usable"))
    item = F.when(F.col("usable"), F.struct((-F.col("normalized")).alias("neg"), "metric_id", "normalized"))
    low = F.when(F.col("usable") & (F.col("normalized") < 0.35), F.struct("normalized", "metric_id"))
    g = rows.groupBy("token_key").agg(F.array_sort(F.collect_list(item)).alias("all"), F.array_sort(F.collect_list(low)).alias("low"), F.sum(F.when(F.col("usable"), 0).otherwise(1)).alias("missing"))
    top = F.array_join(F.transform(F.slice("all", 1, 6), lambda x: F.concat(x["metric_id"], F.lit(" "), F.round(x["normalized"] * 100, 0).cast("long").cast("string"))), "; ")
    weak = F.array_join(F.transform(F.slice("low", 1, 2), lambda x: F.concat(F.lit("weak: "), x["metric_id"])), "; ")
    gone = F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" metrics unavailable")))
    return g.select("token_key", F.concat_ws("; ", F.when(top != "", top), F.when(weak != "", weak), gone).alias("text"))


@key("SELECT token_key, count(DISTINCT author) AS accounts FROM v_social WHERE followers >= 2000 AND as_of - created_at <= 2400 GROUP BY token_key HAVING count(DISTINCT author) >= 4", "v_social")
def social_spike(t):
    """Tokens that four accounts with 2,000 followers or more name early."""
    rows = t("v_social").filter("followers >= 2000 AND as_of - created_at <= 2400")
    return rows.groupBy("token_key").agg(F.countDistinct("author").alias("accounts")).filter("accounts >= 4")


@key("SELECT p.wallet, round(least(p.size * 0.05e0, CASE WHEN p.wallet % 3 = 0 THEN p25 WHEN p.wallet % 3 = 1 THEN p50 ELSE p75 END), 6) AS tip FROM (SELECT wallet, avg(amount_token) AS size FROM v_trades GROUP BY wallet) p CROSS JOIN (SELECT quantile_cont(fee, 0.25) AS p25, quantile_cont(fee, 0.5) AS p50, quantile_cont(fee, 0.75) AS p75 FROM v_trades) q", "v_trades")
def tip_tier(t):
    """A tip by tier of the fees paid (quartiles), at most a twentieth of the size."""
    fees = t("v_trades").agg(F.percentile("fee", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    sizes = t("v_trades").groupBy("wallet").agg(F.avg("amount_token").alias("size"))
    return sizes.crossJoin(F.broadcast(fees)).select("wallet", F.round(F.least(F.col("size") * 0.05, F.element_at("q", (F.col("wallet") % 3 + 1).cast("int"))), 6).alias("tip"))


@key()
def risk_entry(t):
    from ..operators.portfolio import risk_entries

    orders = t("v_snapshots").select((F.floor(F.col("token_key") / 8)).cast("long").alias("account"), "token_key", "event_id", "as_of", F.col("price").alias("size"), (F.col("event_id") % 101 / 100).alias("score"), "liquidity", (F.col("event_id") % 9000).cast("double").alias("age"), (F.col("price") - 50).alias("pnl"))
    return risk_entries(orders)


@key()
def exit_policy(t):
    from ..operators.portfolio import exits

    return exits(t("v_snapshots").select("token_key", "event_id", "as_of", "price", (F.col("liquidity") * 100).alias("liquidity"), (F.col("liquidity") * 400).alias("market_cap")))


@key()
def backtest_replay(t):
    """Each account's marks in time order: marks update, exits sell, scores admit entries; what is left is valued at its last mark."""
    from ..operators.portfolio import replay

    rows = t("v_snapshots").select((F.floor(F.col("token_key") / 8)).cast("long").alias("account"), "token_key", "event_id", "as_of", "price", (F.col("liquidity") * 100).alias("liquidity"), (F.col("event_id") % 101 / 100).alias("score"))
    return replay(rows)
