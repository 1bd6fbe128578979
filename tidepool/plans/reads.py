"""Scans, point-in-time reads and joins (survey sections A and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit
from .registry import key
from .texts import _SKEL, _skeletons

T = 1500  # the decision instant over order data
TE = 1_000_000  # over events


@key("SELECT token_key, symbol, name, launchpad, created_at FROM v_launches WHERE token_key = 42", "v_launches")
def launch_lookup(t):
    return t("v_launches").filter(F.col("token_key") == 42).select("token_key", "symbol", "name", "launchpad", "created_at")


@key("SELECT token_key, created_at FROM v_launches WHERE created_at >= 10 AND created_at < 60", "v_launches")
def launches_between(t):
    return t("v_launches").filter((F.col("created_at") >= 10) & (F.col("created_at") < 60)).select("token_key", "created_at").orderBy("created_at", "token_key")


@key("SELECT token_key, created_at FROM v_launches ORDER BY created_at DESC, token_key LIMIT 25", "v_launches")
def recent_launches(t):
    return t("v_launches").select("token_key", "created_at").orderBy(F.desc("created_at"), "token_key").limit(25)


@key("SELECT token_key, event_id, as_of, observed_at, price FROM v_snapshots WHERE as_of <= 1000000 AND observed_at <= 1000000 AND as_of >= 800000", "v_snapshots")
def snapshots_as_of(t):
    return pit.pit_filter(t("v_snapshots"), TE, 200_000).select("token_key", "event_id", "as_of", "observed_at", "price")


@key("SELECT token_key, wallet, side, amount_token, as_of, slot FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500", "v_trades")
def trades_as_of(t):
    return pit.pit_filter(t("v_trades"), T).select("token_key", "wallet", "side", "amount_token", "as_of", "slot")


@key(", s AS (SELECT * FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500), m AS (SELECT token_key, max(as_of) AS last FROM s GROUP BY token_key) SELECT s.token_key, wallet, as_of, amount_token FROM s JOIN m ON s.token_key = m.token_key AND as_of = last", "v_trades")
def holders_as_of(t):
    return pit.latest_slice(pit.pit_filter(t("v_trades"), T), ["token_key"]).select("token_key", "wallet", "as_of", "amount_token")


@key("SELECT token_key, as_of, event_id, price FROM v_snapshots WHERE as_of <= 1000000 AND observed_at <= 1000000 QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY as_of DESC, event_id DESC) = 1", "v_snapshots")
def security_as_of(t):
    return pit.latest_by(pit.pit_filter(t("v_snapshots"), TE), ["token_key"], ["as_of", "event_id"]).select("token_key", "as_of", "event_id", "price")


_VERSIONS = "SELECT token_key, source, as_of, observed_at, event_id, price FROM v_snapshots WHERE observed_at <= 1000000 {extra} QUALIFY row_number() OVER (PARTITION BY token_key, source ORDER BY observed_at DESC, event_id DESC) = 1"


def _versions(df):
    return pit.latest_by(df, ["token_key", "source"], ["observed_at", "event_id"]).select("token_key", "source", "as_of", "observed_at", "event_id", "price")


@key(f"SELECT * FROM ({_VERSIONS.format(extra='')}) WHERE as_of >= 200000 AND as_of <= 1000000", "v_snapshots")
def posts_as_of(t):
    return _versions(t("v_snapshots").filter(F.col("observed_at") <= TE)).filter(F.col("as_of").between(200_000, TE))


@key(_VERSIONS.format(extra=""), "v_snapshots")
def accounts_as_of(t):
    return _versions(t("v_snapshots").filter(F.col("observed_at") <= TE))


@key("SELECT token_key, metric_id, as_of, normalized, confidence FROM v_scores WHERE as_of <= 1000000 QUALIFY row_number() OVER (PARTITION BY token_key, metric_id ORDER BY as_of DESC, event_id DESC) = 1", "v_scores")
def metric_values_as_of(t):
    return pit.latest_by(t("v_scores").filter(F.col("as_of") <= TE), ["token_key", "metric_id"], ["as_of", "event_id"]).select("token_key", "metric_id", "as_of", "normalized", "confidence")


@key("SELECT token_key, event_id, as_of, normalized FROM v_scores WHERE metric_id = 'click' AND normalized IS NOT NULL ORDER BY as_of DESC, event_id DESC LIMIT 500", "v_scores")
def metric_history(t):
    rows = t("v_scores").filter("metric_id = 'click' AND normalized IS NOT NULL")
    return rows.select("token_key", "event_id", "as_of", "normalized").orderBy(F.desc("as_of"), F.desc("event_id")).limit(500)


def freshest(df, limit=None):
    out = pit.latest_by(df, ["token_key", "source"], ["observed_at", "event_id"]).select("token_key", "source", "event_id", "as_of", "price")
    return out if limit is None else out.orderBy(F.desc("as_of"), F.desc("event_id")).limit(limit)


_FRESH = "(SELECT token_key, source, event_id, as_of, price FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY token_key, source ORDER BY observed_at DESC, event_id DESC) = 1)"


@key(f"SELECT * FROM {_FRESH} ORDER BY as_of DESC, event_id DESC LIMIT 100", "v_snapshots")
def posts_freshest(t):
    return freshest(t("v_snapshots"), 100)


@key(f"SELECT * FROM {_FRESH} WHERE source = 'click' AND as_of >= 2000000 ORDER BY as_of DESC, event_id DESC LIMIT 50", "v_snapshots")
def posts_by_platform(t):
    return freshest(t("v_snapshots")).filter("source = 'click' AND as_of >= 2000000").orderBy(F.desc("as_of"), F.desc("event_id")).limit(50)


@key("SELECT post_id, author FROM v_posts WHERE contains(lower(text), 'the th')", "v_posts")
def posts_matching(t):
    return t("v_posts").filter(F.lower("text").contains("the th")).select("post_id", "author")


@key("SELECT author AS link, count(DISTINCT token_key) AS tokens, min(token_key) AS first_token FROM v_posts GROUP BY author", "v_posts")
def social_links(t):
    return t("v_posts").groupBy(F.col("author").alias("link")).agg(F.countDistinct("token_key").alias("tokens"), F.min("token_key").alias("first_token"))


def _decisions(t):
    return t("v_snapshots").select("token_key", F.col("event_id").alias("decision_id"), (F.col("as_of") + 777).alias("as_of"))


def _of_tokens(t):
    """Snapshots that have a token; SQL holds a null key equal to none."""
    return t("v_snapshots").filter("token_key IS NOT NULL").select("token_key", "as_of", "price", "event_id")


_DEC = ", d AS (SELECT token_key, event_id AS decision_id, as_of + 777 AS as_of FROM v_snapshots)"


@key(f"{_DEC} SELECT d.token_key, d.decision_id, d.as_of, s.as_of AS right_as_of, s.price AS right_price FROM d ASOF LEFT JOIN v_snapshots s ON d.token_key = s.token_key AND d.as_of >= s.as_of", "v_snapshots")
def asof_backward(t):
    return pit.asof_backward(_decisions(t), _of_tokens(t), ["token_key"], tie=["event_id"]).select("token_key", "decision_id", "as_of", "right_as_of", "right_price")


@key(f"{_DEC} SELECT d.token_key, d.decision_id, d.as_of, s.as_of AS right_as_of, s.price AS right_price FROM d ASOF LEFT JOIN v_snapshots s ON d.token_key = s.token_key AND d.as_of < s.as_of", "v_snapshots")
def asof_forward(t):
    return pit.asof_forward(_decisions(t), _of_tokens(t), ["token_key"], tie=["event_id"]).select("token_key", "decision_id", "as_of", "right_as_of", "right_price")


@key(f"{_DEC} SELECT d.token_key, d.decision_id, d.as_of, min_by(s.as_of, abs(s.as_of - d.as_of) * 2 + CASE WHEN s.as_of > d.as_of THEN 1 ELSE 0 END) AS right_as_of FROM d LEFT JOIN v_snapshots s ON d.token_key = s.token_key GROUP BY ALL", "v_snapshots")
def asof_nearest(t):
    return pit.asof_nearest(_decisions(t), t("v_snapshots").select("token_key", "as_of", "event_id"), ["token_key"], tie=["event_id"]).select("token_key", "decision_id", "as_of", "right_as_of")


@key("SELECT token_key, count(*) AS n, CAST(sum(slot) AS BIGINT) AS slots FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500 AND as_of >= 1500 - 600 GROUP BY token_key", "v_trades")
def trailing_window(t):
    return pit.pit_filter(t("v_trades"), T, 600).groupBy("token_key").agg(F.count("*").alias("n"), F.sum("slot").alias("slots"))


@key("SELECT count(*) FILTER (WHERE parent_id IS NOT NULL) AS replies, count(*) FILTER (WHERE parent_id IS NULL AND NOT is_repost) AS top_level, count(*) FILTER (WHERE lang = 'en') AS on_platform FROM v_posts", "v_posts")
def reply_split(t):
    return t("v_posts").agg(F.count_if(F.col("parent_id").isNotNull()).alias("replies"), F.count_if(F.col("parent_id").isNull() & ~F.col("is_repost")).alias("top_level"), F.count_if(F.col("lang") == "en").alias("on_platform"))


@key("SELECT token_key, max(event_id) AS event_id FROM v_snapshots WHERE source = 'signup' AND observed_at <= 1000000 AND (token_key, observed_at) IN (SELECT token_key, max(observed_at) FROM v_snapshots WHERE source = 'signup' AND observed_at <= 1000000 GROUP BY token_key) GROUP BY token_key", "v_snapshots")
def promoter_pick(t):
    rows = t("v_snapshots").filter((F.col("source") == "signup") & (F.col("observed_at") <= TE))
    return rows.groupBy("token_key").agg(F.max_by("event_id", F.struct("observed_at", "event_id")).alias("event_id"))


@key("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_roundtrip(t):
    from ..sources.export import roundtrip

    return roundtrip(t("nation"), "json")


@key("""SELECT p_partkey AS token_key, coalesce(nullif(regexp_extract(q, 'e\\.co/([0-9]+)', 1), ''), nullif(regexp_extract(q, '^([0-9]+)$', 1), ''), CAST(l.token_key AS VARCHAR)) AS resolved
 FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://e.co/' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE '$' || p_brand END AS q FROM part)
 LEFT JOIN (SELECT symbol, max_by(token_key, created_at * 1000000 + token_key) AS token_key FROM v_launches GROUP BY symbol) l ON l.symbol = substr(q, 2)""", "v_launches")
def resolve_query(t):
    q = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'https://e.co/' || p_partkey WHEN 1 THEN CAST(p_partkey AS STRING) ELSE '$' || p_brand END")
    asked = t("part").select("p_partkey", q.alias("q"))
    latest = t("v_launches").groupBy("symbol").agg(F.max_by("token_key", F.struct("created_at", "token_key")).alias("token_key"))
    url, key_ = F.regexp_extract("q", r"e\.co/([0-9]+)", 1), F.regexp_extract("q", "^([0-9]+)$", 1)
    joined = asked.join(latest, F.col("symbol") == F.expr("substring(q, 2)"), "left")
    return joined.select(F.col("p_partkey").alias("token_key"), F.coalesce(F.nullif(url, F.lit("")), F.nullif(key_, F.lit("")), F.col("token_key").cast("string")).alias("resolved"))


@key("SELECT source, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0 AND as_of >= 1000000 - 600000) AS reverts, min(event_id) AS next_id FROM v_snapshots WHERE as_of <= 1000000 GROUP BY source", "v_snapshots")
def signal_queue(t):
    rows = t("v_snapshots").filter(F.col("as_of") <= TE)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("event_id") % 2 == 0) & (F.col("as_of") >= TE - 600_000)).alias("reverts"), F.min("event_id").alias("next_id"))


@key("SELECT token_key, wallet, balance, bought, CASE WHEN bought > 0 THEN round(balance / bought, 6) END AS multiple, 1500 - first_as_of AS age FROM v_holders", "v_holders")
def open_positions(t):
    return t("v_holders").select("token_key", "wallet", "balance", "bought", F.when(F.col("bought") > 0, F.round(F.col("balance") / F.col("bought"), 6)).alias("multiple"), (T - F.col("first_as_of")).alias("age"))


# --- joins ---------------------------------------------------------------------------------


@key("SELECT l.deployer, count(*) AS launches, count(*) FILTER (WHERE graduated) AS graduated, count(*) FILTER (WHERE rugged) AS rugged, max(multiple) AS best FROM v_launches l LEFT JOIN v_outcomes o ON l.token_key = o.token_key AND o.labeled_at < 500 WHERE l.created_at < 500 GROUP BY l.deployer", "v_outcomes")
def deployer_history(t):
    known = t("v_outcomes").filter("labeled_at < 500").select("token_key", "graduated", "rugged", "multiple")
    rows = t("v_launches").filter("created_at < 500").join(known, "token_key", "left")
    return rows.groupBy("deployer").agg(F.count("*").alias("launches"), F.count_if("graduated").alias("graduated"), F.count_if("rugged").alias("rugged"), F.max("multiple").alias("best"))


@key("SELECT t.wallet, t.token_key, t.as_of, l.created_at, t.as_of - l.created_at AS after_launch FROM v_trades t LEFT JOIN v_launches l ON t.token_key = l.token_key WHERE t.as_of < 1500 AND t.observed_at <= 1500", "v_launches")
def wallet_trades_before(t):
    rows = t("v_trades").filter("as_of < 1500 AND observed_at <= 1500")
    return rows.join(t("v_launches").select("token_key", "created_at"), "token_key", "left").select("wallet", "token_key", "as_of", "created_at", (F.col("as_of") - F.col("created_at")).alias("after_launch"))


@key("SELECT l.token_key, l.created_at FROM v_launches l LEFT JOIN v_outcomes o ON l.token_key = o.token_key WHERE o.token_key IS NULL AND l.created_at < 400", "v_outcomes")
def label_pending(t):
    return t("v_launches").filter("created_at < 400").join(t("v_outcomes"), "token_key", "left_anti").select("token_key", "created_at")


@key("SELECT t.token_key, t.wallet, t.as_of, s.as_of AS right_as_of, s.event_id AS right_event_id FROM (SELECT token_key, wallet, as_of * 1000 AS as_of FROM v_trades WHERE side = 'buy') t JOIN v_snapshots s ON t.token_key = s.token_key AND s.as_of <= t.as_of AND t.as_of <= s.as_of + 3000", "v_trades", "v_snapshots")
def band_join(t):
    trades = t("v_trades").filter("side = 'buy'").select("token_key", "wallet", (F.col("as_of") * 1000).alias("as_of"))
    snaps = t("v_snapshots").select("token_key", "as_of", "event_id")
    return pit.band_join(trades, snaps, "token_key", 3000).select("token_key", "wallet", "as_of", "right_as_of", "right_event_id")


@key("SELECT wallet, count(*) AS n FROM v_trades WHERE wallet IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) GROUP BY wallet", "v_trades")
def wallet_semi(t):
    rich = t("customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("wallet"))
    return t("v_trades").join(rich, "wallet", "left_semi").groupBy("wallet").agg(F.count("*").alias("n"))


@key("SELECT c_custkey AS wallet, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT wallet, count(*) AS n FROM v_trades WHERE as_of < 900 AND observed_at <= 1200 GROUP BY wallet) p ON wallet = c_custkey", "v_trades")
def wallet_prior_counts(t):
    prior = t("v_trades").filter("as_of < 900 AND observed_at <= 1200").groupBy("wallet").agg(F.count("*").alias("n"))
    return t("customer").select(F.col("c_custkey").alias("wallet")).join(prior, "wallet", "left").select("wallet", F.coalesce("n", F.lit(0)).alias("n"))


@key("SELECT token_key, wallet FROM v_trades GROUP BY token_key, wallet HAVING bool_or(side = 'buy') AND bool_or(side = 'sell')", "v_trades")
def round_trippers(t):
    rows = t("v_trades").groupBy("token_key", "wallet").agg(F.bool_or(F.col("side") == "buy").alias("b"), F.bool_or(F.col("side") == "sell").alias("s"))
    return rows.filter("b AND s").select("token_key", "wallet")


@key(", d AS (SELECT token_key, funded_by, count(DISTINCT wallet) AS degree FROM v_holders GROUP BY ALL), n AS (SELECT token_key, count(*) AS total FROM v_holders GROUP BY ALL) SELECT d.token_key, d.funded_by, d.degree FROM d JOIN n ON d.token_key = n.token_key WHERE degree >= 2 AND CAST(degree AS DOUBLE) / total >= 0.08", "v_holders")
def funder_edges(t):
    from ..operators.graph import qualifying_funders

    return qualifying_funders(t("v_holders")).select("token_key", "funded_by", "degree")


@key("""WITH h AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (CAST(1 AS HUGEINT) << i) ELSE 0 END))::UHUGEINT AS h FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) <= 16""")
def hamming_pairs(t):
    from ..operators.similarity import hamming_pairs as pairs, sign_bits

    return pairs(t("embeddings").select("vec_id", sign_bits("embedding").alias("h")), "vec_id", "h", 16)


_GRAMS = "unnest(CASE WHEN len(t) > 0 THEN list_distinct(list_transform(range(1, greatest(len(t) - 2, 2)), lambda i: substr(t, i, 4))) ELSE [] END)"


@key(f"""WITH g AS (SELECT item_id, {_GRAMS} AS s FROM (SELECT item_id, {_SKEL} AS t FROM benchmark)),
p AS (SELECT conv_id, turn, {_GRAMS} AS s FROM (SELECT conv_id, turn, {_SKEL} AS t FROM conversations)),
gn AS (SELECT item_id, count(*) AS n FROM g GROUP BY ALL), pn AS (SELECT conv_id, turn, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT conv_id, turn, item_id, count(*) AS k FROM p JOIN g USING (s) GROUP BY ALL),
j AS (SELECT o.conv_id, o.turn, max(CAST(k AS DOUBLE) / (pn.n + gn.n - k)) AS best FROM o JOIN pn USING (conv_id, turn) JOIN gn USING (item_id) GROUP BY ALL)
SELECT c.conv_id, c.turn, round(CASE WHEN pn.n IS NULL THEN 0 ELSE 1 - coalesce(best, 0) END, 6) AS novelty FROM conversations c LEFT JOIN pn USING (conv_id, turn) LEFT JOIN j USING (conv_id, turn)""")
def novelty_vs_corpus(t):
    from ..operators.novelty import novelty

    skeletons = lambda rows, *ids: _skeletons(rows, *ids).withColumnRenamed("skel", "text")
    return novelty(skeletons(t("conversations"), "conv_id", "turn"), ["conv_id", "turn"], skeletons(t("benchmark"), "item_id"), "item_id").select("conv_id", "turn", F.round("novelty", 6).alias("novelty"))


@key("SELECT post_id, symbol, l.token_key FROM v_chat JOIN (SELECT DISTINCT token_key FROM v_launches) l ON CAST(regexp_extract(text, 'e\\.co/([0-9]+)', 1) AS BIGINT) = l.token_key", "v_chat", "v_launches")
def call_resolution(t):
    calls = t("v_chat").select("post_id", "symbol", F.regexp_extract("text", r"e\.co/([0-9]+)", 1).cast("long").alias("token_key"))
    return calls.join(t("v_launches").select("token_key"), "token_key", "left_semi").select("post_id", "symbol", "token_key")


@key("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
d AS (SELECT conv_id, turn, count(*) AS dl FROM w GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS al FROM d),
f AS (SELECT conv_id, turn, w, count(*) AS tf FROM w WHERE w IN ('the', 'and', 'ing') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM f GROUP BY ALL)
SELECT conv_id, turn, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM f JOIN df USING (w) JOIN d USING (conv_id, turn) CROSS JOIN st GROUP BY conv_id, turn""")
def memory_search(t):
    from ..operators.similarity import bm25

    return bm25(t("conversations"), ["conv_id", "turn"], "text", ["the", "and", "ing"]).select("conv_id", "turn", F.round("score", 6).alias("score"))
