"""Domain views over the driver's tables, once for Spark and once as DuckDB CTEs.

One day of order data counts as one second, counted from 1995-01-01; event times are
whole seconds from 2024-01-01. ``as_of`` is event time and ``observed_at`` knowledge time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

#: Templates; {day:x} is days since 1995-01-01, {sec:x} whole seconds since 2024-01-01.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_trades": ((), """
        SELECT l_partkey AS token_key, o_custkey AS wallet, CAST(l_linenumber AS BIGINT) AS slot, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
               l_quantity AS amount_token, l_extendedprice AS amount_native, l_tax AS fee, CAST({day:o_orderdate} AS BIGINT) AS as_of,
               CAST(greatest({day:o_orderdate}, {day:l_shipdate}) AS BIGINT) AS observed_at, l_orderkey AS order_id, l_suppkey AS supp_id, l_discount AS discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "v_launches": (("v_trades",), """
        SELECT p_partkey AS token_key, p_brand AS symbol, p_name AS name, p_type AS launchpad, p_partkey % 100 AS deployer, CAST(p_size AS BIGINT) AS size, p_retailprice AS price,
               f.created_at, f.created_at + p_partkey % 7 AS observed_at
        FROM part JOIN (SELECT token_key, min(as_of) AS created_at FROM v_trades GROUP BY token_key) f ON p_partkey = f.token_key"""),
    "v_snapshots": ((), """
        SELECT user_id AS token_key, event_id, {sec:ts} AS as_of, {sec:ts} + (event_id % 5) * 60 AS observed_at, event_type AS source, value AS price,
               value * (1 + event_id % 9) AS liquidity, CAST(event_id % 101 AS DOUBLE) / 100 AS progress, props
        FROM events"""),
    "v_holders": (("v_trades",), """
        SELECT b.token_key, b.wallet, b.balance, b.balance / t.total AS share, c_nationkey AS funded_by, c_mktsegment AS label, b.bought, b.sold, b.first_as_of
        FROM (SELECT token_key, wallet, sum(CASE WHEN side = 'buy' THEN amount_token ELSE -amount_token END) AS balance, sum(CASE WHEN side = 'buy' THEN amount_token ELSE 0.0 END) AS bought,
                     sum(CASE WHEN side = 'sell' THEN amount_token ELSE 0.0 END) AS sold, min(as_of) AS first_as_of FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500 GROUP BY token_key, wallet) b
        JOIN (SELECT token_key, sum(balance) AS total FROM (SELECT token_key, wallet, sum(CASE WHEN side = 'buy' THEN amount_token ELSE -amount_token END) AS balance
              FROM v_trades WHERE as_of <= 1500 AND observed_at <= 1500 GROUP BY token_key, wallet) x WHERE balance > 0 GROUP BY token_key) t ON b.token_key = t.token_key
        JOIN customer ON c_custkey = b.wallet WHERE b.balance > 0"""),
    "v_posts": ((), """
        SELECT doc_id AS post_id, source AS author, lang, text, n_chars, doc_id % 50 AS token_key, doc_id * 60 AS as_of, CASE WHEN doc_id % 3 = 0 THEN doc_id - 1 END AS parent_id,
               doc_id % 5 = 0 AS is_repost, doc_id % 97 AS likes, doc_id % 13 AS replies, doc_id % 7 AS reposts, doc_id % 5 AS quotes, doc_id % 11 AS bookmarks FROM documents"""),
    "v_ascii": (("v_posts",), "SELECT * FROM v_posts WHERE {ascii:text}"),
    "v_chat": ((), """
        SELECT 'gm @u' || CAST(user_id AS VARCHAR(20)) || ' $' || upper(event_type) || ' to ' || CAST(event_id % 100 AS VARCHAR(20)) || 'x https://e.co/' || CAST(event_id AS VARCHAR(20)) || CASE WHEN event_id % 4 = 0 THEN ' #moon' ELSE '' END AS text,
               event_id AS post_id, user_id AS author, {sec:ts} AS as_of, event_type AS symbol FROM events"""),
    "v_talk": ((), """
        SELECT CASE event_id % 6 WHEN 0 THEN 'gm @u' || CAST(user_id AS VARCHAR(20)) || ' to the moon, lfg! don''t miss the next 100x' WHEN 1 THEN 'i bought at ' || CAST(event_id % 90 AS VARCHAR(20)) || 'k, my entry was late but still holding because the chart looking fine and holders grow, average ' || event_type
               WHEN 2 THEN 'wagmi wagmi lfg gem found https://e.co/' || CAST(event_id AS VARCHAR(20)) WHEN 3 THEN 'took profit on ' || event_type || ' and cut my position by ' || CAST(event_id % 70 AS VARCHAR(20)) || ' percent after the ' || CAST(event_id % 9 AS VARCHAR(20)) || ' day move'
               WHEN 4 THEN upper(event_type) || ' buy now, last chance $' || upper(event_type) || ' #gem' ELSE 'what does ' || event_type || ' do that ' || CAST(props AS VARCHAR(200)) || ' does not, and who funds the team behind ' || CAST(event_id % 31 AS VARCHAR(20)) END AS text,
               event_id AS post_id, user_id AS author, event_id % 40 AS token_key, {sec:ts} AS as_of, event_type AS symbol FROM events"""),
    "v_social": (("v_talk",), """
        SELECT * FROM (SELECT post_id, token_key, author, text, CAST(floor(as_of / 240) AS BIGINT) AS as_of, CAST(token_key * 97 % 6000 AS BIGINT) AS created_at, 9000 - CAST(token_key * 97 % 6000 AS BIGINT) AS age,
               CASE post_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'x' WHEN 2 THEN 'telegram' WHEN 3 THEN 'reddit' ELSE 'tiktok' END AS platform, post_id % 3 = 0 AS is_reply, post_id % 7 = 0 AS is_repost, post_id % 4 = 1 AS has_media,
               author % 23 = 0 AS is_team, post_id % 97 AS likes, post_id % 13 AS replies, post_id % 9 AS reposts, post_id % 5 AS quotes, post_id % 11 AS bookmarks, symbol,
               CASE WHEN author % 11 = 0 THEN NULL ELSE author * 7919 % 90000 END AS followers, author * 31 % 4000 AS fast_followers, CASE WHEN author % 9 = 0 THEN NULL ELSE author * 104729 % 3000 END AS account_days, author * 13 % 40 AS post_count
               FROM v_talk) v WHERE as_of >= created_at AND as_of <= 9000"""),
    "v_security": (("v_launches", "v_holders"), """
        SELECT l.token_key, l.deployer, l.symbol, l.name, l.created_at, 1500 - l.created_at AS age, CASE WHEN l.token_key % 13 = 0 THEN false WHEN l.token_key % 7 = 0 THEN NULL ELSE true END AS mint_revoked, CASE WHEN l.token_key % 17 = 0 THEN false ELSE true END AS freeze_revoked,
               CASE WHEN l.token_key % 19 = 0 THEN 50 ELSE 0 END AS transfer_fee_bps, CASE WHEN l.token_key % 4 = 0 THEN CAST(l.token_key % 10 AS DOUBLE) / 10 END AS lp_burned, l.token_key % 5 = 0 AS graduated, l.token_key % 23 = 0 AS dev_sold, l.token_key % 997 = 0 AS halted,
               h.top10, h.insider, h.bundled, l.price * 10 AS liquidity, 60 + l.token_key % 200 AS holder_count, CAST(l.token_key % 50 AS DOUBLE) / 50 AS template, CASE WHEN l.token_key % 3 = 0 THEN 'low' ELSE 'high' END AS template_confidence, CAST(l.token_key % 100 AS DOUBLE) / 100 AS progress, l.token_key % 11 + 0.5e0 AS depth
        FROM v_launches l LEFT JOIN (SELECT token_key, sum(CASE WHEN i <= 2 THEN share ELSE 0e0 END) AS top10, sum(CASE WHEN label = 'BUILDING' THEN share ELSE 0e0 END) AS insider, sum(CASE WHEN label = 'FURNITURE' THEN share ELSE 0e0 END) AS bundled
          FROM (SELECT token_key, share, label, row_number() OVER (PARTITION BY token_key ORDER BY share DESC, wallet) AS i FROM v_holders) r GROUP BY token_key) h ON h.token_key = l.token_key"""),
    "v_outcomes": (("v_launches",), """
        SELECT token_key, deployer, created_at, created_at + 300 + token_key % 11 AS labeled_at, token_key % 5 = 0 AS graduated, token_key % 3 = 0 AS rugged,
               CASE WHEN token_key % 7 = 0 THEN NULL ELSE CAST(token_key % 40 AS DOUBLE) / 8 END AS multiple, CASE WHEN token_key % 6 = 0 THEN NULL ELSE CAST(token_key % 29 AS DOUBLE) / 10 END AS realizable
        FROM v_launches WHERE token_key % 4 <> 3"""),
    "v_scores": (("v_snapshots",), """
        SELECT token_key, event_id, as_of, source AS metric_id, CASE WHEN source IN ('view', 'click') THEN 'social' WHEN source = 'error' THEN 'execution' ELSE 'topology' END AS family,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE least(1e0, price / 60e0 * (0.4e0 + 0.2e0 * (token_key % 10))) END AS normalized, CASE WHEN event_id % 17 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'stale' WHEN event_id % 5 = 0 THEN 'low' WHEN event_id % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence,
               price AS raw FROM v_snapshots"""),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _render(text: str, spark: bool) -> str:
    import re

    def one(m):
        kind, x = m[1], m[2]
        if kind == "day":
            return f"datediff({x}, DATE'1995-01-01')" if spark else f"date_diff('day', DATE '1995-01-01', CAST({x} AS DATE))"
        if kind == "sec":
            days = f"datediff({x}, DATE'2024-01-01')" if spark else f"date_diff('day', DATE '2024-01-01', CAST({x} AS DATE))"
            return f"(CAST({days} AS BIGINT) * 86400 + hour({x}) * 3600 + minute({x}) * 60 + CAST({'floor(second(' + x + '))' if not spark else 'second(' + x + ')'} AS BIGINT))"
        return f"{x} RLIKE '^[\\\\x20-\\\\x7e\\\\n]*$'" if spark else f"regexp_full_match({x}, '[\\x20-\\x7e\\n]*')"

    return re.sub(r"\{(\w+):(\w+)\}", one, text)


def needed(name: str) -> list[str]:
    """A view and the views it stands on, in order."""
    out: list[str] = []
    for dep in _VIEWS[name][0]:
        out += [x for x in needed(dep) if x not in out]
    return [*out, name]


def ctes(*names: str) -> str:
    """DuckDB's CTE list for views."""
    order: list[str] = []
    for n in names:
        order += [x for x in needed(n) if x not in order]
    return ", ".join(f"{n} AS ({_render(_VIEWS[n][1], False)})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str, over: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A table or domain view as a DataFrame; ``over`` gives what it stands on."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return bound(spark, sf_dir, _render(_VIEWS[name][1], True), over)


def bound(spark: SparkSession, sf_dir: str, sql: str, over: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A SQL text over tables and views, run by Spark."""
    over = over or partial(view, spark, sf_dir)
    frames = {t: over(t) for t in (*_TABLES, *_VIEWS) if _mentions(sql, t)}
    for t in frames:
        sql = _bind(sql, t)
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def _mentions(sql: str, table: str) -> bool:
    import re

    return re.search(rf"(?:FROM|JOIN) {table}\b", sql) is not None


def _bind(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {table}\b(?! AS)", rf"\1 {{{table}}}", sql)
