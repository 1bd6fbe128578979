"""Signal metrics over posts, holders, trades and launches (survey section K), in DataFrame functions; their twins are SQL of their own.

A metric is a relation (token_key, raw, evidence): raw is null where inputs fall short of
its gate, never 0 for that. Decisions are taken at T for trades and at S for posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators.similarity import char_shingles, jaccard
from .registry import key, written
from .texts import _NORM, _SH, _SKEL, _STOP, _hits, _skeletons

T, AT = 1500, 9000
_SEEN = f"SELECT * FROM v_trades WHERE as_of <= {T} AND observed_at <= {T}"
_CL = "greatest(0e0, least(1e0, {}))"


def _wilson(k: str, n: str) -> str:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    return _CL.format(f"({k} / {n} + 1.9208e0 / {n} - 1.96e0 * sqrt(({k} / {n} * (1 - {k} / {n}) + 0.9604e0 / {n}) / {n})) / (1 + 3.8416e0 / {n})")


def _out(df: DataFrame, raw: Column, evidence: Column, digits: int = 6) -> DataFrame:
    return df.select("token_key", F.round(raw, digits).alias("raw"), evidence.cast("long").alias("evidence"))


def _sum(condition: Column, value=1) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


# --- posts -------------------------------------------------------------------------------

_TOKS = f"list_filter(regexp_extract_all(norm, '[a-z0-9'']+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))"
_TEXTED = f""", n AS (SELECT *, {_NORM.format('text')} AS norm FROM v_social), w AS (SELECT *, {_TOKS} AS toks FROM n),
e AS (SELECT *, least(1e0, ({_hits(X.SHILL, 'norm')}) / 3e0) AS shill, least(1e0, ({_hits(X.CONVICTION, 'norm')}) / 2e0) AS conviction,
 CASE WHEN len(toks) = 0 THEN 0e0 ELSE 0.5e0 * least(1e0, len(toks) / 25e0) + 0.3e0 * len(list_distinct(toks)) / len(toks) + 0.2e0 END AS effort FROM w)"""


def _texted(t) -> DataFrame:
    """Posts with shill and conviction densities and effort."""
    return t.once("texted", lambda: _measured(t))


def _measured(t) -> DataFrame:
    rows = t("v_social").withColumn("emoji", F.regexp_count("text", F.lit(X.EMOJI))).withColumn("norm", X.normalize("text"))
    return rows.withColumns({"shill": X.shill_density("norm"), "conviction": X.conviction_density("norm"), "effort": X.effort_score("norm", F.col("emoji"))})


@key()
def reply_template_ratio(t):
    """Share of a token's replies in a repeated template, exact or near; fewer than six replies are too few."""
    from ..operators.neardup import template_share

    found = template_share(_skeletons(t("v_social").filter("is_reply"), "token_key", "post_id"), "token_key", "post_id", "skel")
    return _out(found, F.when(F.col("n") >= 6, F.col("share")), F.col("n"))


@key(f"""{_TEXTED} SELECT token_key, round(CASE WHEN counted >= 3 AND cheap + costly > 0 THEN costly / (cheap + costly) END, 6) AS raw, counted AS evidence
FROM (SELECT token_key, sum(likes + 0.5e0 * reposts) AS cheap, sum(2e0 * quotes + 1.5e0 * bookmarks + replies + CASE WHEN is_reply THEN 2e0 * effort ELSE 0e0 END) AS costly,
 count(*) FILTER (WHERE likes + reposts + quotes + bookmarks + replies > 0) + count(*) FILTER (WHERE is_reply) AS counted FROM e WHERE platform = 'x' GROUP BY token_key)""", "v_social")
def engagement_depth_ratio(t):
    c = F.col
    costly = 2.0 * c("quotes") + 1.5 * c("bookmarks") + c("replies") + F.when(c("is_reply"), 2.0 * c("effort")).otherwise(0.0)
    counted = _sum(c("likes") + c("reposts") + c("quotes") + c("bookmarks") + c("replies") > 0) + _sum(c("is_reply"))
    g = _texted(t).filter("platform = 'x'").groupBy("token_key").agg(F.sum(c("likes") + 0.5 * c("reposts")).alias("cheap"), F.sum(costly).alias("costly"), counted.alias("counted"))
    return _out(g, F.when((c("counted") >= 3) & (c("cheap") + c("costly") > 0), c("costly") / (c("cheap") + c("costly"))), c("counted"))


@key(f""", b AS (SELECT token_key, floor(ln(1e0 + account_days) * 2) AS b, count(*) AS c FROM v_social WHERE account_days IS NOT NULL GROUP BY ALL), s AS (SELECT token_key, sum(c) AS n, max(c) AS top FROM b GROUP BY token_key)
SELECT token_key, round(CASE WHEN max(n) >= 8 THEN {_CL.format(f"{_CL.format('-sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) / n)) / ln(16e0)')} * (1 - 0.5e0 * max(top) / max(n))")} END, 6) AS raw, CAST(max(n) AS BIGINT) AS evidence FROM b JOIN s USING (token_key) GROUP BY token_key""", "v_social")
def engager_age_dispersion(t):
    b = t("v_social").filter("account_days IS NOT NULL").groupBy("token_key", F.floor(F.log1p("account_days") * 2).alias("b")).agg(F.count("*").alias("c"))
    # Entropy from sums alone: ln n - sum(c ln c) / n.
    g = b.groupBy("token_key").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum(F.col("c") * F.ln("c")).alias("x"))
    spread = S.clamp((F.ln("n") - F.col("x") / F.col("n")) / F.ln(F.lit(16.0)))
    return _out(g, F.when(F.col("n") >= 8, S.clamp(spread * (1 - 0.5 * F.col("top") / F.col("n")))), F.col("n"))


@key(f""", g AS (SELECT token_key, as_of - lag(as_of) OVER (PARTITION BY token_key ORDER BY as_of, post_id) AS gap FROM v_social WHERE is_reply), m AS (SELECT token_key, median(gap) AS m, count(*) AS k FROM g WHERE gap > 0 GROUP BY token_key),
a AS (SELECT token_key, count(*) AS n, avg(gap) AS mu, stddev_pop(gap) AS sd FROM g GROUP BY token_key), p AS (SELECT token_key, CASE WHEN max(k) < 4 THEN 0e0 ELSE avg(CASE WHEN abs(gap - m) <= 0.15e0 * m THEN 1e0 ELSE 0e0 END) END AS p FROM g JOIN m USING (token_key) WHERE gap > 0 GROUP BY token_key)
SELECT a.token_key, round(CASE WHEN n >= 8 THEN {_CL.format('(CASE WHEN sd + mu < 1e-12 THEN 0e0 ELSE (sd - mu) / (sd + mu) END + 1) / 2')} * (1 - coalesce(p, 0e0)) END, 6) AS raw, n AS evidence FROM a LEFT JOIN p USING (token_key)""", "v_social")
def reply_rhythm_naturalness(t):
    w = Window.partitionBy("token_key").orderBy("as_of", "post_id")
    g = t("v_social").filter("is_reply").select("token_key", (F.col("as_of") - F.lag("as_of").over(w)).alias("gap"))
    mid = g.filter("gap > 0").groupBy("token_key").agg(F.median("gap").alias("m"))
    near = F.when(F.abs(F.col("gap") - F.col("m")) <= 0.15 * F.col("m"), 1.0).otherwise(0.0)
    g = g.join(mid, "token_key", "left").groupBy("token_key").agg(F.count("*").alias("n"), F.avg("gap").alias("mu"), F.stddev_pop("gap").alias("sd"), _sum(F.col("gap") > 0).alias("k"), F.avg(F.when(F.col("gap") > 0, near)).alias("p"))
    burst = F.when(F.col("sd") + F.col("mu") < 1e-12, 0.0).otherwise((F.col("sd") - F.col("mu")) / (F.col("sd") + F.col("mu")))
    periodic = F.when(F.col("k") < 4, 0.0).otherwise(F.coalesce("p", F.lit(0.0)))
    return _out(g, F.when(F.col("n") >= 8, S.clamp((burst + 1) / 2) * (1 - periodic)), F.col("n"))


@key(f"SELECT token_key, round(CASE WHEN count(*) >= 4 THEN {_CL.format('1 - avg(abs(log10(greatest(1e-6, eng / greatest(1e0, 0.02e0 * pow(CAST(followers AS DOUBLE), 0.75e0)))))) / 1.5e0')} END, 6) AS raw, count(*) AS evidence FROM (SELECT *, likes + replies + reposts + quotes AS eng FROM v_social) q WHERE platform = 'x' AND followers >= 10 AND eng > 0 GROUP BY token_key", "v_social")
def follower_engagement_coherence(t):
    rows = t("v_social").withColumn("eng", F.col("likes") + F.col("replies") + F.col("reposts") + F.col("quotes")).filter("platform = 'x' AND followers >= 10 AND eng > 0")
    ratio = F.col("eng") / F.greatest(F.lit(1.0), 0.02 * F.pow("followers", F.lit(0.75)))
    g = rows.groupBy("token_key").agg(F.count("*").alias("n"), F.avg(F.abs(F.log10(F.greatest(ratio, F.lit(1e-6))))).alias("d"))
    return _out(g, F.when(F.col("n") >= 4, S.clamp(1 - F.col("d") / 1.5)), F.col("n"))


@key(f"{_TEXTED} SELECT token_key, round(CASE WHEN count(*) >= 8 THEN {_wilson('count(*) FILTER (WHERE conviction > 0.4 AND shill < 0.34)', 'count(*)')} END, 6) AS raw, count(*) AS evidence FROM e WHERE len(trim(text)) > 8 GROUP BY token_key", "v_social")
def conviction_language_share(t):
    g = _texted(t).filter(F.length(F.trim("text")) > 8).groupBy("token_key").agg(F.count("*").alias("n"), _sum((F.col("conviction") > 0.4) & (F.col("shill") < 0.34)).alias("hits"))
    return _out(g, F.when(F.col("n") >= 8, S.wilson("hits", "n")), F.col("n"))


@key(f""", c AS (SELECT *, least(greatest(age, 600), 3600) AS win FROM v_social), b AS (SELECT token_key, count(DISTINCT platform || ':' || author) AS a, bucket FROM (SELECT *, least(5, CAST(floor((as_of - {AT} + win) / (win / 6e0)) AS BIGINT)) AS bucket FROM c WHERE as_of >= {AT} - win) GROUP BY token_key, bucket),
h AS (SELECT token_key, sum(a) AS total, coalesce(sum(a) FILTER (WHERE bucket < 3), 0) AS h1, coalesce(sum(a) FILTER (WHERE bucket >= 3), 0) AS h2 FROM b GROUP BY token_key), p AS (SELECT token_key, count(*) AS posts FROM v_social GROUP BY token_key)
SELECT p.token_key, round(CASE WHEN posts < 10 OR coalesce(total, 0) < 8 THEN NULL WHEN h1 = 0 THEN CASE WHEN h2 > 0 THEN 1e0 END ELSE ln((h2 + 1e0) / (h1 + 1e0)) END, 6) AS raw, CAST(CASE WHEN posts < 10 THEN posts ELSE coalesce(total, 0) END AS BIGINT) AS evidence FROM p LEFT JOIN h USING (token_key)""", "v_social")
def social_velocity_acceleration(t):
    win = F.least(F.greatest("age", F.lit(600)), F.lit(3600))
    rows = t("v_social").withColumn("since", F.col("as_of") - AT + win).withColumn("bucket", F.when(F.col("since") >= 0, F.least(F.lit(5), F.floor(F.col("since") / (win / 6)))))
    g = rows.groupBy("token_key", "bucket").agg(F.count("*").alias("posts"), F.countDistinct("platform", "author").alias("a"))
    g = g.groupBy("token_key").agg(F.sum("posts").alias("posts"), _sum(F.col("bucket") < 3, F.col("a")).alias("h1"), _sum(F.col("bucket") >= 3, F.col("a")).alias("h2")).withColumn("total", F.col("h1") + F.col("h2"))
    raw = F.when((F.col("posts") < 10) | (F.col("total") < 8), None).when(F.col("h1") == 0, F.when(F.col("h2") > 0, 1.0)).otherwise(F.ln((F.col("h2") + 1.0) / (F.col("h1") + 1.0)))
    return _out(g, raw, F.when(F.col("posts") < 10, F.col("posts")).otherwise(F.col("total")))


_PROMOTER = ", p AS (SELECT token_key, author, followers, fast_followers, account_days, post_count FROM v_social WHERE platform = 'x' AND NOT is_repost QUALIFY row_number() OVER (PARTITION BY token_key ORDER BY as_of DESC, post_id DESC) = 1)"


def _promoter(t) -> DataFrame:
    """The author of a token's latest original post on X."""
    newest = F.max(F.struct("as_of", "post_id", "author", "followers", "fast_followers", "account_days", "post_count"))
    return t("v_social").filter("platform = 'x' AND NOT is_repost").groupBy("token_key").agg(newest.alias("p")).select("token_key", "p.*")


@key(f"{_PROMOTER} SELECT token_key, round(CASE WHEN followers > 0 THEN {_CL.format('fast_followers / CAST(followers AS DOUBLE)')} END, 6) AS raw, CAST(CASE WHEN followers > 0 THEN 1 ELSE 0 END AS BIGINT) AS evidence FROM p", "v_social")
def purchased_follower_signal(t):
    known = F.col("followers") > 0
    return _out(_promoter(t), F.when(known, S.clamp(F.col("fast_followers") / F.col("followers"))), F.when(known, 1).otherwise(0))


@key(f"""{_PROMOTER}, h AS (SELECT author, count(*) AS n, min(as_of) AS oldest FROM v_social WHERE platform = 'x' GROUP BY author)
SELECT token_key, round(CASE WHEN account_days >= 30 AND n >= 3 THEN {_CL.format(f'(oldest - {AT} + account_days * 86400e0) / (account_days * 86400e0)')} * {_CL.format('n / greatest(1e0, post_count)')} END, 6) AS raw, CASE WHEN account_days >= 30 THEN n ELSE 0 END AS evidence FROM p JOIN h USING (author)""", "v_social")
def identity_discontinuity(t):
    seen = t("v_social").filter("platform = 'x'").groupBy("author").agg(F.count("*").alias("n"), F.min("as_of").alias("oldest"))
    life = F.col("account_days") * 86400.0
    silent = S.clamp((F.col("oldest") - AT + life) / life)
    covered = S.clamp(F.col("n") / F.greatest(F.col("post_count"), F.lit(1)))
    old = F.col("account_days") >= 30
    return _out(_promoter(t).join(seen, "author"), F.when(old & (F.col("n") >= 3), silent * covered), F.when(old, F.col("n")).otherwise(0))


@key(f"""{_TEXTED}, m AS (SELECT token_key, count(*) AS media, count(DISTINCT platform || ':' || author) AS creators FROM e WHERE has_media AND NOT is_repost AND NOT is_reply AND NOT is_team AND NOT (shill > 0.66 AND effort < 0.2) GROUP BY token_key)
SELECT token_key, round(CASE WHEN max(age) < 60 THEN NULL WHEN max(media) IS NULL THEN 0e0 ELSE max(creators) / greatest(0.25e0, max(age) / 3600e0) END, 6) AS raw, CAST(CASE WHEN max(age) < 60 THEN 0 WHEN max(media) IS NULL THEN greatest(1, floor(count(*) / 10)) ELSE max(media) END AS BIGINT) AS evidence FROM v_social LEFT JOIN m USING (token_key) GROUP BY token_key""", "v_social")
def organic_media_production_rate(t):
    made = F.col("has_media") & ~F.col("is_repost") & ~F.col("is_reply") & ~F.col("is_team") & ~((F.col("shill") > 0.66) & (F.col("effort") < 0.2))
    g = _texted(t).groupBy("token_key").agg(F.count("*").alias("n"), F.first("age").alias("age"), _sum(made).alias("media"), F.countDistinct(F.when(made, F.concat_ws(":", "platform", "author"))).alias("creators"))
    raw = F.when(F.col("age") < 60, None).when(F.col("media") == 0, 0.0).otherwise(F.col("creators") / F.greatest(F.lit(0.25), F.col("age") / 3600))
    return _out(g, raw, F.when(F.col("age") < 60, 0).when(F.col("media") == 0, F.greatest(F.lit(1), F.floor(F.col("n") / 10))).otherwise(F.col("media")))


@key(f"""{_TEXTED}, o AS (SELECT token_key, min(as_of) AS first_at, count(DISTINCT platform || ':' || author) AS authors, count(DISTINCT platform) AS platforms FROM e WHERE platform IN ('reddit', 'tiktok') AND NOT is_team AND shill <= 0.66 GROUP BY token_key),
s AS (SELECT token_key, max(age) / 3600e0 AS hours, coalesce(min(as_of) FILTER (WHERE platform IN ('x', 'telegram')), max(created_at)) AS origin FROM v_social GROUP BY token_key)
SELECT s.token_key, round(CASE WHEN coalesce(authors, 0) < 2 THEN CASE WHEN hours < 0.25 THEN NULL ELSE -ln(1 + hours) END ELSE -ln(1 + greatest(0e0, (first_at - origin) / 3600e0)) + 0.35e0 * (platforms - 1) END, 6) AS raw,
 CASE WHEN coalesce(authors, 0) >= 2 OR hours < 0.25 THEN coalesce(authors, 0) ELSE greatest(1, coalesce(authors, 0)) END AS evidence FROM s LEFT JOIN o USING (token_key)""", "v_social")
def cross_platform_propagation_lag(t):
    team = F.col("platform").isin("x", "telegram")
    free = F.col("platform").isin("reddit", "tiktok") & ~F.col("is_team") & (F.col("shill") <= 0.66)
    who = F.countDistinct(F.when(free, F.concat_ws(":", "platform", "author")))
    g = _texted(t).groupBy("token_key").agg((F.first("age") / 3600).alias("hours"), F.coalesce(F.min(F.when(team, F.col("as_of"))), F.first("created_at")).alias("origin"), F.min(F.when(free, F.col("as_of"))).alias("first_at"), who.alias("authors"), F.countDistinct(F.when(free, F.col("platform"))).alias("platforms"))
    lag = -F.log1p(F.greatest(F.lit(0.0), (F.col("first_at") - F.col("origin")) / 3600)) + 0.35 * (F.col("platforms") - 1)
    early = F.col("hours") < 0.25
    raw = F.when(F.col("authors") >= 2, lag).when(~early, -F.log1p("hours"))
    return _out(g, raw, F.when((F.col("authors") >= 2) | early, F.col("authors")).otherwise(F.greatest(F.lit(1), F.col("authors"))))


@key(f"""{_TEXTED}, a AS (SELECT token_key, platform, author, count(DISTINCT upper(symbol)) FILTER (WHERE token_key % 5 <> length(symbol) % 5) AS others, avg(shill) AS shill, avg(effort) AS effort FROM e WHERE NOT is_team GROUP BY ALL)
SELECT token_key, round(CASE WHEN count(*) >= 6 THEN avg(CASE WHEN others >= 4 OR (shill > 0.6 AND effort < 0.25) THEN 0e0 ELSE 1e0 END) END, 6) AS raw, count(*) AS evidence FROM a GROUP BY token_key""", "v_social")
def unpaid_promoter_share(t):
    """A post names its ``symbol``; those with the length of the token's number modulo five are its own."""
    other = F.when(F.col("token_key") % 5 != F.length("symbol") % 5, F.upper("symbol"))
    a = _texted(t).filter("NOT is_team").groupBy("token_key", "platform", "author").agg(F.countDistinct(other).alias("others"), F.avg("shill").alias("shill"), F.avg("effort").alias("effort"))
    paid = (F.col("others") >= 4) | ((F.col("shill") > 0.6) & (F.col("effort") < 0.25))
    g = a.groupBy("token_key").agg(F.count("*").alias("n"), _sum(~paid).alias("free"))
    return _out(g, F.when(F.col("n") >= 6, F.col("free") / F.col("n")), F.col("n"))


_COPY = "'gem number ' || CAST(token_key AS VARCHAR(20)) || ' took profit and still holding, lfg'"


@key(f"""{_TEXTED}, d AS (SELECT token_key, effort, {_SH.replace('(s)', '(a)').replace('(s,', '(a,')} AS x, {_SH.replace('(s)', '(b)').replace('(s,', '(b,')} AS y FROM (SELECT token_key, effort, {_SKEL} AS a, {_SKEL.replace('(text)', f'({_COPY})')} AS b FROM e WHERE NOT is_team AND len(trim(text)) > 15))
SELECT token_key, round(CASE WHEN count(*) >= 8 THEN {_CL.format('avg(1 - CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y)))) * (0.5e0 + 0.5e0 * least(1e0, 2 * avg(effort)))')} END, 6) AS raw, count(*) AS evidence FROM d GROUP BY token_key""", "v_social")
def community_content_originality(t):
    rows = _texted(t).filter(~F.col("is_team") & (F.length(F.trim("text")) > 15))
    copy = rows.select("token_key").distinct().select("token_key", F.concat(F.lit("gem number "), F.col("token_key").cast("string"), F.lit(" took profit and still holding, lfg")).alias("text"))
    copy = _skeletons(copy, "token_key").select("token_key", char_shingles(F.col("skel")).alias("y"))
    texts = rows.select("token_key", "effort", X.skeletonize("norm").alias("skel")).join(copy, "token_key")
    g = texts.groupBy("token_key").agg(F.count("*").alias("n"), F.avg(1 - jaccard(char_shingles(F.col("skel")), F.col("y"))).alias("far"), F.avg("effort").alias("effort"))
    return _out(g, F.when(F.col("n") >= 8, S.clamp(F.col("far") * (0.5 + 0.5 * F.least(F.lit(1.0), 2 * F.col("effort"))))), F.col("n"))


# --- holders and trades ------------------------------------------------------------------


def _seen(t) -> DataFrame:
    return t("v_trades").filter(f"as_of <= {T} AND observed_at <= {T}")


def prior_counts(asks: DataFrame, events: DataFrame, by: str, at: str, when: str, **sums: Column) -> DataFrame:
    """``asks`` with sums over the earlier events (strictly before ``at``) of the same ``by``.

    A running sum over asks and events in time order, asks first at equal times: each row
    is read once, where a join would pair every ask with all earlier events.
    """
    own = asks.select(by, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.struct(*asks.columns).alias("_ask"), *[F.lit(None).cast("double").alias(n) for n in sums])
    past = events.select(by, F.col(when).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(own.schema["_ask"].dataType).alias("_ask"), *[v.cast("double").alias(n) for n, v in sums.items()])
    run = Window.partitionBy(by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = own.unionByName(past).withColumns({n: (F.max if n.startswith("max_") else F.sum)(n).over(run) for n in sums})
    return found.filter("_kind = 0").select("_ask.*", *[F.col(n) if n.startswith("max_") else F.coalesce(n, F.lit(0.0)).alias(n) for n in sums])


def _buyers(t) -> DataFrame:
    """(token_key, wallet, created_at, prior): buyers with their trades before the launch."""
    return t.once("buyers", lambda: _counted_buyers(t))


def _counted_buyers(t) -> DataFrame:
    buyers = _seen(t).filter("side = 'buy'").select("token_key", "wallet").distinct().join(t("v_launches").select("token_key", "created_at"), "token_key")
    return prior_counts(buyers, _seen(t), "wallet", "created_at", "as_of", prior=F.lit(1))


_PRIOR = f"SELECT t.token_key, t.wallet, count(p.wallet) AS prior FROM (SELECT DISTINCT v.token_key, v.wallet, l.created_at FROM ({_SEEN}) v JOIN v_launches l ON v.token_key = l.token_key WHERE side = 'buy') t LEFT JOIN ({_SEEN}) p ON p.wallet = t.wallet AND p.as_of < t.created_at GROUP BY t.token_key, t.wallet"
_TRADEABLE = "SELECT token_key, wallet, funded_by, CASE WHEN abs(total - 1) < 1e-6 THEN share ELSE least(1e0, share / total) END AS share FROM (SELECT *, sum(share) OVER (PARTITION BY token_key) AS total FROM v_holders WHERE share > 0 AND lower(label) <> 'machinery') z"


def _tradeable(t) -> DataFrame:
    """Holders whose supply can be sold, with renormalised shares."""
    kept = t("v_holders").filter("share > 0 AND lower(label) <> 'machinery'")
    total = F.sum("share").over(Window.partitionBy("token_key"))
    return kept.withColumn("total", total).select("token_key", "wallet", "funded_by", F.when(F.abs(F.col("total") - 1) < 1e-6, F.col("share")).otherwise(F.least(F.lit(1.0), F.col("share") / F.col("total"))).alias("share"))


@key(f"SELECT token_key, round(CASE WHEN count(*) >= 8 THEN sum({_CL.format('1 - ln(1e0 + prior) / ln(21e0)')}) / count(*) END, 6) AS raw, count(*) AS evidence FROM ({_PRIOR}) p GROUP BY token_key", "v_launches")
def fresh_wallet_ratio(t):
    g = _buyers(t).groupBy("token_key").agg(F.count("*").alias("n"), F.sum(S.clamp(1 - F.log1p("prior") / F.ln(F.lit(21.0)))).alias("fresh"))
    return _out(g, F.when(F.col("n") >= 8, F.col("fresh") / F.col("n")), F.col("n"))


@key(f""", b AS (SELECT v.token_key, v.wallet, v.as_of, v.order_id % 200 AS slot, l.created_at FROM ({_SEEN}) v JOIN v_launches l ON v.token_key = l.token_key WHERE side = 'buy'), f AS (SELECT token_key, min(slot) AS first_slot, count(*) AS n FROM b GROUP BY token_key),
s AS (SELECT DISTINCT b.token_key, b.wallet FROM b JOIN f USING (token_key) WHERE as_of <= created_at + 20 OR slot - first_slot <= 12)
SELECT f.token_key, round(CASE WHEN n >= 5 THEN coalesce(x, 0e0) END, 6) AS raw, n AS evidence FROM f LEFT JOIN (SELECT s.token_key, sum(coalesce(h.share, 0e0) * (0.4e0 + 0.6e0 * {_CL.format('ln(1e0 + prior) / ln(201e0)')})) AS x FROM s JOIN ({_PRIOR}) p ON p.token_key = s.token_key AND p.wallet = s.wallet LEFT JOIN ({_TRADEABLE}) h ON h.token_key = s.token_key AND h.wallet = s.wallet GROUP BY s.token_key) q ON q.token_key = f.token_key""", "v_launches", "v_holders")
def sniper_supply_share(t):
    t = written(t, v_trades="token_key wallet side amount_token as_of observed_at order_id", v_launches="token_key created_at")
    buys = _seen(t).filter("side = 'buy'").select("token_key", "wallet", "as_of", (F.col("order_id") % 200).alias("slot"))
    by_wallet = buys.groupBy("token_key", "wallet").agg(F.count("*").alias("k"), F.min("as_of").alias("first_at"), F.min("slot").alias("slot"))
    first = by_wallet.groupBy("token_key").agg(F.sum("k").alias("n"), F.min("slot").alias("first_slot"))
    early = by_wallet.join(first, "token_key").join(_buyers(t), ["token_key", "wallet"]).filter((F.col("first_at") <= F.col("created_at") + 20) | (F.col("slot") - F.col("first_slot") <= 12))
    weight = 0.4 + 0.6 * S.clamp(F.log1p("prior") / F.ln(F.lit(201.0)))
    held = early.join(_tradeable(t).select("token_key", "wallet", "share"), ["token_key", "wallet"]).groupBy("token_key").agg(F.sum(F.col("share") * weight).alias("x"))
    return _out(first.join(held, "token_key", "left"), F.when(F.col("n") >= 5, F.coalesce("x", F.lit(0.0))), F.col("n"))


_ROUND = " OR ".join(f"abs(amount_native / {b} - round(amount_native / {b}, 0)) < 1e-6" for b in ("0.1e0", "0.5e0", "1e0"))


@key(f""", b AS (SELECT *, discount >= 0.095 AS bundled FROM ({_SEEN}) v WHERE side = 'buy'), g AS (SELECT token_key, slot FROM b GROUP BY token_key, slot HAVING count(DISTINCT wallet) >= 3 AND ((max(amount_native) - min(amount_native)) / max(amount_native) < 0.15 OR avg(CASE WHEN {_ROUND} THEN 1e0 ELSE 0e0 END) > 0.6)),
w AS (SELECT DISTINCT b.token_key, b.wallet FROM b LEFT JOIN g ON g.token_key = b.token_key AND g.slot = b.slot WHERE g.slot IS NOT NULL OR bundled), n AS (SELECT token_key, count(*) AS n, sum(amount_native) AS total FROM b GROUP BY token_key),
x AS (SELECT w.token_key, sum(coalesce(h.share, 0e0)) AS share FROM w LEFT JOIN ({_TRADEABLE}) h ON h.token_key = w.token_key AND h.wallet = w.wallet GROUP BY w.token_key), y AS (SELECT b.token_key, sum(amount_native) AS part FROM b JOIN w ON w.token_key = b.token_key AND w.wallet = b.wallet GROUP BY b.token_key), k AS (SELECT DISTINCT token_key, 1 AS held FROM v_holders)
SELECT n.token_key, round(CASE WHEN n < 6 THEN NULL WHEN share IS NULL THEN 0e0 WHEN share = 0 AND held = 1 THEN part / total ELSE share END, 9) AS raw, n AS evidence FROM n LEFT JOIN x ON x.token_key = n.token_key LEFT JOIN y ON y.token_key = n.token_key LEFT JOIN k ON k.token_key = n.token_key""", "v_trades", "v_holders")
def bundle_supply_share(t):
    buys = _seen(t).filter("side = 'buy'")
    exact = lambda b: F.abs(F.col("amount_native") / b - F.round(F.col("amount_native") / b, 0)) < 1e-6
    round_ = F.when(exact(0.1) | exact(0.5) | exact(1.0), 1.0).otherwise(0.0)
    slots = buys.groupBy("token_key", "slot").agg(F.countDistinct("wallet").alias("k"), F.max("amount_native").alias("hi"), F.min("amount_native").alias("lo"), F.avg(round_).alias("round"))
    alike = slots.filter((F.col("k") >= 3) & (((F.col("hi") - F.col("lo")) / F.col("hi") < 0.15) | (F.col("round") > 0.6))).select("token_key", "slot", F.lit(True).alias("alike"))
    flagged = F.coalesce("alike", F.lit(False)) | (F.col("discount") >= 0.095)
    per = buys.join(alike, ["token_key", "slot"], "left").groupBy("token_key", "wallet").agg(F.count("*").alias("n"), F.sum("amount_native").alias("native"), F.max(flagged).alias("flagged"))
    per = per.join(_tradeable(t).select("token_key", "wallet", "share"), ["token_key", "wallet"], "left")
    g = per.groupBy("token_key").agg(F.sum("n").alias("n"), F.sum("native").alias("total"), _sum(F.col("flagged"), F.col("native")).alias("part"), F.sum(F.when(F.col("flagged"), F.coalesce("share", F.lit(0.0)))).alias("share"))
    g = g.join(t("v_holders").select("token_key", F.lit(True).alias("held")).distinct(), "token_key", "left")
    raw = F.when(F.col("n") < 6, None).when(F.col("share").isNull(), 0.0).when((F.col("share") == 0) & F.col("held"), F.col("part") / F.col("total")).otherwise(F.col("share"))
    return _out(g, raw, F.col("n"), 9)


_SKILL = f"""SELECT wallet, n, {_CL.format('0.5e0 + n / (n + 3e0) * (CASE WHEN r IS NULL THEN base ELSE 0.6e0 * base + 0.4e0 * r END - 0.5e0)')} AS skill FROM (SELECT wallet, count(*) AS n, avg(e) FILTER (WHERE mult >= 1.5) AS r, 0.5e0 * avg(CASE WHEN mult > 1 THEN 1e0 ELSE 0e0 END) + 0.5e0 * avg({_CL.format('(mult - 1) / 2 + 0.5e0')}) AS base
 FROM (SELECT v.token_key, wallet, sum(CASE WHEN side = 'sell' THEN amount_native ELSE 0e0 END) / sum(CASE WHEN side = 'buy' THEN amount_native ELSE 0e0 END) AS mult, greatest(0e0, 1 - greatest(0e0, min(CASE WHEN side = 'buy' THEN as_of END) - min(l.created_at)) / 3600e0) AS e
 FROM ({_SEEN}) v JOIN v_launches l ON l.token_key = v.token_key GROUP BY v.token_key, wallet HAVING min(side) <> max(side)) x GROUP BY wallet) y"""


def _skills(t) -> DataFrame:
    """(wallet, n, skill): won and how far, early on runners, shrunk towards a half by the number of closed tokens."""
    launched = t("v_launches").select("token_key", "created_at")
    money = lambda side: F.sum(F.when(F.col("side") == side, F.col("amount_native")).otherwise(0.0))
    first = F.min(F.when(F.col("side") == "buy", F.col("as_of")))
    per = _seen(t).groupBy("token_key", "wallet").agg(money("buy").alias("b"), money("sell").alias("s"), first.alias("first"), F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo <> hi").join(launched, "token_key")
    per = per.select("wallet", (F.col("s") / F.col("b")).alias("mult"), F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), (F.col("first") - F.col("created_at")).cast("double")) / 3600).alias("e"))
    base = 0.5 * F.avg(F.when(F.col("mult") > 1, 1.0).otherwise(0.0)) + 0.5 * F.avg(S.clamp((F.col("mult") - 1) / 2 + 0.5))
    g = per.groupBy("wallet").agg(F.count("*").alias("n"), base.alias("base"), F.avg(F.when(F.col("mult") >= 1.5, F.col("e"))).alias("r"))
    raw = F.when(F.col("r").isNull(), F.col("base")).otherwise(0.6 * F.col("base") + 0.4 * F.col("r"))
    return g.select("wallet", "n", S.clamp(0.5 + F.col("n") / (F.col("n") + 3.0) * (raw - 0.5)).alias("skill"))


@key(f"SELECT wallet, n, round(skill, 6) AS skill FROM ({_SKILL}) s", "v_launches")
def wallet_skill(t):
    return _skills(t).select("wallet", "n", F.round("skill", 6).alias("skill"))


@key(f"SELECT wallet, round(skill, 6) AS skill FROM ({_SKILL}) s WHERE n >= 1 ORDER BY round(skill, 6) DESC, wallet LIMIT 50", "v_launches")
def smart_money(t):
    return _skills(t).filter("n >= 1").select("wallet", F.round("skill", 6).alias("skill")).orderBy(F.desc("skill"), "wallet").limit(50)


@key(f""", b AS (SELECT token_key, wallet, sum(amount_native) AS native, count(*) AS n FROM ({_SEEN}) v WHERE side = 'buy' GROUP BY token_key, wallet), z AS (SELECT wallet, median(native) AS typical FROM b GROUP BY wallet), t AS (SELECT token_key, sum(native) AS total, sum(n) AS buys, count(*) AS wallets FROM b GROUP BY token_key)
SELECT t.token_key, round(CASE WHEN max(buys) >= 5 THEN sum(CASE WHEN skill > 0.5e0 THEN native / total * (skill - 0.5e0) * 2 * (0.3e0 + 0.7e0 * greatest(0e0, least(2e0, native / typical)) / 2) ELSE 0e0 END) END, 6) AS raw, CAST(CASE WHEN max(buys) >= 5 THEN max(wallets) ELSE max(buys) END AS BIGINT) AS evidence
FROM t JOIN b USING (token_key) LEFT JOIN ({_SKILL}) s ON s.wallet = b.wallet LEFT JOIN z ON z.wallet = b.wallet GROUP BY t.token_key""", "v_launches")
def smart_wallet_participation(t):
    buys = _seen(t).filter("side = 'buy'").groupBy("token_key", "wallet").agg(F.sum("amount_native").alias("native"), F.count("*").alias("n"))
    typical = buys.groupBy("wallet").agg(F.median("native").alias("typical"))
    rows = buys.join(_skills(t).select("wallet", "skill"), "wallet", "left").join(typical, "wallet")
    keen = F.when(F.col("skill") > 0.5, F.col("native") * (F.col("skill") - 0.5) * 2 * (0.3 + 0.7 * S.clamp(F.col("native") / F.col("typical"), 0.0, 2.0) / 2)).otherwise(0.0)
    g = rows.groupBy("token_key").agg(F.sum("n").alias("n"), F.count("*").alias("wallets"), (F.sum(keen) / F.sum("native")).alias("x"))
    return _out(g, F.when(F.col("n") >= 5, F.col("x")), F.when(F.col("n") >= 5, F.col("wallets")).otherwise(F.col("n")))


# The deployer and the holders whom its funder has funded.
_TEAM = "SELECT token_key, deployer AS wallet FROM v_launches UNION SELECT h.token_key, h.wallet FROM ({h}) h JOIN ({h}) d ON d.token_key = h.token_key AND d.funded_by = h.funded_by JOIN v_launches l ON l.token_key = d.token_key AND l.deployer = d.wallet"


def _team(t, holders: DataFrame) -> DataFrame:
    """(token_key, wallet) of the deployer and of its funder's other wallets among the holders."""
    own = t("v_launches").select("token_key", F.col("deployer").cast("long").alias("wallet"))
    funders = holders.join(own, ["token_key", "wallet"], "left_semi").select("token_key", "funded_by")
    return own.union(holders.join(funders, ["token_key", "funded_by"], "left_semi").select("token_key", F.col("wallet").cast("long"))).distinct()


@key(f""", c AS (SELECT DISTINCT v.token_key, v.wallet FROM ({_SEEN}) v JOIN v_launches l ON v.token_key = l.token_key WHERE side = 'buy' AND v.as_of <= l.created_at + 300 AND {T} - l.created_at >= 360), m AS ({_TEAM.format(h=_TRADEABLE)}),
a AS (SELECT token_key, count(*) AS n FROM c GROUP BY token_key), k AS (SELECT c.token_key, count(*) AS n, count(h.wallet) AS held FROM c LEFT JOIN m ON m.token_key = c.token_key AND m.wallet = c.wallet LEFT JOIN ({_TRADEABLE}) h ON h.token_key = c.token_key AND h.wallet = c.wallet AND h.share > 1e-6 WHERE m.wallet IS NULL GROUP BY c.token_key)
SELECT a.token_key, round(CASE WHEN a.n >= 5 AND k.n >= 4 THEN {_wilson('held', 'k.n')} END, 6) AS raw, CASE WHEN a.n >= 5 THEN coalesce(k.n, 0) ELSE a.n END AS evidence FROM a LEFT JOIN k ON k.token_key = a.token_key""", "v_launches", "v_holders")
def early_holder_retention(t):
    holders = _tradeable(t)
    old = t("v_launches").filter(F.lit(T) - F.col("created_at") >= 360).select("token_key", "created_at")
    cohort = _seen(t).filter("side = 'buy'").join(old, "token_key").filter(F.col("as_of") <= F.col("created_at") + 300).select("token_key", F.col("wallet").cast("long").alias("wallet")).distinct()
    marked = cohort.join(_team(t, holders).withColumn("team", F.lit(1)), ["token_key", "wallet"], "left").join(holders.filter("share > 1e-6").select("token_key", F.col("wallet").cast("long").alias("wallet"), F.lit(1).alias("held")), ["token_key", "wallet"], "left")
    free = F.col("team").isNull()
    g = marked.groupBy("token_key").agg(F.count("*").alias("all"), _sum(free).alias("n"), _sum(free & F.col("held").isNotNull()).alias("held"))
    return _out(g, F.when((F.col("all") >= 5) & (F.col("n") >= 4), S.wilson("held", "n")), F.when(F.col("all") >= 5, F.col("n")).otherwise(F.col("all")))


@key(f""", h AS (SELECT * FROM v_holders WHERE share > 0), m AS ({_TEAM.format(h='SELECT * FROM v_holders WHERE share > 0')} UNION SELECT token_key, wallet FROM h WHERE label = 'BUILDING'), p AS (SELECT token_key, wallet, sum(CASE WHEN side = 'buy' THEN amount_token ELSE -amount_token END) AS net FROM v_trades WHERE as_of <= {T} AND observed_at <= {T} - 200 GROUP BY token_key, wallet)
SELECT h.token_key, round(CASE WHEN count(*) >= 5 THEN sum(CASE WHEN m.wallet IS NULL THEN 0e0 ELSE share * greatest(0e0, balance - greatest(0e0, coalesce(net, 0e0))) / balance END) END, 6) AS raw, count(*) AS evidence FROM h LEFT JOIN m ON m.token_key = h.token_key AND m.wallet = h.wallet LEFT JOIN p ON p.token_key = h.token_key AND p.wallet = h.wallet GROUP BY h.token_key""", "v_launches", "v_holders")
def insider_supply_overhang(t):
    """Supply of linked wallets that no purchase known {T} - 200 explains; BUILDING marks insiders."""
    holders = t("v_holders").filter("share > 0")
    linked = _team(t, holders).union(holders.filter("label = 'BUILDING'").select("token_key", F.col("wallet").cast("long"))).distinct()
    net = t("v_trades").filter(f"as_of <= {T} AND observed_at <= {T - 200}").groupBy("token_key", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("amount_token")).otherwise(-F.col("amount_token"))).alias("net"))
    rows = holders.join(linked.withColumn("team", F.lit(1)), ["token_key", "wallet"], "left").join(net, ["token_key", "wallet"], "left")
    free = F.greatest(F.lit(0.0), F.col("balance") - F.greatest(F.lit(0.0), F.coalesce("net", F.lit(0.0))))
    g = rows.groupBy("token_key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("team") == 1, F.col("share") * free / F.col("balance")).otherwise(0.0)).alias("x"))
    return _out(g, F.when(F.col("n") >= 5, F.col("x")), F.col("n"))


@key(f""", w AS (SELECT * FROM ({_SEEN}) v WHERE as_of >= {T} - 600), b AS (SELECT token_key, wallet, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS nb, sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS ns FROM w GROUP BY token_key, wallet),
g AS (SELECT w.token_key, count(*) AS n, count(*) FILTER (WHERE side = 'buy') AS buys, count(DISTINCT w.wallet) FILTER (WHERE side = 'buy') AS buyers, count(DISTINCT w.wallet) FILTER (WHERE nb > 0 AND ns > 0) AS trips, count(*) FILTER (WHERE side = 'buy' AND ns = 0) AS clean, count(DISTINCT w.wallet) FILTER (WHERE side = 'buy' AND ns = 0) AS breadth,
 sum(amount_native) FILTER (WHERE side = 'buy' AND ns = 0) AS bought, coalesce(sum(amount_native) FILTER (WHERE side = 'sell'), 0e0) AS sold, stddev_pop(amount_native) FILTER (WHERE side = 'buy' AND ns = 0) / avg(amount_native) FILTER (WHERE side = 'buy' AND ns = 0) AS spread FROM w JOIN b ON b.token_key = w.token_key AND b.wallet = w.wallet GROUP BY w.token_key)
SELECT token_key, round(CASE WHEN n < 8 THEN NULL WHEN buys = 0 OR clean = 0 THEN -1e0 ELSE ln((bought + 1e-9) / (CASE WHEN sold = 0 THEN 1e-9 ELSE sold END + 1e-9)) * (0.3e0 + 0.7e0 * breadth / (breadth + 15e0)) * (1 - least(1e0, CAST(trips AS DOUBLE) / buyers)) * (0.4e0 + 0.6e0 * CASE WHEN clean >= 6 THEN {_CL.format('spread / 1.2e0')} ELSE 1e0 END) END, 6) AS raw, n AS evidence FROM g""", "v_trades")
def buy_pressure_quality(t):
    rows = _seen(t).filter(f"as_of >= {T - 600}")
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    per = rows.groupBy("token_key", "wallet").agg(_sum(buy).alias("nb"), _sum(sell).alias("ns"), F.sum(F.when(buy, F.col("amount_native")).otherwise(0.0)).alias("b"), F.sum(F.when(sell, F.col("amount_native")).otherwise(0.0)).alias("s"), F.sum(F.when(buy, F.col("amount_native") * F.col("amount_native")).otherwise(0.0)).alias("bb"))
    clean = (F.col("nb") > 0) & (F.col("ns") == 0)
    g = per.groupBy("token_key").agg(F.sum(F.col("nb") + F.col("ns")).alias("n"), F.sum("nb").alias("buys"), _sum(F.col("nb") > 0).alias("buyers"), _sum((F.col("nb") > 0) & (F.col("ns") > 0)).alias("trips"), _sum(clean, F.col("nb")).alias("clean"), _sum(clean).alias("breadth"), F.sum(F.when(clean, F.col("b")).otherwise(0.0)).alias("bought"), F.sum("s").alias("sold"), F.sum(F.when(clean, F.col("bb")).otherwise(0.0)).alias("squares"))
    mean = F.col("bought") / F.col("clean")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("clean") - mean * mean)) / mean
    natural = F.when(F.col("clean") >= 6, S.clamp(spread / 1.2)).otherwise(1.0)
    score = F.ln((F.col("bought") + 1e-9) / (F.when(F.col("sold") == 0, 1e-9).otherwise(F.col("sold")) + 1e-9)) * (0.3 + 0.7 * S.saturating(F.col("breadth"), 15.0)) * (1 - S.clamp(F.col("trips") / F.col("buyers"))) * (0.4 + 0.6 * natural)
    return _out(g, F.when(F.col("n") < 8, None).when((F.col("buys") == 0) | (F.col("clean") == 0), -1.0).otherwise(score), F.col("n"))


@key(f""", m AS ({_TEAM.format(h='SELECT * FROM v_holders')}), x AS (SELECT m.token_key, count(*) AS n, sum(CASE WHEN side = 'buy' THEN amount_native ELSE 0e0 END) AS bought, sum(CASE WHEN side = 'sell' THEN amount_native ELSE 0e0 END) AS sold, sum(CASE WHEN side = 'sell' AND as_of >= {T} - 600 THEN amount_native ELSE 0e0 END) AS recent FROM m JOIN ({_SEEN}) v ON v.token_key = m.token_key AND v.wallet = m.wallet GROUP BY m.token_key)
SELECT l.token_key, round(CASE WHEN n IS NULL THEN CASE WHEN {T} - created_at < 120 THEN NULL ELSE 0.5e0 END WHEN bought <= 0 AND sold <= 0 THEN 0e0 WHEN sold <= 0 THEN 1 + bought / (bought + 2e0) ELSE -3 * sold / (bought + sold) * (1 + least(1e0, recent / sold)) END, 6) AS raw, coalesce(n, CASE WHEN {T} - created_at < 120 THEN 0 ELSE 1 END) AS evidence FROM v_launches l LEFT JOIN x ON x.token_key = l.token_key""", "v_launches", "v_holders")
def deployer_behaviour_now(t):
    t = written(t, v_trades="token_key wallet side amount_token amount_native as_of observed_at", v_launches="token_key deployer created_at", v_holders="token_key wallet funded_by")
    trades = _seen(t).join(_team(t, t("v_holders")), ["token_key", "wallet"], "left_semi")
    part = lambda c: F.sum(F.when(c, F.col("amount_native")).otherwise(0.0))
    sell = F.col("side") == "sell"
    x = trades.groupBy("token_key").agg(F.count("*").alias("n"), part(~sell).alias("bought"), part(sell).alias("sold"), part(sell & (F.col("as_of") >= T - 600)).alias("recent"))
    g = t("v_launches").select("token_key", "created_at").join(x, "token_key", "left")
    young = F.lit(T) - F.col("created_at") < 120
    sold = -3.0 * F.col("sold") / (F.col("bought") + F.col("sold")) * (1 + S.clamp(F.col("recent") / F.col("sold")))
    raw = F.when(F.col("n").isNull(), F.when(~young, 0.5)).when((F.col("bought") <= 0) & (F.col("sold") <= 0), 0.0).when(F.col("sold") <= 0, 1 + S.saturating(F.col("bought"), 2.0)).otherwise(sold)
    return _out(g, raw, F.coalesce("n", F.when(young, 0).otherwise(1)))


# --- launches ----------------------------------------------------------------------------


@key("SELECT l.token_key, round(CASE WHEN count(o.token_key) = 0 THEN 0e0 ELSE 0.4e0 * ln(1e0 + coalesce(max(o.multiple), 0e0)) + 2 * " + _wilson("sum(CASE WHEN o.graduated THEN 1 ELSE 0 END)", "nullif(count(o.token_key), 0)") + " - 4 * " + _wilson("sum(CASE WHEN o.rugged THEN 1 ELSE 0 END)", "nullif(count(o.token_key), 0)") + " - 0.5e0 * (count(o.token_key) / (count(o.token_key) + 60e0)) END, 6) AS raw, count(o.token_key) AS evidence FROM v_launches l LEFT JOIN v_outcomes o ON o.deployer = l.deployer AND o.labeled_at < l.created_at AND o.token_key <> l.token_key GROUP BY l.token_key", "v_outcomes")
def deployer_lineage(t):
    """A deployer's earlier tokens whose outcome was known at launch, by running sums; a first-timer has 0."""
    asks = t("v_launches").select("token_key", "deployer", "created_at")
    g = prior_counts(asks, t("v_outcomes"), "deployer", "created_at", "labeled_at", n=F.lit(1), good=F.col("graduated").cast("int"), bad=F.col("rugged").cast("int"), max_multiple=F.col("multiple"))
    score = 0.4 * F.log1p(F.coalesce("max_multiple", F.lit(0.0))) + 2 * S.wilson("good", "n") - 4 * S.wilson("bad", "n") - 0.5 * S.saturating(F.col("n"), 60.0)
    return _out(g, F.when(F.col("n") == 0, 0.0).otherwise(score), F.col("n"))


@key("SELECT a.token_key, round(sum(CASE WHEN b.token_key IS NULL THEN 0e0 ELSE 0.2e0 + b.price / (b.price + 20000e0) END), 6) AS raw, count(b.token_key) AS evidence FROM v_launches a LEFT JOIN v_launches b ON a.symbol = b.symbol AND a.token_key <> b.token_key AND b.created_at <= a.created_at GROUP BY a.token_key", "v_launches")
def ticker_contention(t):
    """Other launches of the symbol up to now: sums by creation second, then running sums over the seconds."""
    weight = 0.2 + S.saturating(F.col("price"), 20000.0)
    rows = t("v_launches").withColumn("w", weight)
    ticks = rows.groupBy("symbol", "created_at").agg(F.sum("w").alias("s"), F.count("*").alias("c"))
    run = Window.partitionBy("symbol").orderBy("created_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ticks = ticks.select("symbol", "created_at", F.sum("s").over(run).alias("s"), F.sum("c").over(run).alias("c"))
    return _out(rows.join(ticks, ["symbol", "created_at"]), F.greatest(F.lit(0.0), F.col("s") - F.col("w")), F.col("c") - 1)


_DESC = "name || ' ' || lower(launchpad)"


@key(f""", d AS (SELECT *, list_filter(regexp_extract_all({_NORM.format(_DESC)}, '[a-z0-9'']+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP})) AS toks FROM v_launches)
SELECT token_key, round({_CL.format("0.30e0 * least(1e0, len(toks) / 25e0) + 0.15e0 * CASE WHEN len(toks) = 0 THEN 0e0 ELSE CAST(len(list_distinct(toks)) AS DOUBLE) / len(toks) END + 0.30e0 * least(1e0, (CASE WHEN token_key % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN token_key % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN token_key % 5 = 0 THEN 1 ELSE 0 END) / 2e0) + 0.15e0 * CASE WHEN name = '' OR symbol = '' THEN 0e0 WHEN upper(name) <> upper(symbol) AND len(name) > len(symbol) THEN 1e0 ELSE 0.5e0 END + 0.10e0 * CASE WHEN token_key % 4 <> 0 THEN 1e0 ELSE 0e0 END")}, 6) AS raw, CAST(1 AS BIGINT) AS evidence FROM d""", "v_launches")
def description_substance(t):
    """Description is name and launchpad; twitter, telegram and website stand on every second, third and fifth token, an image on three of four."""
    rows = t("v_launches").withColumn("text", F.concat("name", F.lit(" "), F.lower("launchpad"))).withColumn("toks", X.tokens(X.normalize("text")))
    n = F.size("toks")
    links = sum(((F.col("token_key") % k == 0).cast("int") for k in (3, 5)), (F.col("token_key") % 2 == 0).cast("int"))
    naming = F.when((F.col("name") == "") | (F.col("symbol") == ""), 0.0).when((F.upper("name") != F.upper("symbol")) & (F.length("name") > F.length("symbol")), 1.0).otherwise(0.5)
    unique = F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct("toks")) / n)
    image = F.when(F.col("token_key") % 4 != 0, 1.0).otherwise(0.0)
    return _out(rows, S.clamp(0.30 * S.clamp(n / 25) + 0.15 * unique + 0.30 * S.clamp(links / 2) + 0.15 * naming + 0.10 * image), F.lit(1))


_NARR = "name || ' ' || symbol || ' ' || launchpad"


@key(f""", s AS (SELECT token_key, CAST(floor(created_at / 100) AS BIGINT) AS b, {_SH} AS g FROM (SELECT token_key, created_at, {_SKEL.replace('(text)', f'({_NARR})')} AS s FROM v_launches)),
p AS (SELECT a.token_key, CAST(len(list_intersect(a.g, o.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, o.g))) AS sim FROM s a JOIN s o ON o.b = a.b - 1), q AS (SELECT token_key, count(*) AS n, max(sim) AS best, count(*) FILTER (WHERE sim > 0.55) AS near FROM p GROUP BY token_key)
SELECT s.token_key, round(CASE WHEN n >= 15 THEN {_CL.format('(1 - best) * (1 - 0.6e0 * least(1e0, near / 8e0))')} END, 6) AS raw, coalesce(n, 0) AS evidence FROM s LEFT JOIN q USING (token_key)""", "v_launches")
def narrative_novelty(t):
    """A launch's name, symbol and pad against those of the hundred seconds before its own; equal ones of a period are compared once."""
    from ..operators.novelty import against_last_period
    from ..sources.shared import park

    text = t("v_launches").select("token_key", F.floor(F.col("created_at") / 100).alias("b"), F.concat_ws(" ", "name", "symbol", "launchpad").alias("text"))
    s = park(_skeletons(text, "token_key", "b"))
    texts = s.groupBy("b", "skel").agg(F.count("*").alias("k"))
    best = against_last_period(texts, "b", "skel", "k", 0.55)
    corpus = texts.groupBy((F.col("b") + 1).alias("b")).agg(F.sum("k").alias("c"))
    g = s.join(corpus, "b", "left").join(best, ["b", "skel"], "left")
    score = (1 - F.coalesce("best", F.lit(0.0))) * (1 - 0.6 * S.clamp(F.coalesce("close", F.lit(0)) / 8))
    return _out(g, F.when(F.col("c") >= 15, S.clamp(score)), F.coalesce("c", F.lit(0)))


#: Themes that a market follows, with weights.
THEMES = (("brushed steel", 0.9), ("polished brass", 0.8), ("anodized tin", 0.6), ("burnished copper", 1.2), ("spring green lace", 0.5))


@key(f""", th AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}e0)" for a, b in THEMES)}) v(theme, weight)), s AS (SELECT token_key, {_SH} AS g, string_split(lower({_NARR}), ' ') AS words FROM (SELECT *, {_SKEL.replace('(text)', f'({_NARR})')} AS s FROM v_launches)), x AS (SELECT *, string_split(theme, ' ') AS words, {_SH.replace('(s)', '(theme)').replace('(s,', '(theme,')} AS g FROM th)
SELECT token_key, round(max(greatest(CAST(len(list_intersect(s.words, x.words)) AS DOUBLE) / len(x.words), CAST(len(list_intersect(s.g, x.g)) AS DOUBLE) / len(list_distinct(list_concat(s.g, x.g)))) * least(1e0, weight)), 6) AS raw, count(*) AS evidence FROM s CROSS JOIN x GROUP BY token_key""", "v_launches")
def meta_alignment(t):
    """The best of the themes, by shared words or shingles, times its weight; the themes are a fixed list, so each is an expression."""
    text = t("v_launches").select("token_key", F.concat_ws(" ", "name", "symbol", "launchpad").alias("text"))
    rows = text.select("token_key", X.normalize("text").alias("norm")).select("token_key", X.tokens("norm").alias("toks"), char_shingles(X.skeletonize("norm")).alias("g"))
    scores = []
    for theme, weight in THEMES:
        words = F.array(*map(F.lit, theme.split()))
        overlap = F.size(F.array_intersect("toks", words)) / len(theme.split())
        scores.append(F.greatest(overlap, jaccard(F.col("g"), char_shingles(F.lit(theme)))) * min(1.0, weight))
    return _out(rows, F.greatest(*scores), F.lit(len(THEMES)))
