"""Text operators and source normalisation (survey sections I and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pit
from .registry import key

# DuckDB's forms. Marks are stripped and ß becomes ss; texts with compatibility characters or zero-width ones are in tests/test_whole.py.
_NORM = r"trim(regexp_replace(replace(lower(strip_accents({})), 'ß', 'ss'), '\s+', ' ', 'g'))"
_SKEL = _NORM.format("text")
for _p, _r in X.KINDS:
    _SKEL = f"regexp_replace({_SKEL}, '{_p}', ' <{_r}> ', 'g')"
_SKEL = rf"trim(regexp_replace(regexp_replace({_SKEL}, '[^\w<>\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOK = f"list_filter(regexp_extract_all({_NORM.format('text')}, '[a-z0-9'']+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))"
_SH = "CASE WHEN len(s) > 0 THEN list_distinct(list_transform(range(1, greatest(len(s) - 2, 2)), lambda i: substr(s, i, 4))) ELSE [] END"


def _normal(rows, *kept):
    """Rows with normal texts."""
    return X.normal_rows(rows, *kept)


def _skeletons(rows, *kept):
    return _normal(rows, *kept).select(*kept, X.skeletonize("text").alias("skel"))


@key(f"SELECT post_id, {_NORM.format('text')} AS norm FROM v_posts", "v_posts")
def text_normalize(t):
    return t("v_posts").select("post_id", X.normalize("text").alias("norm"))


@key(f"SELECT post_id, {_SKEL} AS skeleton FROM v_chat", "v_chat")
def skeletonize(t):
    return _skeletons(t("v_chat"), "post_id").withColumnRenamed("skel", "skeleton")


@key(f"SELECT post_id, len({_TOK}) AS n, array_to_string({_TOK}[1:5], ' ') AS head FROM v_posts", "v_posts")
def tokens(t):
    return _normal(t("v_posts"), "post_id").select("post_id", F.size(X.tokens("text")).cast("long").alias("n"), F.array_join(F.slice(X.tokens("text"), 1, 5), " ").alias("head"))


@key(f"SELECT post_id, len({_SH}) AS n FROM (SELECT post_id, {_SKEL} AS s FROM v_chat)", "v_chat")
def shingles(t):
    from ..operators.similarity import char_shingles

    return _skeletons(t("v_chat"), "post_id").select("post_id", F.size(char_shingles(F.col("skel"))).cast("long").alias("n"))


@key(f", h AS (SELECT post_id, author, {_SH} AS s FROM (SELECT post_id, author, {_SKEL} AS s FROM v_chat)) SELECT a.post_id, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM h a JOIN h b ON b.post_id = a.post_id + 1", "v_chat")
def similarity(t):
    from ..operators.similarity import char_shingles, jaccard

    h = _skeletons(t("v_chat"), "post_id").select("post_id", char_shingles(F.col("skel")).alias("s"))
    other = h.select((F.col("post_id") - 1).alias("post_id"), F.col("s").alias("o"))
    return h.join(other, "post_id").select("post_id", F.round(jaccard(F.col("s"), F.col("o")), 6).alias("similarity"))


@key(f", k AS (SELECT author, {_SKEL} AS skel, count(*) AS n FROM v_chat GROUP BY ALL) SELECT author, round(CASE WHEN sum(n) < 3 THEN 0 ELSE CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS DOUBLE) / sum(n) END, 9) AS share FROM k WHERE len(skel) >= 6 GROUP BY author", "v_chat")
def template_share_exact(t):
    k = _skeletons(t("v_chat"), "author").groupBy("author", "skel").agg(F.count("*").alias("n")).filter(F.length("skel") >= 6)
    share = F.when(F.sum("n") < 3, 0.0).otherwise(F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)) / F.sum("n"))
    return k.groupBy("author").agg(F.round(share, 9).alias("share"))


@key(f"SELECT post_id, round(CASE WHEN len({_TOK}) < 10 THEN 0.0 ELSE least(1, len(list_distinct({_TOK})) / sqrt(len({_TOK})) / 10) END, 6) AS diversity FROM v_posts", "v_posts")
def lexical_diversity(t):
    return _normal(t("v_posts"), "post_id").select("post_id", F.round(X.lexical_diversity("text"), 6).alias("diversity"))


def _hits(phrases, col="text"):
    return " + ".join("CAST(contains({}, '{}') AS INTEGER)".format(col, p.replace("'", "''")) for p in phrases)


@key(f"SELECT post_id, round(least(1, ({_hits(X.SHILL)}) / 3.0), 6) AS shill, round(least(1, ({_hits(X.CONVICTION)}) / 2.0), 6) AS conviction FROM (SELECT post_id, {_NORM.format('text')} AS text FROM v_talk) n", "v_talk")
def shill_density(t):
    return _normal(t("v_talk"), "post_id").select("post_id", F.round(X.shill_density("text"), 6).alias("shill"), F.round(X.conviction_density("text"), 6).alias("conviction"))


@key(f"SELECT post_id, round(CASE WHEN len({_TOK}) = 0 THEN 0.0 ELSE 0.5 * least(1, len({_TOK}) / 25.0) + 0.3 * len(list_distinct({_TOK})) / len({_TOK}) + 0.2 END, 9) AS effort FROM v_posts", "v_posts")
def effort_score(t):
    rows = t("v_posts").select("post_id", F.regexp_count("text", F.lit(X.EMOJI)).alias("emoji"), X.normalize(F.regexp_replace("text", X.EMOJI, "")).alias("text"))
    return rows.select("post_id", F.round(X.effort_score("text", F.col("emoji")), 9).alias("effort"))


@key("SELECT post_id, array_to_string(regexp_extract_all(text, '\\$([A-Za-z][A-Za-z0-9]*)', 1), ',') AS cashtags, array_to_string(regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1), ',') AS hashtags, array_to_string(regexp_extract_all(text, '@([A-Za-z0-9_]+)', 1), ',') AS mentions, array_to_string(regexp_extract_all(text, '(https?://[^\\s]+)', 1), ',') AS urls FROM v_chat", "v_chat")
def extract_entities(t):
    return t("v_chat").select("post_id", *[F.array_join(c, ",").alias(k) for k, c in X.entities(F.col("text")).items()])


@key("SELECT doc_id, regexp_matches(text, '0x[0-9a-fA-F]{40}|\\b[1-9A-HJ-NP-Za-km-z]{32,44}\\b') AS found FROM documents")
def contains_address(t):
    return t("documents").select("doc_id", X.contains_address("text").alias("found"))


@key("SELECT post_id, element_at(string_split(rtrim(regexp_extract(text, '(https?://[^\\s]+)', 1), '/'), '/'), -1)[1] AS tail FROM v_chat".replace("element_at(string_split(rtrim(regexp_extract(text, '(https?://[^\\s]+)', 1), '/'), '/'), -1)[1]", "string_split(rtrim(regexp_extract(text, '(https?://[^\\s]+)', 1), '/'), '/')[-1]"), "v_chat")
def url_tail(t):
    url = F.rtrim(F.regexp_extract("text", r"(https?://[^\s]+)", 1), F.lit("/"))
    return t("v_chat").select("post_id", F.element_at(F.split(url, "/"), -1).alias("tail"))


@key("SELECT c_custkey, CASE WHEN regexp_full_match(h, '[A-Za-z][A-Za-z0-9_]{3,31}') THEN lower(h) END AS handle FROM (SELECT c_custkey, regexp_extract('https://t.me/' || CASE WHEN c_custkey % 4 = 0 THEN '1bad' ELSE c_mktsegment END || '_' || c_custkey, 't\\.me/(?:s/)?([^/?]+)', 1) AS h FROM customer)")
def channel_normalize(t):
    link = F.concat(F.lit("https://t.me/"), F.when(F.col("c_custkey") % 4 == 0, "1bad").otherwise(F.col("c_mktsegment")), F.lit("_"), F.col("c_custkey"))
    h = F.regexp_extract(link, r"t\.me/(?:s/)?([^/?]+)", 1)
    return t("customer").select("c_custkey", F.when(h.rlike("^[A-Za-z][A-Za-z0-9_]{3,31}$"), F.lower(h)).alias("handle"))


@key("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'guaranteed|password|all rights reserved')")
def forbidden_scan(t):
    return t("documents").filter(F.lower("text").rlike("guaranteed|password|all rights reserved")).select("doc_id")


@key("SELECT doc_id, left(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 32) AS hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", F.substring(F.sha2(F.to_json(F.struct("lang", "source")), 256), 1, 32).alias("hash"))


@key()
def simhash_groups(t):
    from ..operators.neardup import simhash

    return _skeletons(t("conversations")).groupBy(simhash("skel").alias("hash")).agg(F.count("*").alias("n"))


@key()
def near_dup_groups(t):
    """Groups of two or more posts of an author within 6 bits of the group's first."""
    from ..operators.neardup import dealt, fingerprints, leader_groups

    talk = dealt(t("v_talk").select("author", F.col("post_id").alias("id"), "text"), "id")
    rows = fingerprints(_skeletons(talk, "author", "id"), "skel", "author", "id")
    groups = leader_groups(rows, "author", "id", "hash", 6)
    several = groups.groupBy("author", "leader").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.join(several, ["author", "leader"]).select("author", "leader", "id")


@key()
def template_share_fuzzy(t):
    from ..operators.neardup import dealt, template_share

    talk = dealt(t("v_talk").select("author", "post_id", "text"), "post_id")
    return template_share(_skeletons(talk, "author", "post_id"), "author", "post_id", "skel").select("author", F.round("share", 9).alias("share"))


# --- sources -------------------------------------------------------------------------------


@key("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages")
def html_strip(t):
    return t("pages").select("page_id", X.strip_html("html").alias("body"))


@key("SELECT event_id, CAST(round_even(CAST(event_id % 50 AS DOUBLE) / 10 * CASE event_id % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1e9 END, 0) AS BIGINT) AS n FROM events")
def abbrev_int(t):
    text = F.concat((F.col("event_id") % 50 / 10).cast("string"), F.when(F.col("event_id") % 3 == 0, "K").when(F.col("event_id") % 3 == 1, "M").otherwise("B"))
    return t("events").select("event_id", text.alias("s")).select("event_id", X.abbreviated_int("s").alias("n"))


@key("SELECT event_id, CASE WHEN id >= 4294967296 THEN id // 4294967296 END AS sec FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_id ELSE (1700000000 + event_id) * 4294967296 + event_id END AS id FROM events)")
def snowflake_ts(t):
    id_ = F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise((1700000000 + F.col("event_id")) * 4294967296 + F.col("event_id"))
    return t("events").select("event_id", F.when(id_ >= 4294967296, F.shiftright(id_, 32)).alias("sec"))


@key("SELECT token_key, max(price) FILTER (WHERE source = 'view') AS view, max(price) FILTER (WHERE source = 'click') AS click, max(price) FILTER (WHERE source = 'signup') AS signup FROM v_snapshots GROUP BY token_key", "v_snapshots")
def activity_pivot(t):
    return t("v_snapshots").groupBy("token_key").pivot("source", ["view", "click", "signup"]).agg(F.max("price")).select("token_key", "view", "click", "signup")


@key(", r AS (SELECT token_key, wallet, share, label, row_number() OVER (PARTITION BY token_key ORDER BY share DESC, wallet) AS i FROM v_holders) SELECT token_key, round(sum(share) FILTER (WHERE i <= 10), 6) AS top10, round(coalesce(sum(share) FILTER (WHERE label = 'BUILDING'), 0), 6) AS insider, round(max(share), 6) AS largest FROM r GROUP BY token_key", "v_holders")
def holder_security(t):
    from pyspark.sql import Window

    r = t("v_holders").withColumn("i", F.row_number().over(Window.partitionBy("token_key").orderBy(F.desc("share"), "wallet")))
    return r.groupBy("token_key").agg(F.round(F.sum(F.when(F.col("i") <= 10, F.col("share"))), 6).alias("top10"), F.round(F.coalesce(F.sum(F.when(F.col("label") == "BUILDING", F.col("share"))), F.lit(0.0)), 6).alias("insider"), F.round(F.max("share"), 6).alias("largest"))


@key("SELECT token_key, max(price) AS amount, round(sum(price), 4) AS total, arg_min(source, event_id) AS description FROM v_snapshots GROUP BY token_key", "v_snapshots")
def boost_merge(t):
    return t("v_snapshots").groupBy("token_key").agg(F.max("price").alias("amount"), F.round(F.sum("price"), 4).alias("total"), F.min_by("source", "event_id").alias("description"))


@key("SELECT launchpad, round(0.4 * least(1, cap / 5e5) + 0.6 * least(1, greatest(0, delta) / 0.5), 6) AS weight FROM (SELECT launchpad, sum(price) AS cap, avg(size) / 100.0 AS delta FROM v_launches GROUP BY ALL) ORDER BY weight DESC, launchpad LIMIT 8", "v_launches")
def active_themes(t):
    g = t("v_launches").groupBy("launchpad").agg(F.sum("price").alias("cap"), (F.avg("size") / 100.0).alias("delta"))
    weight = 0.4 * F.least(F.lit(1.0), F.col("cap") / 5e5) + 0.6 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("delta")) / 0.5)
    return g.select("launchpad", F.round(weight, 6).alias("weight")).orderBy(F.desc("weight"), "launchpad").limit(8)


@key("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS revoked FROM events")
def tri_state_revoked(t):
    raw = F.element_at(F.array(F.lit("no"), F.lit("yes"), F.lit(None).cast("string"), F.lit("unknown")), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", raw.alias("authority")).select("event_id", F.when(F.col("authority") == "no", True).when(F.col("authority") == "yes", False).alias("revoked"))


@key("SELECT event_id, event_id * 60 AS at_sec, value AS open, value + event_id % 3 AS high FROM events WHERE event_id % 5 <> 0")
def ohlcv_rows(t):
    full = F.array(F.col("event_id") * 60.0, F.col("value"), F.col("value") + F.col("event_id") % 3, F.col("value"), F.col("value"), F.lit(1.0))
    rows = t("events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.slice(full, 1, 3)).otherwise(full).alias("r"))
    return rows.filter(F.size("r") >= 6).select("event_id", F.element_at("r", 1).cast("long").alias("at_sec"), F.element_at("r", 2).alias("open"), F.element_at("r", 3).alias("high"))


@key("SELECT event_id, CASE event_type WHEN 'view' THEN 'pumpswap' WHEN 'click' THEN 'moonshot' WHEN 'signup' THEN 'believe' ELSE 'unknown' END AS launchpad FROM events")
def multi_dex(t):
    names = F.create_map(*[F.lit(x) for x in ("view", "pumpswap", "click", "moonshot", "signup", "believe")])
    return t("events").select("event_id", F.coalesce(names[F.col("event_type")], F.lit("unknown")).alias("launchpad"))


@key("SELECT event_id, round(least(1, greatest(0, k / 85.0)), 6) AS progress, CASE WHEN k / 85.0 >= 1 THEN 'graduated' WHEN k / 85.0 >= 0.85 THEN 'near_graduation' ELSE 'bonding' END AS stage FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")
def coin_normalize(t):
    from ..functions.stats import clamp

    k = F.from_json("props", "k double")["k"]
    return t("events").select("event_id", F.round(clamp(k / 85.0), 6).alias("progress"), F.when(k / 85.0 >= 1, "graduated").when(k / 85.0 >= 0.85, "near_graduation").otherwise("bonding").alias("stage"))


@key("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round(CASE WHEN raw > 1e6 THEN raw / 1e9 ELSE raw END, 9) AS sol, CAST(left(CAST(1000000000000000 + event_id AS VARCHAR), 12) AS BIGINT) AS slot FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value * 1e9 ELSE value END AS raw FROM events)")
def trade_normalize(t):
    from ..sources.normalize import lamports, side_of, slot_of

    doc = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("value") * 1e9).otherwise(F.col("value")).alias("solAmount"), F.when(F.col("event_id") % 4 < 2, F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell")).alias("txType"), F.when(F.col("event_id") % 4 >= 2, F.col("event_id") % 2 == 0).alias("isBuy"), (F.lit(1000000000000000) + F.col("event_id")).cast("string").alias("slotIndexId")))
    p = t("events").select("event_id", F.from_json(doc, "solAmount double, txType string, isBuy boolean, slotIndexId string").alias("p"))
    return p.select("event_id", side_of(F.col("p.txType"), F.col("p.isBuy")).alias("side"), F.round(lamports(F.col("p.solAmount")), 9).alias("sol"), slot_of(F.col("p.slotIndexId")).alias("slot"))


@key("SELECT event_id, 'solana:' || event_id AS pair, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://x.com/' || event_type END AS twitter, value AS price FROM events")
def pair_normalize(t):
    socials = F.filter(F.array(F.when(F.col("event_id") % 3 != 0, F.struct(F.lit("twitter").alias("type"), F.concat(F.lit("https://x.com/"), "event_type").alias("url"))), F.struct(F.lit("telegram").alias("type"), F.lit("t").alias("url"))), lambda x: x.isNotNull())
    doc = F.to_json(F.struct(F.lit("solana").alias("chainId"), F.col("event_id").cast("string").alias("pairAddress"), F.col("value").alias("priceUsd"), socials.alias("socials")))
    p = t("events").select("event_id", F.from_json(doc, "chainId string, pairAddress string, priceUsd double, socials array<struct<type: string, url: string>>").alias("p"))
    links = F.map_from_entries("p.socials")
    return p.select("event_id", F.concat_ws(":", "p.chainId", "p.pairAddress").alias("pair"), F.element_at(links, "twitter").alias("twitter"), F.col("p.priceUsd").alias("price"))


@key("SELECT post_id, arg_min(s.symbol, s.place) AS owner, count(*) AS mentioned FROM v_chat c JOIN (SELECT unnest(['CLICK', 'VIEW', 'PURCHASE', 'SIGN']) AS symbol, unnest([1, 2, 3, 4]) AS place) s ON contains(c.text, '$' || s.symbol) GROUP BY post_id", "v_chat")
def post_attribution(t):
    symbols = t.spark.createDataFrame([("CLICK", 1), ("VIEW", 2), ("PURCHASE", 3), ("SIGN", 4)], "symbol string, place int")
    hits = t("v_chat").join(F.broadcast(symbols.withColumnRenamed("symbol", "s")), F.col("text").contains(F.concat(F.lit("$"), F.col("s"))))
    return hits.groupBy("post_id").agg(F.min_by("s", "place").alias("owner"), F.count("*").alias("mentioned"))


@key("SELECT src, count(*) AS n, bool_and(ok) AS ok, bool_or(NOT ok) AS degraded FROM (SELECT 'posts' AS src, n_chars > 5 AS ok FROM documents UNION ALL SELECT 'chat', len(text) > 5 FROM conversations) GROUP BY src")
def collect_combine(t):
    a = t("documents").select(F.lit("posts").alias("src"), (F.col("n_chars") > 5).alias("ok"))
    b = t("conversations").select(F.lit("chat").alias("src"), (F.length("text") > 5).alias("ok"))
    return a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"), F.bool_or(~F.col("ok")).alias("degraded"))


@key("SELECT 'documents' AS tab, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents UNION ALL SELECT 'events', count(*), min(event_id), max(event_id) FROM events")
def corpus_manifest(t):
    one = lambda x, k: t(x).agg(F.lit(x).alias("tab"), F.count("*").alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"))
    return one("documents", "doc_id").union(one("events", "event_id"))


#: Transactions in the forms that funding takes; @W is the wallet, @S the one asked for, @O another.
_TX = (
    '{"transaction":{"message":{"instructions":[{"parsed":"memo"},{"parsed":{"info":{"source":"@S","destination":"@W","lamports":5}}}]}}}',
    '{"transaction":{"message":{"instructions":[{"parsed":{"info":{"source":"@O","destination":"@O2"}}}]}},"meta":{"innerInstructions":[{"index":0,"instructions":[{},{"parsed":{"info":{"lamportsSource":"@S","newAccount":"@W"}}}]}]}}',
    '{"transaction":{"message":{"instructions":[{"parsed":{"info":{"source":"@W","destination":"@W"}}},{"parsed":{"info":{"wallet":"@W","source":"@S","mint":"m"}}}]}}}',
    '{"transaction":{"message":{"accountKeys":["@O","@S","@W"],"instructions":[{"parsed":{"info":{"source":"11111111111111111111111111111111","destination":"@W"}}}]}},"meta":{"preBalances":[50,900,1],"postBalances":[40,100,811]}}',
    '{"transaction":{"message":{"accountKeys":["@S","@W"],"instructions":[]}},"meta":{"preBalances":[900,10],"postBalances":[800,10]}}',
    '{"transaction":{"message":{"accountKeys":[{"pubkey":"@W"},{"pubkey":"@S","signer":true},{"pubkey":"ComputeBudget111111111111111111111111111111"}],"instructions":[]}},"meta":{"preBalances":[0,7,99],"postBalances":[5,2,1]}}',
    '{"transaction":',
)
_TX_KIND = "(order_id + slot) % 7"


@key(f"""SELECT concat_ws('.', order_id, slot, supp_id, token_key) AS tx_id, 'w' || CAST(wallet AS VARCHAR) AS wallet, CASE WHEN {_TX_KIND} IN (0, 1, 2, 3, 5) THEN 's' || CAST(supp_id AS VARCHAR) END AS funder,
CASE {_TX_KIND} WHEN 0 THEN 'transfer' WHEN 1 THEN 'transfer' WHEN 2 THEN 'account-payer' WHEN 3 THEN 'balance-delta' WHEN 4 THEN 'none' WHEN 5 THEN 'balance-delta' ELSE 'no-transaction' END AS mechanism FROM v_trades""", "v_trades")
def funder_parse(t):
    """Who funded the wallet of each trade, from a transaction document built for it."""
    from ..sources.documents import funders

    wallet, funder = F.concat(F.lit("w"), F.col("wallet").cast("string")), F.concat(F.lit("s"), F.col("supp_id").cast("string"))
    form = F.get(F.array(*map(F.lit, _TX)), (F.expr(_TX_KIND)).cast("int"))
    doc = F.replace(F.replace(F.replace(form, F.lit("@W"), wallet), F.lit("@S"), funder), F.lit("@O"), F.lit("o"))
    return funders(t("v_trades").select(F.concat_ws(".", *[F.col(c).cast("string") for c in ("order_id", "slot", "supp_id", "token_key")]).alias("tx_id"), wallet.alias("wallet"), doc.alias("doc")))


@key()
def curve_binary(t):
    from ..sources.normalize import parse_curve

    raw = F.concat(F.unhex(F.lit("17b7f83760d8ac60")), *[F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0")) for c in (F.col("event_id") * 1000 + 1, F.col("event_id") * 10 + 1, F.lit(5), F.lit(7), F.lit(9))], F.unhex(F.lit("00")))
    return t("events").select("event_id", raw.alias("raw")).select("event_id", parse_curve("raw").alias("c")).select("event_id", "c.*")


@key()
def json_walk(t):
    from ..sources.documents import json_walk as walk

    doc = F.concat(F.lit('{"data":[{"k":'), F.get_json_object("props", "$.k"), F.lit('},{"deep":{"k":1}}]}'))
    return walk(t("events").select("event_id", doc.alias("doc")), "event_id", "doc", "k")
