"""Queries take all rows and whole texts: held against plain Python versions."""

import os
import random
import re
import unicodedata
from datetime import datetime, timedelta

import duckdb
import pytest

from tidepool.functions.text import STOPWORDS
from tidepool.plans import catalog

from .test_oracles import norm

FOLDER = "/root/testdata/sf0.001"


def stripped(html):
    out = re.sub(r"<[^>]*>", " ", html)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = out.replace(entity, char)
    return re.sub(r"[ \t\n\r]+", " ", out).strip(" ")


def test_html_strip_takes_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert any(not h.isascii() for h in pages.values())
    got = {r.page_id: r.body for r in catalog.QUERIES["html_strip"](spark, FOLDER).collect()}
    assert got == {k: stripped(h) for k, h in pages.items()}


def test_html_strip_beyond_ascii(spark, tmp_path):
    html = ["<p>Café</p>\t<b>été &amp; hiver</b>", "<i>日本語</i>\r\n&lt;x&gt;", "plain"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.body for r in catalog.QUERIES["html_strip"](spark, str(tmp_path)).collect()}
    assert got == {0: "Café été & hiver", 1: "日本語 <x>", 2: "plain"}


def test_expanding_peer_rank_counts_by_hand(spark, tmp_path):
    r = random.Random(3)
    events = [(i, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(40)), i % 90, r.choice("ab"), float(r.randrange(12)), "{}") for i in range(150)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for e in events:
        peers = [x[4] for x in events if x[3] == e[3] and (x[1], x[0]) < (e[1], e[0])]
        want[e[0]] = round(sum(x <= e[4] for x in peers) / len(peers), 6) if peers else 0.5
    got = {x.event_id: x["rank"] for x in catalog.QUERIES["expanding_peer_rank"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)


def test_reclaim_scan_counts_trades_of_all_tokens(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, DATE'1995-02-01' AS o_orderdate FROM range(1, 3)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 'N' AS l_returnflag, 1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_tax, 0D AS l_discount, DATE'1995-02-02' AS l_shipdate FROM range(1, 3)").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(catalog.QUERIES["reclaim_scan"](spark, str(tmp_path)).first()) == (1, 0.006, 0.0054)


TEXTS = ["Été à l'École: ÇA va, ça va! naïve Straße", "zero\u200bwidth\xa0and ﬁne", "un deux trois quatre cinq été huit neuf dix onze douze", "日本語", "nice 😀 work 🚀", "", "plain ascii", "key é" + "A" * 40, "key " + "A" * 40 + " été", "0x" + "a" * 40 + " ñ"]


def normal(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(re.sub("[\u200b\u200c\u200d\ufeff]", "", s).casefold().split())


def words(s):
    return [w for w in re.findall(r"[a-z0-9']+", normal(s)) if len(w) > 1 and w not in STOPWORDS]


def effort(s):
    emoji = "[\U0001f300-\U0001faff\u2600-\u27bf\U0001f1e6-\U0001f1ff\u2b00-\u2bff\ufe0f]"
    w = words(re.sub(emoji, "", s))
    return 0.5 * min(1, len(w) / 25) + 0.3 * len(set(w)) / len(w) + 0.2 * (1 - min(1, len(re.findall(emoji, s)) / len(w))) if w else 0.0


def test_text_queries_take_all_texts(spark, tmp_path):
    rows = [(i, s, "fr", "web", len(s)) for i, s in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: {r[0]: tuple(r)[1:] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("text_normalize") == {i: (normal(s),) for i, s in enumerate(TEXTS)}
    assert got("tokens") == {i: (len(words(s)), " ".join(words(s)[:5])) for i, s in enumerate(TEXTS)}
    assert got("lexical_diversity") == {i: (round(min(1, len(set(words(s))) / len(words(s)) ** 0.5 / 10), 6) if len(words(s)) >= 10 else 0.0,) for i, s in enumerate(TEXTS)}
    assert {k: v[0] for k, v in got("effort_score").items()} == pytest.approx({i: effort(s) for i, s in enumerate(TEXTS)})
    assert got("contains_address") == {i: (re.search(r"0x[0-9a-fA-F]{40}|\b[1-9A-HJ-NP-Za-km-z]{32,44}\b", s) is not None,) for i, s in enumerate(TEXTS)}


def test_novelty_scores_long_and_accented_turns(spark, tmp_path):
    turns = [(1, 1, "Été à la plage"), (1, 2, "long turn " * 60 + "ends"), (2, 1, "plain words"), (2, 2, "")]
    items = [(1, "été à la mer"), (2, "long turn after turn"), (3, "")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = lambda s: {s.lower()[i : i + 4] for i in range(max(1, len(s) - 3))}
    want = {(c, n): 1 - max(len(grams(s) & grams(b)) / len(grams(s) | grams(b)) for _, b in items) for c, n, s in turns}
    got = {(r.conv_id, r.turn): r.novelty for r in catalog.QUERIES["novelty_vs_corpus"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
