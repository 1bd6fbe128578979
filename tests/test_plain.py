"""Queries that SQL doesn't express, against plain Python."""

import hashlib
import math
import os
import re
import types
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.operators import portfolio as P
from tidepool.operators.neardup import template_share
from tidepool.operators.resample import bootstrap
from tidepool.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TESTED = {"stream_exits", "metric_normalize", "metric_confidence", "weight_fit", "ablation", "backtest_replay", "phash_clusters", "risk_entry", "exit_policy", "bootstrap_ci", "phash_bits", "simhash_groups", "near_dup_groups", "template_share_fuzzy", "curve_binary", "json_walk", "reply_template_ratio"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def query(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


# --- texts -------------------------------------------------------------------------------


def skeleton(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
    s = " ".join(s.casefold().split())
    for pattern, kind in X.KINDS:
        s = re.sub(pattern, f" <{kind}> ", s)
    return " ".join(re.sub(r"[^\w<>\s]", " ", s).split())


def simhash(s):
    if not s:
        return 0
    votes = [0] * 64
    for g in {s[i : i + 4] for i in range(max(1, len(s) - 3))}:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def leaders(rows, distance):
    """rows: (id, hash) in id order; id -> leader."""
    heads, out = [], {}
    for i, h in rows:
        if not h:
            continue
        near = next((k for k, g in heads if bin(g ^ h).count("1") <= distance), None)
        if near is None:
            heads.append((i, h))
            near = i
        out[i] = near
    return out


def share(texts):
    """texts: (id, text). Share in templates of three or more, exact or near."""
    kept = [(i, k) for i, s in sorted(texts) if len(k := skeleton(s)) >= 6]
    if len(kept) < 3:
        return (0.0, len(kept)) if kept else None
    count = {}
    for _, k in kept:
        count[k] = count.get(k, 0) + 1
    same = sum(n for n in count.values() if n >= 3)
    groups = {}
    for i, lead in leaders([(i, simhash(k)) for i, k in kept if count[k] < 3], 8).items():
        groups.setdefault(lead, []).append(i)
    return (same + sum(len(g) for g in groups.values() if len(g) >= 3)) / len(kept), len(kept)


def talk(spark):
    from tidepool.plans.views import view

    return view(spark, FOLDER, "v_talk").collect()


def test_simhash_groups(spark, duck):
    want = {}
    for (s,) in duck.sql("SELECT text FROM conversations").fetchall():
        h = signed(simhash(skeleton(s)))
        want[h] = want.get(h, 0) + 1
    assert {r.hash: r.n for r in query(spark, "simhash_groups")} == want


def test_near_dup_groups(spark):
    by = {}
    for r in talk(spark):
        by.setdefault(r.author, []).append((r.post_id, simhash(skeleton(r.text))))
    want = set()
    for a, rows in by.items():
        found = leaders(sorted(rows), 6)
        want |= {(a, lead, i) for i, lead in found.items() if sum(x == lead for x in found.values()) > 1}
    assert {(r.author, r.leader, r.id) for r in query(spark, "near_dup_groups")} == want and want


def test_template_share_fuzzy(spark):
    by = {}
    for r in talk(spark):
        by.setdefault(r.author, []).append((r.post_id, r.text))
    got = {r.author: r.share for r in query(spark, "template_share_fuzzy")}
    assert got == pytest.approx({a: share(rows)[0] for a, rows in by.items() if share(rows)})
    assert any(0 < v < 1 for v in got.values())


def test_template_share_of_few_and_short_texts(spark):
    rows = [(1, i, "short") for i in range(4)] + [(2, 1, "one longer text"), (2, 2, "one longer text")] + [(3, i, f"the same words {'again' * (i > 2)}") for i in range(5)]
    got = {r.g: (r.share, r.n) for r in template_share(spark.createDataFrame(rows, "g long, id long, skel string"), "g", "id", "skel").collect()}
    assert got[2] == (0.0, 2) and got[3][0] == pytest.approx(0.6) and 1 not in got


def test_reply_template_ratio(spark):
    from tidepool.plans.views import view

    by = {}
    for r in view(spark, FOLDER, "v_social").filter("is_reply").collect():
        by.setdefault(r.token_key, []).append((r.post_id, r.text))
    want = {k: share(v) for k, v in by.items()}
    got = {r.token_key: (r.raw, r.evidence) for r in query(spark, "reply_template_ratio")}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items() if v}
    assert all((got[k][0] is None) == (v[1] < 6) and (got[k][0] is None or abs(got[k][0] - v[0]) < 1e-6) for k, v in want.items() if v)


# --- numbers and payloads ------------------------------------------------------------------


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(i, float(i % 17)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, x double")
    one, two = (tuple(bootstrap(d, "k", "x").first()) for d in (df.repartition(1), df.repartition(5)))
    assert one == pytest.approx(two)
    mean, half = np.mean([x for _, x in rows]), 1.96 * np.std([x for _, x in rows]) / math.sqrt(900)
    assert one == pytest.approx((mean - half, mean + half), abs=0.15 * half + 0.02)
    assert tuple(bootstrap(df.filter("k < 0"), "k", "x").first()) == (None, None)
    lo, hi = query(spark, "bootstrap_ci")[0]
    assert lo < hi


def test_phash_bits(spark, duck):
    from tidepool.functions.images import phash

    rng = np.random.default_rng(3)
    basis = [[math.cos(math.pi * (2 * j + 1) * u / 64) for j in range(32)] for u in range(8)]
    images = [rng.integers(0, 256, (32, 32)).astype(float) for _ in range(4)]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(images)] + [(9, None), (10, [1.0])], "i long, p array<double>")
    got = {r.i: r.h for r in df.select("i", phash("p").alias("h")).collect()}
    for i, p in enumerate(images):
        low = [sum(basis[u][y] * basis[v][x] * p[y, x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        mid = float(np.median(low[1:]))
        assert int(got[i], 16) == int("".join("1" if c > mid else "0" for c in low), 2)
    assert got[9] is None and got[10] is None
    assert len(query(spark, "phash_bits")) == duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]


def test_phash_clusters(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    bits = {i: sum(1 << k for k, x in enumerate(e) if x > 0) for i, e in rows}
    parent = {i: i for i in bits}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bits)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(bits[a] ^ bits[b]).count("1") <= 17:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    linked = {i for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(bits[a] ^ bits[b]).count("1") <= 17 for i in (a, b)}
    assert {r.v: r.component for r in query(spark, "phash_clusters")} == {i: root(i) for i in linked}


def test_curve_binary(spark, duck):
    got = query(spark, "curve_binary")
    ids = [r[0] for r in duck.sql("SELECT event_id FROM events").fetchall()]
    assert sorted(r.event_id for r in got) == sorted(ids)
    for r in got:
        tokens, sol = (int.from_bytes(v.to_bytes(8, "big"), "little") for v in (r.event_id * 1000 + 1, r.event_id * 10 + 1))
        real = int.from_bytes((7).to_bytes(8, "big"), "little")
        assert r.price == pytest.approx(sol / tokens) and r.progress == min(1.0, real / 85e9) and r.complete is False


def test_json_walk(spark, duck):
    import json

    want = []
    for event, k in duck.sql("SELECT event_id, json_extract(props, '$.k') FROM events").fetchall():
        want += [(event, "data.0.k", json.dumps(json.loads(k))), (event, "data.1.deep.k", "1")] if k is not None else []
    assert sorted(tuple(r) for r in query(spark, "json_walk")) == sorted(want)


def test_fit_and_ablation(spark):
    fitted = {r.metric_id: r for r in query(spark, "weight_fit")}
    assert len(fitted) > 1 and all(r.weight >= 0 and -1 <= r.holdout <= 1 for r in fitted.values()) and len({r.train for r in fitted.values()}) == 1
    assert {r.metric_id for r in query(spark, "ablation")} == set(fitted)


# --- folds -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("peak", "price", "held", "more", "want"),
    [
        (1.0, 1.0, 10, {"liquidity": 5000.0}, "drain"),
        (1.5, 1.01, 10, {}, "breakeven"),
        (1.3, 0.8, 10, {}, "stop"),
        (1.05, 1.05, 120, {}, "momentum"),
        (3.0, 2.2, 200, {}, "trail"),
        (1.5, 1.4, 21600, {}, "time"),
        (1.2, 1.2, 200, {}, ""),
    ],
)
def test_rules_that_sell_all(peak, price, held, more, want):
    row = types.SimpleNamespace(**({"entry": 1.0, "peak": peak, "price": price, "held": held, "liquidity": math.inf} | more))
    assert P.decide(P.sale_rules(P.Exit()), row) == want


@pytest.mark.parametrize(("sold", "multiple", "cap", "want"), [(0.0, 2.0, 0, [("take_1", 0.5)]), (0.5, 4.0, 0, [("take_2", 0.8)]), (0.5, 2.0, 0, []), (0.0, 1.5, 7e4, [("derisk", 0.7)]), (0.0, 2.0, 7e4, [("take_1", 0.5), ("derisk", 0.85)]), (0.8, 10.0, 7e4, [("take_3", 1.0)])])
def test_rules_that_sell_a_part(sold, multiple, cap, want):
    got = P.partial_sales(P.Exit(), sold, multiple, cap)
    assert [r for r, _ in got] == [r for r, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, ""), ({"size": 0.0}, "size"), ({"holding": True}, "holding"), ({"open": 3}, "slots"), ({"open": 2}, "elite"), ({"open": 2, "score": 0.96}, ""), ({"used": 140.0}, "exposure"), ({"cash": 0.0}, "cash"), ({"lost": 50.0}, "daily_loss"), ({"recent": 5}, "rate"), ({"age": 59.0}, "young"), ({"age": 21601.0}, "old"), ({"liquidity": 79.0}, "liquidity"), ({"liquidity": math.inf}, "")],
)
def test_rules_that_refuse(change, want):
    base = {"size": 40.0, "score": 0.8, "age": 100.0, "liquidity": 500.0, "holding": False, "open": 0, "used": 0.0, "cash": 1e6, "lost": 0.0, "recent": 0}
    assert P.decide(P.entry_rules(P.Risk()), types.SimpleNamespace(**(base | change))) == want


def test_daily_loss_stops_entries_until_the_next_day(spark):
    rows = [(1, k, k, k * 8000, 60.0, 0.8, 1e6, 100.0, -30.0) for k in range(14)]
    df = spark.createDataFrame(rows, "account long, token_key long, event_id long, as_of long, size double, score double, liquidity double, age double, pnl double")
    got = [(r.event_id, r.reason) for r in P.risk_entries(df).orderBy("event_id").collect()]
    first = next(i for i, why in got if why == "daily_loss")
    assert first == 2 and all(why == "daily_loss" for i, why in got if 2 <= i <= 10) and got[11][1] == ""


def test_positions_leave_in_parts(spark):
    marks = [(1, i, i * 10, p, None, None) for i, p in enumerate([1.0, 2.0, 4.0, 4.1, 3.0])] + [(2, 9, 0, 1.0, None, None), (2, 10, 5, 0.7, None, None)]
    df = spark.createDataFrame(marks, "token_key long, event_id long, as_of long, price double, liquidity double, market_cap double")
    got = [(r.token_key, r.event_id, r.rule, round(r.part, 9)) for r in P.exits(df).orderBy("token_key", "event_id").collect()]
    assert got == [(1, 1, "take_1", 0.5), (1, 2, "take_2", 0.3), (1, 4, "trail", 0.2), (2, 10, "stop", 1.0)]


def test_replay_marks_exits_scores_and_enters(spark):
    rows = [(1, 7, 1, 0, 1.0, 1e5, 0.9), (1, 7, 2, 60, 2.0, 1e5, 0.1), (1, 7, 3, 90, 0.5, 1e5, 0.9), (1, 8, 4, 100, 1.0, 1e5, 0.5), (1, 9, 5, 110, 4.0, 1e5, 0.9), (1, 9, 6, 120, 5.0, 1e5, 0.2)]
    df = spark.createDataFrame(rows, "account long, token_key long, event_id long, as_of long, price double, liquidity double, score double")
    got = {r.token_key: r for r in P.replay(df).collect()}
    size = P.entry_size(P.Risk(), types.SimpleNamespace(score=0.9, used=0.0, cash=1e9))
    assert set(got) == {7, 9} and got[7].rule == "breakeven" and got[7].returned == pytest.approx(size * (0.5 * 2 + 0.5 * 0.5))
    assert got[9].rule == "open" and got[9].closed == -1 and got[9].returned == pytest.approx(got[9].spent * 1.25)


def snapshots(spark, folder=FOLDER):
    from tidepool.plans.views import view

    by = {}
    for r in view(spark, folder, "v_snapshots").orderBy("as_of", "event_id").collect():
        by.setdefault(r.token_key, []).append(r)
    return by


def test_exit_policy(spark):
    """Every position by hand: one mark after another."""
    want = set()
    for token, marks in snapshots(spark).items():
        entry, top, gone = marks[0].price, marks[0].price, 0.0
        for m in marks[1:]:
            top = max(top, m.price)
            if entry <= 0 or m.price <= 0 or gone >= 1 - 1e-9:
                continue
            x, age = m.price / entry, m.as_of - marks[0].as_of
            whole = [
                r
                for r, ok in (("drain", m.liquidity * 100 < 5600), ("breakeven", top >= 1.4 * entry and x <= 1.02), ("stop", x <= 0.8), ("momentum", age >= 120 and x < 1.1), ("trail", top >= 2 * entry and 1 - m.price / top >= 0.25), ("time", age >= 21600))
                if ok
            ]
            if whole:
                want.add((token, m.event_id, whole[0], round(1 - gone, 6)))
                break
            before = gone
            for name, target, level in (("take_1", 2, 0.5), ("take_2", 4, 0.8), ("take_3", 10, 1.0)):
                if x >= target and before < level - 1e-6:
                    want.add((token, m.event_id, name, round(level - gone, 6)))
                    gone = level
                    break
            if m.liquidity * 400 >= 65000 and before < 1 and (0.7 - before) / (1 - before) > 0.05 and gone < 1 - 1e-9:
                part = (0.7 - before) / (1 - before) * (1 - gone)
                want.add((token, m.event_id, "derisk", round(part, 6)))
                gone += part
    got = [(r.token_key, r.event_id, r.rule, round(r.part, 6)) for r in query(spark, "exit_policy")]
    assert len(got) == len(set(got)) and set(got) == want and len({r for _, _, r, _ in want}) > 2


def test_stream_exits(spark, duck):
    """Every user's events by hand, with six idle hours between marks or before the stream's last moment."""
    rows = duck.sql("SELECT user_id, event_id, epoch(ts) AS at, value FROM events ORDER BY ts, event_id").fetchall()
    end, want = max(r[2] for r in rows) - 60, []
    rules = P.sale_rules(P.Exit())
    for token in {r[0] for r in rows}:
        p = None
        for _, event, at, price in [r for r in rows if r[0] == token]:
            if p is not None and at - p.last >= 21600:
                want += [(token, -1, "idle", 1 - p.sold)] if p.sold < 1 - 1e-9 else []
                p = None
            if p is None:
                p = types.SimpleNamespace(opened=at, entry=price, peak=price, sold=0.0, last=at)
                continue
            p.last, p.peak = at, max(p.peak, price)
            if p.sold >= 1 - 1e-9 or p.entry <= 0 or price <= 0:
                continue
            rule = P.decide(rules, types.SimpleNamespace(price=price, entry=p.entry, peak=p.peak, held=at - p.opened, liquidity=price * (1 + event % 9) * 100))
            for name, to in [(rule, 1.0)] if rule else P.partial_sales(P.Exit(), p.sold, price / p.entry, price * 1000):
                if to > p.sold:
                    want.append((token, event, name, to - p.sold))
                    p.sold = to
        if p.last + 21600 < end and p.sold < 1 - 1e-9:
            want.append((token, -1, "idle", 1 - p.sold))
    got = [(r.token_key, r.event_id, r.rule, round(r.part, 9)) for r in query(spark, "stream_exits")]
    assert sorted(got) == sorted((a, b, c, round(d, 9)) for a, b, c, d in want) and len({r[2] for r in got}) > 2


def test_risk_entry(spark):
    """Every account by hand."""
    by, want = {}, {}
    for token, marks in snapshots(spark).items():
        for m in marks:
            by.setdefault(token // 8, []).append(m)
    for rows in by.values():
        taken, lost = [], []
        for m in sorted(rows, key=lambda m: (m.as_of, m.event_id)):
            score, age = m.event_id % 101 / 100, m.event_id % 9000
            lost += [(t.end, max(0, 50 - t.m.price)) for t in taken if t.end <= m.as_of and not t.done]
            for t in taken:
                t.done = t.done or t.end <= m.as_of
            live = [t for t in taken if t.end > m.as_of]
            chance = min(0.75, max(0.4, 0.4 + score - 0.65))
            edge = (chance * 2.5 - (1 - chance)) / 2.5
            size = min(60 * min(1, max(0.1, edge * 0.25 * 3.5)), 140 - sum(t.size for t in live))
            day = sum(v for end, v in lost if end // 86400 == m.as_of // 86400)
            tests = [("size", m.price <= 0), ("holding", any(t.m.token_key == m.token_key for t in live)), ("slots", len(live) >= 3), ("elite", len(live) >= 2 and score < 0.95), ("exposure", sum(t.size for t in live) >= 140), ("cash", size <= 1e-6), ("daily_loss", day >= 50), ("rate", sum(t.m.as_of >= m.as_of - 3600 for t in taken) >= 5), ("young", age < 60), ("old", age > 21600), ("liquidity", m.liquidity < 80)]
            why = next((n for n, hit in tests if hit), "")
            want[m.event_id] = (why, 0 if why else size)
            if not why:
                taken.append(types.SimpleNamespace(m=m, end=m.as_of + 7200, size=size, done=False))
    got = {r.event_id: (r.reason, r.taken) for r in query(spark, "risk_entry")}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len({v[0] for v in want.values()}) > 3
    assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(want)])


def test_backtest_replay(spark):
    """Positions don't overlap within a token, spend a size within the limits, and return what their marks make of the parts sold."""
    larger = "/root/testdata/sf0.01"
    by = snapshots(spark, larger)
    got = catalog.QUERIES["backtest_replay"](spark, larger).collect()
    assert got and all(0 < r.spent <= 60 and r.account == r.token_key // 8 for r in got)
    for r in got:
        path = [m.price for m in by[r.token_key] if m.as_of >= r.opened and (r.closed < 0 or m.as_of <= r.closed)]
        assert r.spent * min(path) / path[0] - 1e-9 <= r.returned <= r.spent * max(path) / path[0] + 1e-9
        assert (r.rule == "open") == (r.closed == -1)
    for token in {r.token_key for r in got}:
        own = sorted((r.opened, r.closed) for r in got if r.token_key == token)
        assert all(0 <= a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_a_row_of_each_event_is_judged(spark):
    assert len(query(spark, "risk_entry")) == spark.read.parquet(f"{FOLDER}/events.parquet").agg(F.count("*")).first()[0]
