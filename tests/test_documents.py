"""Nested documents and funding, against plain Python on random documents."""

import json
import random

from tidepool.sources import documents as D


def nested(rng, depth=0):
    kind = rng.random()
    if depth < 5 and kind < 0.35:
        return {rng.choice(("a", "b", "k", "x/y", "~")): nested(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 5 and kind < 0.6:
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice((None, True, False, 0, -7, 1.5, 10**20, "", "text", "é\n"))


def leaves(node, path=""):
    inner = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    out = [x for k, v in inner for x in leaves(v, path + "/" + str(k).replace("~", "~0").replace("/", "~1"))]
    return out or [(path, None if node is None or isinstance(node, (dict, list)) else node if isinstance(node, str) else json.dumps(node))]


def found(node, field, path=()):
    inner = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    out = []
    for k, v in inner:
        here = (*path, k)
        if k == field and isinstance(node, dict):
            out.append((".".join(map(str, here)), json.dumps(v)))
        out += found(v, field, here)
    return out


def test_leaves_and_fields_of_random_documents(spark):
    rng = random.Random(5)
    docs = [(i, json.dumps(nested(rng))) for i in range(150)] + [(900, None), (901, "{"), (902, "")]
    df = spark.createDataFrame(docs, "id long, doc string")
    got, hits = {}, {}
    for r in D.leaves(df, "doc").collect():
        got.setdefault(r.id, []).append((r.path, r.value))
    for r in D.json_walk(df, "id", "doc", "k").collect():
        hits.setdefault(r.id, []).append((r.path, r.value))
    assert {900, 901, 902}.isdisjoint(got)
    assert got == {i: leaves(json.loads(d)) for i, d in docs[:150]}
    assert hits == {i: f for i, d in docs[:150] if (f := found(json.loads(d), "k"))}


def test_a_search_is_bounded(spark):
    deep = {"k": 1}
    for _ in range(30):
        deep = {"k": deep}
    df = spark.createDataFrame([(1, json.dumps([{"k": i} for i in range(700)])), (2, json.dumps(deep))], "id long, doc string")
    rows = D.json_walk(df, "id", "doc", "k").collect()
    assert [r.value for r in rows if r.id == 1] == [str(i) for i in range(D.MAX_HITS)]
    assert sum(r.id == 2 for r in rows) == D.MAX_DEPTH + 1


def plain_funder(doc, wallet):
    try:
        tx = json.loads(doc)
    except (TypeError, ValueError):
        return None, "no-transaction"
    message, meta = tx.get("transaction", {}).get("message", {}), tx.get("meta", {})
    steps = message.get("instructions", []) + [x for g in meta.get("innerInstructions", []) for x in g.get("instructions", [])]
    infos = [s["parsed"]["info"] for s in steps if isinstance(s.get("parsed"), dict)]
    good = lambda who: who and who != wallet and who not in D.NON_FUNDERS
    for name, pairs in (("transfer", [(i.get("source") or i.get("lamportsSource"), i.get("destination") or i.get("newAccount")) for i in infos]), ("account-payer", [(i.get("source"), i.get("wallet") or i.get("owner")) for i in infos])):
        for who, whom in pairs:
            if whom == wallet and good(who):
                return who, name
    keys = [k["pubkey"] if isinstance(k, dict) else k for k in message.get("accountKeys", [])]
    pre, post = meta.get("preBalances", []), meta.get("postBalances", [])
    if wallet in keys and len(keys) == len(pre) == len(post) and post[keys.index(wallet)] > pre[keys.index(wallet)]:
        losses = [(a - b, -i, k) for i, (k, a, b) in enumerate(zip(keys, pre, post, strict=True)) if good(k) and a > b]
        if losses:
            return max(losses)[2], "balance-delta"
    return None, "none"


def test_funders_of_random_transactions(spark):
    rng = random.Random(8)
    who = lambda: rng.choice(("w", "s1", "s2", D.NON_FUNDERS[0], ""))
    info = lambda: {f: who() for f in ("destination", "newAccount", "source", "lamportsSource", "wallet", "owner") if rng.random() < 0.45}
    step = lambda: rng.choice(({}, {"parsed": "text"}, {"parsed": {"info": info()}}, {"parsed": {"info": info()}}))
    docs = []
    for i in range(250):
        keys = rng.sample(["w", "s1", "s2", "s3", D.NON_FUNDERS[1]], rng.randint(0, 5))
        n = len(keys) if rng.random() < 0.85 else 2
        tx = {"transaction": {"message": {"instructions": [step() for _ in range(rng.randint(0, 12))] if rng.random() < 0.6 else [], "accountKeys": [{"pubkey": k} if i % 2 else k for k in keys]}}, "meta": {"innerInstructions": [{"instructions": [step() for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 2))] if rng.random() < 0.5 else [], "preBalances": [rng.randint(0, 9) for _ in range(n)], "postBalances": [rng.randint(0, 9) for _ in range(n)]}}
        docs.append((i, "w", json.dumps(tx) if i % 25 else rng.choice((None, "{"))))
    got = {r.tx_id: (r.funder, r.mechanism) for r in D.funders(spark.createDataFrame(docs, "tx_id long, wallet string, doc string")).collect()}
    want = {i: plain_funder(d, w) for i, w, d in docs}
    assert got == want and len({m for _, m in want.values()}) == 5


def test_funders_go_by_row_without_a_shuffle(spark):
    """Rows that share a number keep their own documents, an account whose balance isn't a number counts as unknown, and nothing is shuffled."""
    tx = lambda who, pre="1": json.dumps({"transaction": {"message": {"accountKeys": ["w", who], "instructions": []}}, "meta": {"preBalances": [pre, 9], "postBalances": [5, 2]}})
    df = D.funders(spark.createDataFrame([(1, "w", tx("s1")), (1, "w", tx("s2")), (2, "w", tx("s3", "much")), (None, "w", tx("s4"))], "tx_id long, wallet string, doc string"))
    assert sorted((r.tx_id or 0, r.funder or "", r.mechanism) for r in df.collect()) == [(0, "s4", "balance-delta"), (1, "s1", "balance-delta"), (1, "s2", "balance-delta"), (2, "", "none")]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
