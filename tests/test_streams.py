"""Streams of several files: results equal the batch plan, also with late rows and after a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepool.operators.graph import label_components
from tidepool.streaming import jobs

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def part(number, late=False):
    start = datetime(2024, 1, 1) + timedelta(hours=0 if late else 10 * number)
    return [(100 * number + i, start + timedelta(minutes=5 * i), (i * 7 + number) % 9, "ab"[i % 2], float((i * 13 + number * 5) % 31), "{}") for i in range(60)]


@pytest.fixture
def source(spark, tmp_path):
    """Adds parts as files of one folder; returns (add, stream)."""
    (tmp_path / "in").mkdir()

    def add(number, late=False):
        rows = part(number, late)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part-{number}")
        (made,) = (tmp_path / f"part-{number}").glob("*.parquet")
        made.rename(tmp_path / "in" / f"events-{number}.parquet")
        return rows

    return add, lambda: jobs.events(spark, f"{tmp_path}/in", "events-*.parquet")


def test_positions_and_upserts_over_batches(source):
    add, stream = source
    rows = [r for n in range(3) for r in add(n)]
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    got = {r.token_key: (r.peak, r.low, r.n) for r in jobs.drain(jobs.positions(stream()), "update", ["token_key"]).collect()}
    assert got == {k: (max(r[4] for r in v), min(r[4] for r in v), len(v)) for k, v in by.items()}
    got = {r.token_key: (r.first_id, r.n) for r in jobs.upsert(stream()).collect()}
    assert got == {k: (min(r[0] for r in v), len(v)) for k, v in by.items()}
    got = jobs.drain(jobs.unseen(stream())).collect()
    assert sorted((r.token_key, r.kind) for r in got) == sorted({(r[2], r[3]) for r in rows})


def test_restart_goes_on_from_the_checkpoint(spark, source, tmp_path):
    add, stream = source
    rows = [r for n in range(2) for r in add(n)]
    at = f"file://{tmp_path}/job"
    assert jobs.upsert(stream(), at).agg(F.sum("n")).first()[0] == len(rows)
    rows += add(2)
    got = {r.token_key: (r.first_id, r.n) for r in jobs.upsert(stream(), at).collect()}
    assert got == {k: (min(r[0] for r in rows if r[2] == k), sum(r[2] == k for r in rows)) for k in {r[2] for r in rows}}


def test_rows_behind_the_watermark_are_dropped(source):
    add, stream = source
    first, second = add(0) + add(1), add(2)
    late = add(3, late=True)  # a batch is held against the watermark that the batch before the last has left
    got = {r.start: r.n for r in jobs.drain(jobs.tumbling(stream())).collect()}
    newest = max(r[1] for r in first + second)
    want = {}
    for r in first + second:
        hour = r[1].replace(minute=0)
        if hour + timedelta(hours=1) <= newest - timedelta(hours=2):
            want[hour] = want.get(hour, 0) + 1
    assert got == want and all(r[1] < newest - timedelta(hours=2) for r in late[:12])


def test_budget_stops_a_job_and_the_rest_comes_later(spark, source, tmp_path):
    add, stream = source
    rows = [r for n in range(3) for r in add(n)]
    at = f"file://{tmp_path}/budget"
    jobs.run(stream(), at, budget=jobs.Budget(batches=1))
    jobs.run(stream(), at)
    kept = jobs.batches(spark, at, stream().schema)
    assert sorted(r.event_id for r in kept.collect()) == sorted(r[0] for r in rows)
    assert not jobs.Budget().spent(10**9, 10**9, 1e9) and jobs.Budget(rows=5).spent(0, 5, 0)
    assert {r.batch: r.rows for r in jobs.heartbeat(stream()).collect()} == {0: 60, 1: 60, 2: 60}


def test_damaged_frames_are_counted(source):
    add, stream = source
    rows = add(0)
    got = jobs.drain(jobs.ingest(jobs.frames(stream()))).collect()
    assert sum(r.unparsed for r in got) == sum(r[0] % 50 == 0 for r in rows) > 0 and len(got) == len(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 501)], "u long, v long")
    got = {r.v: r.component for r in label_components(edges).collect()}
    assert got == {**dict.fromkeys(range(121), 0), 500: 500, 501: 500}
    with pytest.raises(RuntimeError):
        label_components(edges, rounds=1)


def test_the_ledger_has_empty_and_failed_batches(spark, source, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tidepool.streaming.ledger import Ledger

    add, stream = source
    add(0)
    add(1)
    at = f"file://{tmp_path}/ledger-job"
    with Ledger(spark, at) as ledger:
        jobs.run(stream().filter("event_id < 0"), at)  # batches that give no rows
        jobs.run(stream().filter("event_id < 0"), at)  # a run without anything new
        broken = stream().select(F.when(F.col("event_id") == 130, F.raise_error(F.lit("damaged"))).otherwise(F.col("event_id")).alias("event_id"))
        with pytest.raises(StreamingQueryException):
            jobs.run(broken, f"{at}-broken")
    rows = ledger.rows().collect()
    runs = {}
    for r in rows:
        runs.setdefault(r.run_id, {})[r.batch] = (r.state, r.rows)
    assert len(runs) == 3 and len(rows) == len({(r.run_id, r.batch) for r in rows})
    whole = [r for r in runs.values() if r.get(1, ("", 0))[0] == "done"]
    assert whole == [{-1: ("started", 0), 0: ("done", 0), 1: ("done", 0), -2: ("ended", 0)}]
    failed = [r for r in runs.values() if any(s == "failed" for s, _ in r.values())]
    assert failed == [{-1: ("started", 0), 0: ("done", 60), 1: ("failed", 0)}]
    assert any("damaged" in (r.message or "") or "Exception" in (r.message or "") for r in rows if r.state == "failed")


def marks(number):
    """Three tokens; one falls silent after the first file and one comes back after a long gap."""
    start = datetime(2024, 1, 1) + timedelta(minutes=10 * number)
    out = []
    for token, prices in ((1, ([1.0, 1.3, 2.1], [1.9, 4.2, 4.0], [3.0, 2.9, 1.0])), (2, ([1.0, 1.05, 1.2], [], [])), (3, ([1.0, 0.7], [], [5.0, 5.1, 12.0]))):
        out += [(100 * number + 10 * token + i, start + timedelta(seconds=50 * i), token, p, 1e5, 7e4 if token == 3 else None) for i, p in enumerate(prices[number])]
    return out


def test_exits_over_batches_with_a_restart_and_idle_tokens(spark, tmp_path):
    kind = "event_id long, ts timestamp_ntz, token_key long, price double, liquidity double, market_cap double"
    (tmp_path / "marks").mkdir()
    schema = spark.createDataFrame([], kind).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/marks")
    at, idle = f"file://{tmp_path}/exits", 700

    def add(number):
        spark.createDataFrame(marks(number) + [(9000 + number, datetime(2024, 1, 1) + timedelta(minutes=10 * number), 9, 1.0, 1e5, None)], kind).coalesce(1).write.parquet(f"{tmp_path}/m-{number}")
        (made,) = (tmp_path / f"m-{number}").glob("*.parquet")
        made.rename(tmp_path / "marks" / f"m-{number}.parquet")

    add(0)
    add(1)
    jobs.run(jobs.exits(stream(), idle=idle), at)  # then a new start at the same place
    add(2)
    found = jobs.exits(stream(), idle=idle)
    jobs.run(found, at)
    got = sorted((r.token_key, r.event_id, r.rule, round(r.part, 6)) for r in jobs.batches(spark, at, found.schema).collect() if r.token_key != 9)

    from tidepool.operators.portfolio import Exit, decide, partial_sales, sale_rules
    from types import SimpleNamespace

    want, rules = [], sale_rules(Exit())
    rows = [m for n in range(3) for m in marks(n)]
    for token in (1, 2, 3):
        own, p = sorted((m for m in rows if m[2] == token), key=lambda m: m[1]), None
        for m in [*own, None]:
            now = m[1].timestamp() if m else float("inf")
            if p and now - p.last >= idle and (m or token == 2):
                if p.sold < 1:
                    want.append((token, -1, "idle", round(1 - p.sold, 6)))
                p = None
            if m is None:
                break
            if p is None:
                p = SimpleNamespace(opened=now, entry=m[3], peak=m[3], sold=0.0, last=now)
                continue
            p.last, p.peak = now, max(p.peak, m[3])
            if p.sold >= 1:
                continue
            rule = decide(rules, SimpleNamespace(price=m[3], entry=p.entry, peak=p.peak, held=now - p.opened, liquidity=m[4]))
            for name, to in [(rule, 1.0)] if rule else partial_sales(Exit(), p.sold, m[3] / p.entry, m[5] or 0.0):
                want.append((token, m[0], name, round(to - p.sold, 6)))
                p.sold = to
    assert got == sorted(want) and {"idle", "stop"} <= {r for _, _, r, _ in got}
