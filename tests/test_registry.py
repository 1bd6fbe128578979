"""The metric registry: what it rejects, plugins, exclusion and readings."""

import math

import pytest
from pyspark.sql import functions as F

from tidepool.plans.metric_registry import PEERS, REGISTRY, Metric, MetricRegistry


def test_registry_rejects_unsound_metrics():
    registry = MetricRegistry()
    registry.custom("mine", gameability="by volume")(lambda t: None)
    for bad in (Metric("mine", "f", "bullish", "x", None), Metric("unset", "f", "bullish", "x", None), Metric("", "f", "bullish", "x", None), Metric("other", "f", "bullish", "", None), Metric("other", "f", "up", "x", None)):
        with pytest.raises(ValueError, match="needs"):
            registry.add(bad)
    assert list(registry) == ["mine"] and registry["mine"].direction == "bullish" and registry.get("none") is None


def test_metrics_can_be_left_out():
    assert len(REGISTRY) == 34 and len({m.family for m in REGISTRY.values()}) == 6
    left_out = ("ticker_contention", "meta_alignment")
    less = REGISTRY.where(lambda m: m.id not in left_out)
    assert len(less) == 32 and list(less) == [i for i in REGISTRY if i not in left_out]


def test_all_metrics_in_one_plan(spark):
    """Every reading of every metric, from the metrics' own rows, in plain Python."""
    from tidepool.plans import catalog, metrics
    from tidepool.plans.views import view

    folder = "/root/testdata/sf0.001"
    created = {r.token_key: r.created_at for r in view(spark, folder, "v_launches").collect()}
    read, trust = {}, {}
    for id, m in REGISTRY.items():
        rows = [(r.token_key, None if r.raw is None or not math.isfinite(r.raw) else float(r.raw), r.evidence) for r in catalog.QUERIES[id](spark, folder).collect()]
        values = sorted(v for _, v, _ in rows if v is not None)
        for token, raw, evidence in rows:
            old = token in created and metrics.T - created[token] < m.earliest
            state = "missing" if raw is None or evidence <= 0 else "low" if old or evidence < m.least else "medium" if evidence < 3 * m.least else "high"
            trust[id, token] = state
            if state != "missing":
                v = sum(x <= raw for x in values) / len(values) if len(values) >= PEERS else 1 / (1 + math.exp(-max(-60, min(60, m.steepness * (raw - m.midpoint)))))
                read[id, token] = 1 - v if m.direction == "bearish" else v
    registered = catalog.QUERIES["metric_normalize"](spark, folder)
    got = {(r.metric_id, r.token_key): r.normalized for r in registered.collect()}
    assert set(got) == set(read) and len({i for i, _ in got}) > 25
    assert all(got[k] == pytest.approx(read[k], abs=2e-6) for k in read)
    assert {(r.metric_id, r.token_key): r.confidence for r in catalog.QUERIES["metric_confidence"](spark, folder).collect()} == trust


def test_plugins_are_read_like_any_metric(spark):
    def rows(n):
        values = [(i, float(i) if i % 5 else None, i) for i in range(n)] + [(n, float("nan"), 9)]
        return lambda t: spark.createDataFrame(values, "token_key long, raw double, evidence long")

    registry = MetricRegistry()
    registry.custom("few", direction="bearish", midpoint=5.0, steepness=0.5, earliest=50.0, least=4)(rows(20))
    registry.custom("many", least=10, sources=("feed",))(rows(60))
    ages = spark.createDataFrame([(i, 10 * i) for i in range(70)], "token_key long, age long")
    got = {(r.metric_id, r.token_key): r for r in registry.evaluate(None, ages).collect()}
    for i in range(20):
        r = got["few", i]
        if i % 5 == 0:
            assert r.normalized is None and r.confidence == "missing"
            continue
        assert r.normalized == pytest.approx(1 - 1 / (1 + math.exp(-0.5 * (i - 5))))
        assert r.confidence == ("low" if 10 * i < 50 or i < 4 else "medium" if i < 12 else "high")
    peers = [i for i in range(60) if i % 5]
    assert len(peers) >= PEERS and all(got["many", i].normalized == pytest.approx(sum(p <= i for p in peers) / len(peers)) for i in peers)
    assert got["few", 20].normalized is None and got["many", 60].confidence == "missing"
    dark = registry.evaluate(None, ages, degraded=("feed",)).filter("metric_id = 'many' AND raw IS NOT NULL").select(F.collect_set("confidence")).first()[0]
    assert dark == ["low"]


def test_metrics_share_their_views_and_run_in_jobs_of_their_own(spark):
    from tidepool.plans.registry import Kept, Tables

    kept = Kept(Tables(spark, "/root/testdata/sf0.001"))
    trades = kept("v_trades")
    files = lambda df: {f.rsplit("/", 2)[1 if "testdata" not in f else 2].removesuffix(".parquet") for f in df.inputFiles()}
    assert kept("v_trades") is trades and {"lineitem", "orders"}.isdisjoint(files(kept("v_holders")) | files(kept("v_launches")))
    registry = MetricRegistry()
    asked = []
    for name in ("one", "two"):
        registry.custom(name)(lambda t: asked.append(1) or t("v_launches").groupBy("token_key").agg(F.count("*").alias("raw"), F.count("*").alias("evidence")))
    found = registry.evaluate(kept, kept("v_launches").selectExpr("token_key", "1500 AS age"))
    assert len(asked) == 2 and found.count() == 2 * kept("v_launches").count()
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles() if "part=" in f}) == 2
    kept.discard()


@pytest.mark.parametrize("name", ["training_examples", "deployer_behaviour_now", "veto_set", "sniper_supply_share", "evidence_rank", "veto_histogram"])
def test_trades_and_launches_are_evaluated_once(spark, monkeypatch, name):
    """Each evaluation of the trades is a shuffle of lineitem and orders, so a query that reads them several times has them written."""
    from tidepool.plans import catalog, registry

    made, view = [], registry.view
    monkeypatch.setattr(registry, "view", lambda spark, sf_dir, name, over=None: made.append(name) or view(spark, sf_dir, name, over))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made.count("v_trades") == made.count("v_launches") == 1
