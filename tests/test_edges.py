"""Values at which the engines part: zero prices, sums at a threshold, ties; each query against its twin on small tables of its own."""

import datetime
import math
import os

import duckdb
import pytest

from tidepool.plans import catalog

BASE = "/root/testdata/sf0.001"


def norm(rows):
    one = lambda x: "~" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.8g}" if isinstance(x, float) else str(x)
    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with prices of zero: alone, first, in the middle and at a time that a trade is matched with."""
    at = tmp_path_factory.mktemp("edges")
    con = duckdb.connect()
    for f in os.listdir(BASE):
        if f != "events.parquet":
            os.symlink(f"{BASE}/{f}", at / f)
    con.sql(f"CREATE TABLE events AS SELECT * REPLACE (CASE WHEN event_id % 7 = 0 OR user_id % 5 = 1 THEN 0e0 ELSE value END AS value) FROM '{BASE}/events.parquet'")
    con.sql("INSERT INTO events SELECT 1000000, TIMESTAMP '2024-01-05 00:00:00', 900000, 'view', 0e0, '{\"k\": 1}'")
    # A second of event time that a buy is matched with: as_of * 1000.
    token, day = con.sql(f"SELECT l_partkey, min(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) FROM '{BASE}/lineitem.parquet' JOIN '{BASE}/orders.parquet' ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND o_orderdate >= DATE '1995-01-01' GROUP BY 1 ORDER BY 1 LIMIT 1").fetchall()[0]
    when = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=day * 1000 - 5)
    con.sql(f"INSERT INTO events SELECT 1000001, TIMESTAMP '{when}', {token}, 'view', 0e0, '{{\"k\": 1}}'")
    con.sql(f"COPY events TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def same_as_twin(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = catalog.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    assert norm(got.select(*columns).collect()) == norm(con.sql("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), catalog.ORACLES[name])).fetchall())


def test_a_price_of_zero_has_no_leading_digit(spark):
    from tidepool.functions.stats import leading_digit

    rows = spark.createDataFrame([(0.0,), (0.004,), (120.5,), (None,)], "x double").select(leading_digit("x"))
    assert [r[0] for r in rows.collect()] == [None, 4, 1, None]


def test_reserves_at_a_price_of_zero(spark, folder):
    same_as_twin(spark, folder, "curve_reserves")


def test_a_quotient_just_under_half_rounds_down(spark):
    from tidepool.functions.stats import quotient, rounded

    rows = spark.createDataFrame([(32.55, 32.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (2.5, 1000.0)], "a double, b double").select(rounded(quotient("a", "b"), 6))
    found = [r[0] for r in rows.collect()]
    assert found[:3] == [1.017187, math.inf, -math.inf] and math.isnan(found[3]) and found[4:] == [None, 0.0025]


def test_a_number_too_large_to_scale_stays_as_it_is(spark):
    from tidepool.functions.stats import rounded

    values = [3e304, -3e304, 1.7976931348623157e308, math.inf, 1e301]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(rounded("x", 6))
    assert [r[0] for r in rows.collect()] == values


def test_reserves_at_prices_near_zero(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (value * 1e-305 AS value) FROM '{BASE}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    same_as_twin(spark, str(tmp_path), "curve_reserves")


def test_volatility_over_prices_of_zero(spark, folder):
    same_as_twin(spark, folder, "realized_vol")


def test_a_price_of_zero_leaves_no_half_life(spark, folder):
    same_as_twin(spark, folder, "half_life")


def test_fills_against_a_price_of_zero(spark, folder):
    got = catalog.QUERIES["fill_calibration"](spark, folder).first()
    assert got.observed == math.inf  # the table has such a pair
    same_as_twin(spark, folder, "fill_calibration")


def test_stability_of_a_price_that_fell_to_zero(spark, folder):
    same_as_twin(spark, folder, "price_stability_under_flow")


def test_sums_at_a_threshold_are_those_in_wallet_order(spark):
    from tidepool.plans.views import view

    at, sums = "/root/testdata/sf0.1", {}
    for r in sorted(view(spark, at, "v_holders").filter("label IN ('FURNITURE', 'BUILDING')").select("wallet", "token_key", "label", "share").collect()):
        sums[r.token_key, r.label] = sums.get((r.token_key, r.label), 0.0) + r.share
    got = catalog.QUERIES["bundle_sybil"](spark, at).collect()
    part = lambda r, label: sums.get((r.token_key, label), 0.0)
    want = {r.token_key: part(r, "FURNITURE") >= 0.25 or (part(r, "FURNITURE") >= 0.2 and part(r, "BUILDING") >= 0.2) for r in got}
    assert {r.token_key: r.sybil for r in got} == want


def test_a_concentration_at_its_limit_counts_as_in_the_twin(spark):
    same_as_twin(spark, "/root/testdata/sf0.1", "veto_histogram")


def test_equal_contributions_are_in_order_of_their_source(spark, tmp_path):
    stamp = datetime.datetime(2024, 1, 2)
    rows = [(0, stamp, 1, "view", 0.1, "{}"), (1, stamp, 1, "view", 0.2, "{}"), (2, stamp, 1, "view", 0.3, "{}"), (3, stamp, 1, "click", 0.6, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["top_contributions"](spark, str(tmp_path)).first().top == "click,view"


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Events some of which have no token, no time, no price or none of them; no token has two at one second."""
    at = tmp_path_factory.mktemp("gaps")
    missing = "CASE WHEN event_id % 13 = 5 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 11 = 3 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 7 = 2 THEN NULL ELSE value END AS value"
    duckdb.sql(f"COPY (SELECT * REPLACE ({missing}) FROM '{BASE}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def test_what_has_no_token_or_time_is_before_nothing(spark, gaps):
    same_as_twin(spark, gaps, "asof_backward")


def test_what_has_no_token_or_time_is_after_nothing(spark, gaps):
    same_as_twin(spark, gaps, "asof_forward")


def test_texts_pass_to_python_in_small_batches(spark):
    """Normal texts and simhashes take a hundred texts at a time, so a worker's memory doesn't grow with a partition's rows up to ten thousand long texts."""
    from tidepool.functions import text as X
    from tidepool.operators.neardup import simhash

    rows = spark.createDataFrame([(0, "Ünï\u200bcode  TEXT "), (1, None), (2, "")], "i long, text string")
    for f in (X.normalize, simhash):
        assert "ArrowEvalPython" not in rows.select(f("text"))._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in rows.orderBy("i").select(X.normalize("text").alias("t")).collect()] == ["unicode text", None, ""]
    assert [r.h for r in rows.orderBy("i").select(simhash("text").alias("h")).collect()][1:] == [0, 0]
