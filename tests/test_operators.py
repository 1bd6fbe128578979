"""Edge cases of the operators on inline rows."""

import pytest
from pyspark.sql import functions as F

from tidepool.functions import stats
from tidepool.operators import graph, pit, sequence, similarity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_future_rows_are_invisible_on_both_axes(spark):
    df = spark.createDataFrame([(1, 5, 5), (1, 5, 20), (1, 20, 5)], "k int, as_of int, observed_at int")
    assert rows(pit.pit_filter(df, 10)) == [(1, 5, 5)]


def test_latest_version_is_taken_after_the_bounds(spark):
    df = spark.createDataFrame([(1, 5, 5, "old"), (1, 8, 30, "unknown yet")], "k int, as_of int, observed_at int, v string")
    assert pit.latest_by(pit.pit_filter(df, 10), ["k"], ["as_of"]).first()["v"] == "old"


def test_as_of_joins_at_ties_and_ends(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, as_of int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 7, 2)], "k string, as_of int, v int")
    back = rows(pit.asof_backward(left, right, ["k"]).select("k", "as_of", F.coalesce("right_v", F.lit(-1))))
    ahead = rows(pit.asof_forward(left, right, ["k"]).select("k", "as_of", F.coalesce("right_v", F.lit(-1))))
    assert back == [("a", 1, -1), ("a", 5, 1), ("a", 9, 2), ("b", 5, -1)]
    assert ahead == [("a", 1, 1), ("a", 5, 2), ("a", 9, -1), ("b", 5, -1)]


def test_as_of_keeps_a_null_payload_apart_from_no_match(spark):
    left = spark.createDataFrame([("a", 9)], "k string, as_of int")
    right = spark.createDataFrame([("a", 1, 4), ("a", 5, None)], "k string, as_of int, v int")
    r = pit.asof_backward(left, right, ["k"]).first()
    assert (r["right_as_of"], r["right_v"]) == (5, None)


def test_sessions_break_over_the_tolerance_only(spark):
    df = spark.createDataFrame([(1, 0), (1, 30), (1, 61)], "k int, t int")
    assert rows(sequence.sessionize(df, ["k"], "t", [], 30).select("t", "session")) == [(0, 0), (30, 0), (61, 1)]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 30, 40)], "k int, v int")
    assert sequence.nearest_rank(df, ["k"], "v", {"p": 0.5}).first()["p"] == 30


@pytest.mark.parametrize(("x", "want"), [(None, None), (float("nan"), 0.0), (-1.0, 0.0), (0.5, 0.5), (9.0, 1.0)])
def test_clamp_keeps_absence(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(stats.clamp("x").alias("v")).first()["v"] == want


def test_wilson_without_trials_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (5, 5)], "k int, n int")
    got = [r["v"] for r in df.select(stats.wilson("k", "n").alias("v")).collect()]
    assert got[0] == 0 and 0.5 < got[1] < 0.6


def test_hamming_pairs_lose_none(spark):
    values = [0, 1, 3, 255, -1, (1 << 62) | 1]
    df = spark.createDataFrame(list(enumerate(values)), "id int, h long")
    want = sorted((a, b) for a in range(6) for b in range(a + 1, 6) if bin((values[a] ^ values[b]) & (2**64 - 1)).count("1") <= 2)
    assert rows(similarity.hamming_pairs(df, "id", "h", 2).select("a", "b")) == want


def test_components_over_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "u long, v long")
    got = dict(rows(graph.label_components(edges)))
    assert {got[i] for i in range(21)} == {0} and got[101] == 100


def test_reads_push_filters_and_prune_columns(spark):
    from tidepool.plans import catalog

    plan = catalog.QUERIES["launch_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,42)]" in plan
    assert "CartesianProduct" not in plan


def test_parked_tables_go_when_the_driver_ends(tmp_path):
    """A driver of its own leaves nothing in the shared folder."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()
from tidepool.operators.graph import label_components
from tidepool.sources.shared import discard, park
import os
one, two = park(spark.range(5)), park(spark.range(7))
label_components(spark.createDataFrame([(1, 2)], 'u long, v long')).collect()
discard(one)
print('kept', sum('-' in n and n.split('-')[0] in ('tidepool', 'components') for n in os.listdir('{tmp_path}')), two.count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "kept 2 7" in out.stdout and not [p.name for p in tmp_path.iterdir() if p.name.startswith(("tidepool-", "components-"))]
