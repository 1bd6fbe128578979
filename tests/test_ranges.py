"""Order within hot keys: the same answers as plain Python when keys are cut into ranges, and no task that holds a key."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import pit, ranges, sequence


@pytest.fixture(params=[1 << 17, 40], ids=["whole keys", "cut keys"])
def rows_a_task(request, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", request.param)
    return request.param


def table(seed, n=900):
    """(k, t, id, v): one key has two thirds of the rows, values and times tie and may be null."""
    rng = random.Random(seed)
    return [(rng.choice(("a", "a", "a", "a", "b", None)), rng.choice((None, *range(60))) if rng.random() < 0.5 else rng.randrange(400), i, rng.choice((None, 1.5, 2.5)) if rng.random() < 0.3 else rng.random()) for i in range(n)]


KIND = "k string, t long, id long, v double"


def first(t):
    return (t is not None, t or 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_joins(spark, rows_a_task, seed):
    left = [r for r in table(seed) if r[1] is not None]
    right = [r for r in table(seed + 10, 300) if r[1] is not None]
    dl, dr = spark.createDataFrame(left, KIND).select("k", "t", "id"), spark.createDataFrame(right, KIND).select("k", "t", F.col("id").alias("rid"), "v")
    back = {r.id: (r.right_t, r.right_rid) for r in pit.asof_backward(dl, dr, ["k"], "t", ["rid"]).collect()}
    ahead = {r.id: (r.right_t, r.right_rid) for r in pit.asof_forward(dl, dr, ["k"], "t", ["rid"]).collect()}
    near = {r.id: (r.right_t, r.right_rid) for r in pit.asof_nearest(dl, dr, ["k"], "t", ["rid"]).collect()}
    assert len(back) == len(ahead) == len(near) == len(left)
    for k, t, i, _ in left:
        own = sorted((rt, rid) for rk, rt, rid, _ in right if rk == k)
        before, after = [x for x in own if x[0] <= t], [x for x in own if x[0] > t]
        assert back[i] == (before[-1] if before else (None, None))
        assert ahead[i] == (after[0] if after else (None, None))
        pick = after[0] if after and (not before or after[0][0] - t < t - before[-1][0]) else before[-1] if before else (None, None)
        assert near[i] == pick


def test_rows_without_a_time_are_before_nothing(spark, rows_a_task):
    left, right = table(8), table(18, 300)
    dl, dr = spark.createDataFrame(left, KIND).select("k", "t", "id"), spark.createDataFrame(right, KIND).select("k", "t", F.col("id").alias("rid"))
    back = {r.id: (r.right_t, r.right_rid) for r in pit.asof_backward(dl, dr, ["k"], "t", ["rid"]).collect()}
    assert len(back) == len(left) and any(r[1] is None for r in left) and any(r[1] is None for r in right)
    for k, t, i, _ in left:
        assert back[i] == max(((rt, rid) for rk, rt, rid, _ in right if rk == k and None not in (t, rt) and rt <= t), default=(None, None))


def test_rows_without_a_time_are_after_nothing(spark, rows_a_task):
    left, right = table(9), table(19, 300)
    dl, dr = spark.createDataFrame(left, KIND).select("k", "t", "id"), spark.createDataFrame(right, KIND).select("k", "t", F.col("id").alias("rid"))
    ahead = {r.id: (r.right_t, r.right_rid) for r in pit.asof_forward(dl, dr, ["k"], "t", ["rid"]).collect()}
    assert len(ahead) == len(left)
    for k, t, i, _ in left:
        assert ahead[i] == min(((rt, rid) for rk, rt, rid, _ in right if rk == k and None not in (t, rt) and rt > t), default=(None, None))


@pytest.mark.parametrize("seed", [3, 4])
def test_running_sums_and_places(spark, rows_a_task, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: (r.place, r.total) for r in ranges.running(df, ["k"], ["t", "id"], {"place": F.lit(1), "total": F.col("v")}).collect()}
    peers = {r.id: r.c for r in ranges.running(df, ["k"], ["t"], {"c": F.lit(1)}, peers=True).collect()}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (first(r[1]), r[2]))
        total = None
        for n, (_, t, i, v) in enumerate(own, 1):
            total = total if v is None else (total or 0) + v
            assert got[i] == (n, pytest.approx(total) if total is not None else None)
            assert peers[i] == sum(first(x[1]) <= first(t) for x in own)


@pytest.mark.parametrize("seed", [5, 6])
def test_ranks_and_order_statistics(spark, rows_a_task, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, KIND)
    ranked = {r.id: r for r in sequence.average_rank(sequence.cumulative_share(df, ["k"], "v", "share"), ["k"], "v", "rank").collect()}
    picks = {r.k: r for r in sequence.nearest_rank(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    lifts = {r.k: r.lift for r in sequence.top_share_lift(df.filter("v is not null and t is not null"), ["k"], "v", "id", "t").collect()}
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        values = sorted(r[3] for r in own if r[3] is not None)
        for _, _, i, v in own:
            if v is None:
                assert ranked[i].share is None and ranked[i]["rank"] is None
            else:
                low, same = sum(x < v for x in values), values.count(v)
                assert ranked[i].share == pytest.approx((low + same) / len(values)) and ranked[i]["rank"] == low + (same + 1) / 2
        assert [picks[k][p] for p in ("n", "p10", "p50", "p100")] == [len(values), *(values[round(f * (len(values) - 1))] for f in (0.1, 0.5, 1.0))]
        both = sorted((-r[3], r[2], r[1]) for r in own if r[3] is not None and r[1] is not None)
        top = both[: len(both) // 10]
        assert lifts[k] == (pytest.approx(sum(x[2] for x in top) / len(top) / (sum(x[2] for x in both) / len(both))) if len(both) >= 20 else None)


def test_earlier_share_and_numbers(spark, rows_a_task):
    rows = [(k, t or 0, i, v) for k, t, i, v in table(7, 400)]
    df = spark.createDataFrame(rows, KIND).filter("k is not null")
    rows = [r for r in rows if r[0]]
    got = {r.id: (r.earlier, r.lower) for r in sequence.earlier_share(df, ["k"], ["t", "id"], "id", "v").collect()}
    for k, t, i, v in rows:
        before = [r for r in rows if r[0] == k and (r[1], r[2]) < (t, i)]
        assert got[i] == (len(before), 0 if v is None else sum(r[3] is not None and r[3] <= v for r in before))
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    place = {r.id: r.place for r in ranges.numbered(df, order).collect()}
    assert [i for i, _ in sorted(place.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))]
    assert sorted(place.values()) == list(range(1, len(rows) + 1))


def test_a_table_of_one_key_spreads(spark, monkeypatch):
    """All rows of one key: no range holds more than a few shares, and empty tables stay empty."""
    monkeypatch.setattr(ranges, "ROWS", 100)
    df = spark.range(4000).select(F.lit("only").alias("k"), F.expr("id * id").alias("t"), "id")
    cuts = ranges.hot_cuts(df, ["k"], "t")
    sizes = [r["count"] for r in ranges.ranged(df, ["k"], "t", cuts).groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1500 and sum(sizes) == 4000
    empty = df.filter("id < 0")
    assert ranges.placed(empty, ["k"], ["t"]).count() == 0 and ranges.value_at(empty, ["k"], "t", {"p": 0.5}).count() == 0
    assert pit.asof_backward(empty, df, ["k"], "t").count() == 0 and ranges.numbered(empty, [F.col("t")]).count() == 0


def test_cuts_are_found_by_bisection(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.5, 7.0], x) for x in (None, 0.0, 1.0, 2.2, 2.5, 6.9, 7.0, 9.0)] + [(None, 3.0), ([], 3.0)], "c array<double>, x double")
    assert [r.r for r in df.select(ranges.range_of(F.col("x"), F.col("c")).alias("r")).collect()] == [0, 0, 1, 2, 3, 3, 4, 4, 0, 0]


def test_folds_of_clamped_maps(spark, rows_a_task):
    rng = random.Random(11)
    rows = [(rng.choice(("a", "a", "a", "b", None)), i, rng.choice((0.0, 0.5, 0.9, 1.0, 1.5)), rng.uniform(-0.6, 0.6)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, id long, s double, v double")
    got = {r.k: r.folded for r in ranges.folded(df, ["k"], ["id"], F.col("s"), F.col("v"), F.first(F.lit(0.5)), -1.0, 1.0).collect()}
    free = {r.k: r.folded for r in ranges.folded(df, ["k"], ["id"], F.lit(0.7), 0.3 * F.col("v"), F.min_by("v", "id")).collect()}
    for k in ("a", "b", None):
        x, e = 0.5, None
        for r in rows:
            if r[0] == k:
                x = max(-1.0, min(1.0, r[2] * x + r[3]))
                e = r[3] if e is None else 0.3 * r[3] + 0.7 * e
        assert got[k] == pytest.approx(x) and free[k] == pytest.approx(e)


def test_earlier_counts_in_blocks_and_bands(spark):
    """Blocks of a few rows, with keys across blocks, ties of order and value, nulls and NaN: as counted by hand."""
    rng = random.Random(11)
    values = [None, float("nan"), -0.0, 0.0, 1.5, 2.0, 2.5, 3.0, 9.0]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(6), i, rng.choice(values)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    greater = lambda v, w: v == v and (w != w or w > v)  # noqa: E731  NaN is the greatest
    for keys, of in ((["k"], lambda r: r[0]), ([], lambda r: 0)):
        got = {r.id: (r.earlier, r.lower) for r in sequence.earlier_counts(df, keys, ["t", "id"], "v", 17).collect()}
        for r in rows:
            before = [x for x in rows if of(x) == of(r) and x[1:3] < r[1:3]]
            assert got[r[2]] == (len(before), 0 if r[3] is None else sum(x[3] is not None and not greater(r[3], x[3]) for x in before))


def test_earlier_rank_within_one_moment(spark):
    """All rows at one moment: no task holds more than some of them, and each is ranked among those before it."""
    rng = random.Random(3)
    rows = [(5, i, rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, id long, m long")
    got = {r.id: (r.earlier, r.lower) for r in sequence.earlier_rank(df, "at", "id", "m", task=16).collect()}
    assert got == {i: (i, sum(x <= m for _, _, x in rows[:i])) for _, i, m in rows}
