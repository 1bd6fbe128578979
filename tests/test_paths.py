"""Each rule of paths and labels, toggled by a row."""

import pytest

from tidepool.operators import paths

POINT = "token_key long, as_of long, id long, price double, high double, liquidity double, market_cap double, stage int, progress double, source string, candle boolean"


def point(at, price, id=1, token=1, high=None, liquidity=None, cap=None, stage=1, progress=None, source="s", candle=False):
    return (token, at, id, float(price), float(high or price), liquidity, cap, stage, progress, source, candle)


def path(spark, points, created=0):
    made = spark.createDataFrame([(1, created)], "token_key long, created_at long")
    return paths.price_path(spark.createDataFrame(points, POINT), made)


def label(spark, points, created=0, **policy):
    return paths.outcomes(path(spark, points, created), paths.Policy(**policy)).first()


def rows(df):
    return [(r.as_of, r.price, r.high, r.liquidity, r.stage, r.source) for r in df.orderBy("as_of").collect()]


def test_moments_take_medians_and_the_nearest_point(spark):
    points = [point(100, 1, source="a", liquidity=10.0), point(110, 900, source="b", stage=3), point(130, 3, source="c", liquidity=30.0), point(161, 5, source="d")]
    assert rows(path(spark, points)) == [(130, 3.0, 3.0, 20.0, 3, "c"), (161, 5.0, 5.0, None, 1, "d")]


def test_observations_come_before_candles_at_an_instant(spark):
    points = [point(100, 2, id=1, source="candles", candle=True, high=9), point(100, 1, id=5), point(100, 7, id=6), point(200, 4, source="candles", candle=True, high=6)]
    assert rows(path(spark, points)) == [(100, 1.0, 1.0, None, 1, "s"), (200, 4.0, 6.0, None, 1, "candles")]


def test_points_before_creation_are_anothers(spark):
    assert rows(path(spark, [point(60, 8), point(70, 1), point(300, 0), point(400, 2)], created=100)) == [(70, 1.0, 1.0, None, 1, "s"), (400, 2.0, 2.0, None, 1, "s")]


def test_candles_of_one_timestamp(spark):
    payloads = spark.createDataFrame([(1, 1, [(60, 1.0, 2.0), (0, 5.0, None), (120, 0.0, 9.0)]), (1, 2, [(60, 1.5, 3.0), (60, 1.7, 3.0), (0, 4.0, 3.0)])], "token_key long, id long, candles array<struct<timestamp: long, close: double, high: double>>")
    got = sorted((r.as_of, r.price, r.high) for r in paths.candle_points(payloads).collect())
    assert got == [(0, 4.0, 4.0), (60, 1.5, 3.0)]


def test_a_late_first_price_is_no_t0(spark):
    late, intime = (label(spark, [point(at, 1), point(at + 4000, 3)]) for at in (901, 900))
    assert (late.multiple, late.realizable, late.to_peak, late.survived_1h) == (None, None, None, False)
    assert intime.multiple == 3.0 and intime.to_peak == 4900 and intime.survived_1h


def test_the_best_sale_weighs_depth(spark):
    """A high price in a thin pool sells for less than a lower one on the curve."""
    got = label(spark, [point(0, 1, progress=0.0), point(100, 4, progress=0.5), point(200, 8, stage=3, liquidity=3.0)])
    x, q = 30 + 42.5, 0.25
    assert got.multiple == 8.0 and got.realizable == pytest.approx(max(x * q / (x / 4 + q), 0.01 * q / (0.01 / 8 + q)) / 0.25)
    shallow = label(spark, [point(0, 1, liquidity=None), point(100, 2, liquidity=None)])
    assert shallow.realizable == pytest.approx(31 * q / (31 / 2 + q) / 0.25)


def test_survival_needs_the_horizon_and_looks_both_ways(spark):
    got = label(spark, [point(0, 1), point(3000, 1), point(3700, 0.2), point(80_000, 0.6)])
    assert (got.survived_1h, got.survived_24h) == (False, False)
    assert label(spark, [point(0, 1), point(3400, 0.5), point(3900, 0.1)]).survived_1h


@pytest.mark.parametrize(
    ("points", "want"),
    [
        ([point(0, 1, liquidity=4000.0), point(100, 1, liquidity=400.0)], True),
        ([point(0, 1, liquidity=4000.0), point(100, 1, liquidity=600.0)], False),
        ([point(0, 1, liquidity=400.0), point(100, 1, liquidity=1.0)], False),
        ([point(0, 1, liquidity=1500.0), point(100, 1, liquidity=450.0)], False),
        ([point(0, 1, liquidity=4000.0), point(100, 1, liquidity=400.0), point(200, 1)], True),
        ([point(0, 1), point(100, 1, stage=4)], True),
        ([point(0, 1, liquidity=4000.0)], False),
    ],
)
def test_a_withdrawal_is_no_fade(spark, points, want):
    assert label(spark, points).rugged is want


def test_graduation_by_stage_or_progress(spark):
    assert label(spark, [point(0, 1), point(100, 1, progress=0.999), point(200, 1, stage=3)]).graduated_at == 100
    assert label(spark, [point(0, 1, stage=2, progress=0.998)]).graduated is False


def test_an_empty_path(spark):
    assert paths.outcomes(path(spark, [])).count() == 0
