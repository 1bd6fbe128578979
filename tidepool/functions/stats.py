"""Column-level statistics. Null stays null: absence is never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def quotient(a, b) -> Column:
    """a / b in doubles with the results of floating point for a divisor of zero: an infinity, or NaN for 0 / 0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def ln(x) -> Column:
    """Natural logarithm, minus infinity at 0 and NaN below it (null only for null)."""
    x = _col(x).cast("double")
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def rounded(x, digits: int) -> Column:
    """Rounds the number itself, half away from zero; Spark's own ``round`` rounds its shortest decimal form, which may lie above it.

    A number too large to be scaled stays as it is.
    """
    x = _col(x).cast("double")
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(F.round(scaled, 0) / 10.0**digits)


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    x = _col(x).cast("double")
    return F.when(x.isNull(), None).when(F.isnan(x), F.lit(lo)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def logistic(x, mid, k) -> Column:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), _col(k) * (_col(x) - _col(mid))))
    return F.when(_col(x).isNotNull(), 1 / (1 + F.exp(-z)))


def saturating(x, scale) -> Column:
    x = _col(x)
    return F.when(x <= 0, 0.0).otherwise(x / (x + _col(scale)))


def wilson(hits, n, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; no trials give 0."""
    hits, n = _col(hits).cast("double"), _col(n).cast("double")
    p = F.try_divide(hits, n)
    top = p + z * z / 2 / n - z * F.sqrt((p * (1 - p) + z * z / 4 / n) / n)
    return F.when(n.isNull(), None).when(n <= 0, 0.0).otherwise(clamp(top / (1 + z * z / n)))


def gini_from(sum_ix, total, n) -> Column:
    """Gini from the sum of rank * value over ascending values."""
    return F.when(_col(total) < 1e-12, 0.0).otherwise(2 * _col(sum_ix) / (_col(n) * _col(total)) - (_col(n) + 1) / _col(n))


def herfindahl(sum_sq, total) -> Column:
    return F.coalesce(F.when(F.abs(_col(total)) < 1e-12, 1.0).otherwise(_col(sum_sq) / (_col(total) * _col(total))), F.lit(1.0))


def entropy_from(sum_p_ln_p, n, normalized: bool = True) -> Column:
    h = -_col(sum_p_ln_p)
    return F.when(_col(n) <= 1, 0.0).otherwise(clamp(h / F.ln(_col(n).cast("double"))) if normalized else h)


def burstiness(mean, deviation) -> Column:
    return F.try_divide(_col(deviation) - _col(mean), _col(deviation) + _col(mean))


def kelly(p, odds, fraction: float = 0.25, cap: float = 0.05) -> Column:
    edge = _col(p) - F.try_divide(1 - _col(p), _col(odds))
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), edge * fraction))


def tokens_out(sol_reserve, token_reserve, sol_in) -> Column:
    """Constant-product curve: tokens for a payment."""
    x, y, d = _col(sol_reserve), _col(token_reserve), _col(sol_in)
    return y - x * y / (x + d)


def sol_out(sol_reserve, token_reserve, tokens_in) -> Column:
    x, y, d = _col(sol_reserve), _col(token_reserve), _col(tokens_in)
    return x - x * y / (y + d)


def impact_bps(sol_reserve, token_reserve, sol_in) -> Column:
    spot = _col(sol_reserve) / _col(token_reserve)
    paid = _col(sol_in) / tokens_out(sol_reserve, token_reserve, sol_in)
    return (paid / spot - 1) * 10_000


def leading_digit(x) -> Column:
    """First non-zero digit as the number is written; zero has none."""
    return F.nullif(F.regexp_extract(_col(x).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def decay(value, age_hours, half_life: float = 72.0) -> Column:
    return _col(value) * F.pow(F.lit(0.5), _col(age_hours) / half_life)


def is_round(x, bases: tuple[float, ...] = (0.1, 0.5, 1.0)) -> Column:
    hit = F.lit(False)
    for b in bases:
        hit = hit | (F.abs(_col(x) / b - F.rint(_col(x) / b)) < 1e-6)
    return hit


LN_3 = math.log(3)
