"""Numeric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_DECIMALS = 9

# Coefficients of the published rational approximation of the inverse normal
# distribution function by P. J. Acklam (relative error below 1.2e-9).
INVERSE_NORMAL_CENTRE = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
INVERSE_NORMAL_CENTRE_DIVISOR = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
)
INVERSE_NORMAL_TAIL = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
INVERSE_NORMAL_TAIL_DIVISOR = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
)
INVERSE_NORMAL_LOW = 0.02425

# Abramowitz and Stegun formula 7.1.26 for the error function
# (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def metric(value: Column, decimals: int = METRIC_DECIMALS) -> Column:
    """Rounded metric; adding zero turns ``-0.0`` into ``0.0``."""
    return F.round(value, decimals) + F.lit(0.0)


def try_double(c: Column | str) -> Column:
    """Numeric coercion: a value that does not parse, and NaN, becomes null."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(number), number)


def xlog2(n: Column) -> Column:
    """``n * log2(n)`` with ``0 log 0 = 0``."""
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def inverse_normal_cdf(p: Column) -> Column:
    """Quantile of the standard normal distribution, as one JVM-side expression."""
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    lower_tail = _polynomial(low, INVERSE_NORMAL_TAIL) / _polynomial(low, INVERSE_NORMAL_TAIL_DIVISOR + (1.0,))
    upper_tail = -_polynomial(high, INVERSE_NORMAL_TAIL) / _polynomial(high, INVERSE_NORMAL_TAIL_DIVISOR + (1.0,))
    centre = _polynomial(r, INVERSE_NORMAL_CENTRE) * q / _polynomial(r, INVERSE_NORMAL_CENTRE_DIVISOR + (1.0,))
    return (
        F.when(p < INVERSE_NORMAL_LOW, lower_tail)
        .when(p > 1.0 - INVERSE_NORMAL_LOW, upper_tail)
        .otherwise(centre)
    )


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal distribution."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + F.lit(a)) * t
    erf = F.lit(1.0) - series * F.exp(-x * x)
    return F.when(z >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))
