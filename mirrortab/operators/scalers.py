"""Scalers with inverses.  Fitting is one aggregate; four numbers per column are kept."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import inverse_normal_cdf, normal_cdf, try_double
from mirrortab.operators.core import exact_quantiles

RANGE_EPSILON = 1e-8  # fixed value: added to the range by the padded min-max scaler
MAX_QUANTILES = 1000
MIN_QUANTILES = 10
TAIL = 1e-7  # fixed value: probabilities are kept this far from 0 and 1


@dataclass(frozen=True)
class Moments:
    lo: float
    hi: float
    mean: float
    std: float  # population


def fit_moments(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> dict[str, Moments]:
    if weight is not None:
        return _weighted_moments(df, cols, weight)
    row = df.agg(
        *[
            F.struct(
                F.min(x).alias("lo"), F.max(x).alias("hi"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            ).alias(c)
            for c in cols
            for x in [try_double(f"`{c}`")]
        ]
    ).first()
    return {c: Moments(row[c]["lo"], row[c]["hi"], row[c]["mean"], row[c]["std"]) for c in cols}


def _weighted_moments(df: DataFrame, cols: Sequence[str], weight: str) -> dict[str, Moments]:
    """Moments of counted rows: squares are taken from the mean, in a second pass."""
    n, numbers = F.col(f"`{weight}`"), {c: try_double(f"`{c}`") for c in cols}
    total = lambda x: F.sum(F.when(x.isNotNull(), n))
    row = df.agg(*[
        F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.try_divide(F.sum(x * n), total(x)).alias("mean")).alias(c)
        for c, x in numbers.items()
    ]).first()
    known = [c for c in cols if row[c]["mean"] is not None]
    spread = df.agg(*[
        F.sqrt(F.sum((numbers[c] - F.lit(row[c]["mean"])) ** 2 * n) / total(numbers[c])).alias(c) for c in known
    ]).first() if known else {}
    moments = {}
    for c in cols:
        lo, hi, mean = row[c]
        # one value only: no spread, whatever the mean was rounded to
        std = 0.0 if c in known and lo == hi and math.isfinite(lo) else spread[c] if c in known else None
        moments[c] = Moments(lo, hi, mean, std)
    return moments


def minmax_padded(x: Column, m: Moments) -> Column:
    return (x - F.lit(m.lo)) / F.lit(m.hi - m.lo + RANGE_EPSILON)


def minmax_padded_inverse(x: Column, m: Moments) -> Column:
    return x * F.lit(m.hi - m.lo + RANGE_EPSILON) + F.lit(m.lo)


def minmax(x: Column, m: Moments) -> Column:
    return (x - F.lit(m.lo)) / F.lit((m.hi - m.lo) or 1.0)


def minmax_inverse(x: Column, m: Moments) -> Column:
    return x * F.lit((m.hi - m.lo) or 1.0) + F.lit(m.lo)


def minmax_symmetric(x: Column, m: Moments) -> Column:
    if m.hi > m.lo:
        return F.lit(2.0) * (x - F.lit(m.lo)) / F.lit(m.hi - m.lo) - F.lit(1.0)
    return x * 0.0


def minmax_symmetric_inverse(x: Column, m: Moments) -> Column:
    if m.hi > m.lo:
        return (x + F.lit(1.0)) * F.lit(m.hi - m.lo) / F.lit(2.0) + F.lit(m.lo)
    return x * 0.0 + F.lit(m.lo)


def standardize(x: Column, m: Moments) -> Column:
    return (x - F.lit(m.mean)) / F.lit(m.std or 1.0)


def standardize_inverse(x: Column, m: Moments) -> Column:
    return x * F.lit(m.std or 1.0) + F.lit(m.mean)


@dataclass(frozen=True)
class QuantileGrid:
    """Quantiles of a column at evenly spaced probabilities (at most MAX_QUANTILES)."""

    values: tuple[float, ...]


def fit_quantile_grids(df: DataFrame, cols: Sequence[str]) -> dict[str, QuantileGrid]:
    n = min(MAX_QUANTILES, max(df.count(), MIN_QUANTILES))
    grid = [i / (n - 1) for i in range(n)]
    found: dict[str, list[float]] = {c: [] for c in cols}
    for r in exact_quantiles(df, cols, grid).orderBy("column", "i").collect():
        found[r["column"]].append(r["value"])
    return {c: QuantileGrid(tuple(v)) for c, v in found.items()}


def _with(x: Column, result) -> Column:
    """``result`` of a value that is computed once, however often the result names it."""
    return F.get(F.transform(F.array(x), result), 0)


def _literal(grid: QuantileGrid) -> Column:
    """The grid as one constant array (text of a double reads back as the same double)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in grid.values)), ",").cast("array<double>")


def _passed(x: Column, values: Column, n: int, reached) -> Column:
    """How many of the ``n`` ascending values are ``reached`` by ``x``: a binary search of fixed steps."""
    steps = [2**i for i in reversed(range(n.bit_length()))]

    def advance(at: Column, step: Column) -> Column:
        further = at + step
        inside = F.get(values, F.least(further, F.lit(n)) - 1)
        return F.when((further <= n) & reached(inside, x), further).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def to_uniform(x: Column, grid: QuantileGrid) -> Column:
    """Position of the value in the grid, in [0, 1]; null and NaN stay without one.

    A value between two grid points is interpolated; one that fills several gets their middle.
    """
    n, values = len(grid.values), _literal(grid)

    def place(v: Column) -> Column:
        below = _passed(v, values, n, lambda q, y: q < y)
        upto = _passed(v, values, n, lambda q, y: q <= y)
        return _with(F.struct(v.alias("v"), below.alias("below"), upto.alias("upto")), between)

    def between(hit: Column) -> Column:
        v, below, upto = hit["v"], hit["below"], hit["upto"]
        left = F.get(values, below - 1)
        share = (v - left) / (F.get(values, F.least(below, F.lit(n - 1))) - left)
        return (
            F.when(v <= grid.values[0], 0.0)
            .when(v >= grid.values[-1], 1.0)
            .when(upto > below, (below + upto - 1) / F.lit(2.0 * (n - 1)))
            .otherwise((below - 1 + share) / F.lit(float(n - 1)))
        )

    return _with(x.cast("double"), lambda v: F.when(v.isNotNull() & ~F.isnan(v), place(v)))


def from_uniform(u: Column, grid: QuantileGrid) -> Column:
    """Value at a position of the grid; positions outside [0, 1] take the ends, null and NaN give null."""
    n, values = len(grid.values), _literal(grid)

    def at(p: Column) -> Column:
        left = F.least(F.floor(p), F.lit(n - 2)).cast("int")
        low, high = F.get(values, left), F.get(values, left + 1)
        return low + (p - left) * (high - low)

    scaled = lambda p: F.greatest(F.lit(0.0), F.least(p, F.lit(1.0))) * F.lit(float(n - 1))
    return _with(u.cast("double"), lambda p: F.when(p.isNotNull() & ~F.isnan(p), _with(scaled(p), at)))


def to_normal(x: Column, grid: QuantileGrid) -> Column:
    inner = lambda u: F.greatest(F.lit(TAIL), F.least(u, F.lit(1.0 - TAIL)))
    # greatest and least skip nulls, hence the condition
    return _with(to_uniform(x, grid), lambda u: F.when(u.isNotNull(), _with(inner(u), inverse_normal_cdf)))


def from_normal(z: Column, grid: QuantileGrid) -> Column:
    return from_uniform(_with(z, normal_cdf), grid)
