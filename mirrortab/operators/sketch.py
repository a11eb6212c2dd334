"""Column profiles that merge: a new partition is read alone and added to the stored profile.

A column keeps its counts, range and sum, a sketch of its distinct values and, if numeric, one of its
quantiles.  The exact profile expands each row once per column to count distinct values; this one is a
single map-side-combined aggregate of a few kilobytes a column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType

from mirrortab.operators.core import checkpointed

LG_REGISTERS = 12
#: Relative standard error of the distinct sketch, and how many of them count as "near".
DISTINCT_ERROR = 1.04 / 2 ** (LG_REGISTERS / 2)
NEAR = 6.0


def _text(df: DataFrame, c: str) -> Column:
    """A value as the text that stands for it; both zeros are one value."""
    value = F.col(f"`{c}`")
    return (value + F.lit(0.0) if isinstance(df.schema[c].dataType, FractionalType) else value).cast("string")


def fit_sketches(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_rows, n_values, lo, hi, total, distinct, quantiles)`` of one part, in one pass.

    Nulls are only in ``n_rows``; NaN is a distinct value but not a number of the range, the sum or the
    quantiles.  The four last are null for text, and for columns without a number.
    """
    cols = list(cols or df.columns)
    cells = []
    for c in cols:
        numeric = isinstance(df.schema[c].dataType, NumericType)
        x = F.col(f"`{c}`").cast("double") if numeric else F.lit(None).cast("double")
        x = F.when(~F.isnan(x), x)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(F.col(f"`{c}`")).alias("n_values"),
            F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("total"),
            F.hll_sketch_agg(_text(df, c), F.lit(LG_REGISTERS)).alias("distinct"),
            F.when(F.count(x) > 0, F.kll_sketch_agg_double(x)).alias("quantiles"),
        ))
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def merge_sketches(parts: DataFrame) -> DataFrame:
    """One row a column from the rows of several parts, in the same form."""
    return parts.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
    )


def estimates(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, n_rows, n_values, n_unique, lo, hi, total, quantiles)``: estimated distinct count and quantiles."""
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", at))
    return sketches.select(
        "column", "n_rows", "n_values", F.hll_sketch_estimate("distinct").alias("n_unique"), "lo", "hi", "total",
        values.alias("quantiles"),
    )


def distinct_at_most(df: DataFrame, sketches: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """``(column, at_most, counted)``: whether a column of ``df`` has no more distinct values than its limit.

    The sketch decides where its estimate is more than six standard errors from the limit; the other
    columns, and only they, are ``counted`` exactly.
    """
    found = estimates(sketches.where(F.col("column").isin(list(limits)))).select("column", "n_unique").collect()  # a row a column
    estimate = {r["column"]: r["n_unique"] for r in found}
    missing = set(limits) - set(estimate)
    if missing:
        raise ValueError(f"no sketch of {sorted(missing)}")
    near = [c for c, limit in limits.items() if abs(estimate[c] - limit) <= 1 + NEAR * DISTINCT_ERROR * max(estimate[c], limit)]
    cell = lambda c, at_most, counted: F.struct(F.lit(c).alias("column"), at_most.alias("at_most"), F.lit(counted).alias("counted"))
    settled = [cell(c, F.lit(estimate[c] <= limit), False) for c, limit in limits.items() if c not in near]
    if near:
        exact = [cell(c, F.count_distinct(F.col(f"`{c}`")) <= limits[c], True) for c in near]
        return checkpointed(df.agg(F.array(*exact, *settled).alias("_c"))).select(F.explode("_c").alias("_c")).select("_c.*")
    return df.sparkSession.range(1).select(F.explode(F.array(*settled)).alias("_c")).select("_c.*")
