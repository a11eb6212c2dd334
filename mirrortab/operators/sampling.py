"""Draws with replacement: weighted values, resampled numbers, start columns, conditions.

A draw is a uniform number looked up in cumulative intervals.  The lookup is an equi-join on
the group and on the interval bucket the number falls in, so it never compares a draw with
all values, and when the table is too large to broadcast a group that holds most draws is
spread over its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from mirrortab.functions import uniform01
from mirrortab.functions.random import digits_from
from mirrortab.operators.core import (
    BROADCAST_BYTES, BROADCAST_ROWS, FitTable, fit_table, running_total, value_counts,
)

INTERVALS_PER_BUCKET = 16
#: Copies of one candidate that a task lays out at a time.
COPY_BLOCK = 100_000
MIN_SPREAD = 256


def intervals(table: FitTable | DataFrame, group: Sequence[str], order: Sequence[str | Column], weight: str) -> DataFrame:
    """Add ``lo`` and ``hi``: each row's half-open share of its group's [0, 1)."""
    run = running_total(table, group, order, weight).where(F.col(weight) > 0)
    last = F.col("cum") == F.col("total")
    if isinstance(run.schema[weight].dataType, FractionalType):
        last = F.col("cum") >= F.col("total") * (1 - 1e-12)  # sums may differ in the last bits
    return (
        run.withColumn("lo", (F.col("cum") - F.col(weight)) / F.col("total"))
        .withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("cum") / F.col("total")))
        .drop("cum", "total")
    )


def interval_lookup(
    draws: DataFrame, table: FitTable, group: Sequence[str], u: str, groups: int = 1
) -> DataFrame:
    """Left join each draw to the interval of its group that contains ``u``.

    ``table`` holds the group columns, ``lo``, ``hi`` and the payload; ``groups`` is its
    number of groups.  The number of buckets is a power of two, so that the bucket of ``u``
    and of the interval ends are exact and consistent.
    """
    group = list(group)
    per_group = max(table.rows / max(groups, 1), 1.0)
    buckets = 2 ** max(0, math.ceil(math.log2(per_group / INTERVALS_PER_BUCKET)))
    expanded = table.rows + buckets * groups
    small = expanded <= BROADCAST_ROWS and table.bytes * (expanded / max(table.rows, 1)) <= BROADCAST_BYTES
    if not small:
        buckets = max(buckets, MIN_SPREAD)
    bucket = lambda x: F.floor(x * F.lit(float(buckets)))
    first, last = bucket(F.col("lo")), F.least(bucket(F.col("hi")), F.lit(buckets - 1))
    dim = table.df.withColumn("_bucket", F.explode(F.sequence(first, last)))
    dim = dim.withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi")
    for g in group:
        dim = dim.withColumnRenamed(g, f"_g_{g}")
    keyed = draws.withColumn("_ub", bucket(F.col(u)))
    on = (F.col("_ub") == F.col("_bucket")) & (F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi"))
    for g in group:
        on &= F.col(g) == F.col(f"_g_{g}")
    joined = keyed.join(F.broadcast(dim) if small else dim, on, "left")
    return joined.drop("_ub", "_bucket", "_lo", "_hi", *[f"_g_{g}" for g in group])


def digits_depth(table: FitTable, groups: int) -> int | None:
    """Leading hex digits that tell the bucket in :func:`digits_lookup`, or None for a table too large to broadcast."""
    per_group = max(table.rows / max(groups, 1), 1.0)
    depth = max(0, math.ceil(math.log(per_group / INTERVALS_PER_BUCKET, 16)))
    expanded = table.rows + 16**depth * groups
    small = expanded <= BROADCAST_ROWS and table.bytes * (expanded / max(table.rows, 1)) <= BROADCAST_BYTES
    return depth if small else None


def digits_lookup(draws: DataFrame, table: FitTable, group: str, digits: str, depth: int) -> DataFrame:
    """:func:`interval_lookup` for a table that is broadcast and one whole number as group.

    The draw stays the hex digits of its hash, and the interval ends become such digits, so that a draw is
    compared as text and never turned into a number.
    """
    dim = table.df.withColumnsRenamed({group: "_group"})
    on = F.col(group) == F.col("_group")
    if depth:
        buckets = 16**depth
        first, last = F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1))
        dim = dim.withColumn("_bucket", F.explode(F.sequence(first, last)))
        dim = dim.withColumn("_bucket", F.lpad(F.lower(F.hex("_bucket")), depth, "0"))
        draws = draws.withColumn("_ub", F.substring(digits, 1, depth))
        on &= F.col("_ub") == F.col("_bucket")
    dim = dim.withColumns({"_lo": digits_from(F.col("lo")), "_hi": digits_from(F.col("hi"))}).drop("lo", "hi")
    on &= (F.col(digits) >= F.col("_lo")) & (F.col(digits) < F.col("_hi"))
    return draws.join(F.broadcast(dim), on, "left").drop("_ub", "_bucket", "_lo", "_hi", "_group")


def ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def sample_categorical(
    draws: DataFrame, weights: DataFrame, seed: int = 42, stream: str = "", key: str = "id", out: str = "value"
) -> DataFrame:
    """Draw a value for every key by weight; ``weights`` is ``(value, weight)``.

    Values are laid out in sorted order.  The same draw gives label-conditioned generation
    its labels (weights = class counts) and prompts their first value.
    """
    shares = fit_table(intervals(weights.withColumn("_all", F.lit(0)), ["_all"], ["value"], "weight"))
    dim = FitTable(shares.df.select(F.col("value").alias(out), "lo", "hi"), shares.rows, shares.bytes)
    u = draws.withColumn("_u", uniform01(seed, key, stream))
    return interval_lookup(u, dim, [], "_u").drop("_u")


def sample_continuous(
    draws: DataFrame, df: DataFrame, column: str, seed: int = 42, key: str = "id",
    decimals: int = 5, out: str = "value",
) -> DataFrame:
    """Resample a numeric column, formatted to fixed decimals.

    Drawing a row is drawing a distinct value by its count, so repeated values are combined
    before anything is sorted.
    """
    counts = value_counts(df, [column], as_type="double")
    shares = fit_table(intervals(counts, ["column"], ["value"], "n"))
    dim = FitTable(shares.df.select(F.col("value").alias("_value"), "lo", "hi"), shares.rows, shares.bytes)
    u = draws.withColumn("_u", uniform01(seed, key, column))
    return interval_lookup(u, dim, [], "_u").withColumn(
        out, F.format_string(f"%.{decimals}f", F.col("_value"))
    ).drop("_u", "_value")


def sample_start_column(draws: DataFrame, columns: Sequence[str], seed: int = 42, key: str = "id", out: str = "column") -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    at = F.floor(uniform01(seed, key, "start") * len(columns)).cast("int") + 1
    return draws.withColumn(out, F.element_at(names, at))


def sample_conditions(draws: DataFrame, probabilities: DataFrame, columns: Sequence[str], seed: int = 42, key: str = "id") -> DataFrame:
    """Pick a categorical column uniformly, then one of its values by frequency.

    ``probabilities`` is ``(column, value, p)``.
    """
    shares = fit_table(intervals(probabilities.select("column", "value", "p"), ["column"], ["value"], "p"))
    dim = FitTable(shares.df.select("column", "value", "lo", "hi"), shares.rows, shares.bytes)
    picked = sample_start_column(draws, columns, seed, key).withColumn("_u", uniform01(seed, key, "value"))
    return interval_lookup(picked, dim, ["column"], "_u", groups=len(columns)).drop("_u")


def start_prompts(
    draws: DataFrame, column: str | None, distribution: Mapping[str, float] | DataFrame | None,
    columns: Sequence[str], seed: int = 42, key: str = "id",
) -> DataFrame:
    """First words of generated rows, by the kind of the given distribution.

    A mapping of value to weight gives ``column is value,``; a table with that numeric
    column gives resampled numbers; nothing gives a random column name.
    """
    if column and distribution is None:
        raise ValueError(f"start column {column} was given without a distribution")
    if distribution is not None and not column:
        raise ValueError("a start distribution was given without its column")
    if isinstance(distribution, Mapping):
        weights = draws.sparkSession.createDataFrame(
            [(str(v), float(w)) for v, w in distribution.items()], "value string, weight double"
        )
        drawn = sample_categorical(draws, weights, seed, column, key, "_start")
    elif isinstance(distribution, DataFrame):
        drawn = sample_continuous(draws, distribution, column, seed, key, out="_start")
    elif distribution is None:
        named = sample_start_column(draws, columns, seed, key, "_start")
        return named.withColumn("prompt", F.concat("_start", F.lit(" is "))).drop("_start")
    else:
        raise TypeError("distribution must be a mapping, a table or None")
    return drawn.withColumn("prompt", F.concat(F.lit(f"{column} is "), "_start", F.lit(","))).drop("_start")


def resample_by_weight(candidates: FitTable, n: int, weight: str, order: Sequence[str]) -> DataFrame:
    """Systematic resampling: ``n`` rows in proportion to weight.

    Row ``i`` takes the points ``j + 1/2`` (in units of total/n) inside its share of the
    cumulative weight: a projection after one running total, with no draw-to-row join.
    """
    run = running_total(candidates.df.withColumn("_all", F.lit(0)), ["_all"], order, weight)
    scale = F.lit(float(n)) / F.col("total")
    upto = F.floor(F.col("cum") * scale + 0.5)
    before = F.floor((F.col("cum") - F.col(weight)) * scale + 0.5)
    # a heavy candidate's copies are laid out in blocks, so that they are not one task's work
    start = F.sequence(F.lit(1).cast("bigint"), F.col("_copies"), F.lit(COPY_BLOCK).cast("bigint"))
    blocks = run.withColumn("_copies", (upto - before).cast("bigint")).where(F.col("_copies") > 0).withColumn(
        "_first", F.explode(start)
    ).repartition(*order, "_first")
    last = F.least(F.col("_first") + COPY_BLOCK - 1, F.col("_copies"))
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("_first"), last))).drop(
        "_all", "cum", "total", "_copies", "_first"
    )
