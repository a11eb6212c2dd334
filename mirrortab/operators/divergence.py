"""Label distributions, marginal divergences and their report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric, try_double
from mirrortab.operators.clean import is_numeric, missing_text
from mirrortab.operators.core import unpivot, with_scalars

PROBABILITY_FLOOR = 1e-12  # fixed value, added to every probability before the logarithm
MIN_BINS = 3


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, p)``."""
    counts = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(counts, total).select("label", "n", (F.col("n") / F.col("_total")).alias("p"))


def empirical_probabilities(df: DataFrame, cols: Sequence[str], smoothing: float = 1e-8) -> DataFrame:
    """``(column, value, n, p)`` with a constant added to every count before normalising."""
    counts = (
        unpivot(df, cols).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(
        (F.sum("n") + F.count(F.lit(1)) * F.lit(smoothing)).alias("_total")
    )
    return counts.join(F.broadcast(totals), "column").select(  # one row per column
        "column", "value", "n", ((F.col("n") + F.lit(smoothing)) / F.col("_total")).alias("p")
    )


def sides(first: DataFrame, second: DataFrame, cols: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Both tables' columns under each other with a ``side`` flag."""
    pick = lambda df, name: df.select(F.lit(name).alias("side"), *[F.col(f"`{c}`") for c in cols])
    return pick(first, names[0]).unionByName(pick(second, names[1]))


def label_tv_distance(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Total variation between the label distributions: one row ``tv``."""
    both = sides(train, test, [label], ("train", "test")).where(F.col(f"`{label}`").isNotNull())
    counts = both.groupBy(F.col(f"`{label}`").alias("label")).agg(
        F.sum(F.when(F.col("side") == "train", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == "test", 1).otherwise(0)).alias("b"),
    )
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gaps = with_scalars(counts, totals).select(
        F.abs(F.try_divide("a", "na") - F.try_divide("b", "nb")).alias("gap")
    )
    return gaps.agg(metric(F.sum("gap") / 2).alias("tv"))


def _small_cardinality_bound(n: int, registers: int = 512) -> float:
    """Largest estimate the distinct sketch can give for ``n`` distinct values.

    Each distinct value fills at most one register, so linear counting cannot exceed this;
    a larger estimate proves that there are more than ``n`` distinct values.
    """
    return registers * math.log(registers / (registers - n)) + 1.0


def shared_edges(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], n_bins: int = 10
) -> dict[str, list[float]]:
    """Equal-width histogram edges over both tables; columns without a value are left out.

    The bin count is ``min(n_bins, max(3, distinct values))``.  Only whether there are at
    least ``n_bins`` distinct values matters, so a sketch settles the wide columns and the
    exact distinct count runs on the few narrow ones: no column's values are shuffled whole.
    """
    cols = list(cols)
    if not cols:
        return {}
    both = sides(real, synth, cols, ("real", "synth")).select(*[try_double(f"`{c}`").alias(c) for c in cols])
    ranges = both.agg(
        *[
            F.struct(
                F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi"),
                F.approx_count_distinct(f"`{c}`").alias("about"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    limit = _small_cardinality_bound(n_bins)
    narrow = [c for c in cols if ranges[c]["about"] <= limit]
    exact = both.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in narrow]).first() if narrow else None
    edges: dict[str, list[float]] = {}
    for c in cols:
        lo, hi = ranges[c]["lo"], ranges[c]["hi"]
        if lo is None:
            continue
        bins = min(n_bins, max(MIN_BINS, exact[c])) if c in narrow else n_bins
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        step = (hi - lo) / bins
        edges[c] = [i * step + lo for i in range(bins)] + [hi]
    return edges


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Bin index: the number of inner edges at or below the value.

    A sum of comparisons stays inside generated code; only long edge lists use an array.
    """
    inner = [F.lit(float(e)) for e in edges[1:-1]]
    if len(inner) > 64:
        return F.size(F.filter(F.array(*inner), lambda e: e <= c))
    total = F.lit(0)
    for e in inner:
        total = total + (c >= e).cast("int")
    return total


def histogram_shared(real: DataFrame, synth: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """``(column, bin, real_n, synth_n)`` for the occupied bins."""
    edges = shared_edges(real, synth, cols, n_bins)
    cells = _cells(real, synth, edges, [])
    return cells.groupBy("column", F.col("value").cast("int").alias("bin")).agg(*_side_counts())


def _side_counts(weight: str | None = None) -> list[Column]:
    rows = F.lit(1) if weight is None else F.col(f"`{weight}`")
    return [
        F.sum(F.when(F.col("side") == s, rows).otherwise(0)).alias(f"{s}_n") for s in ("real", "synth")
    ]


def _cells(
    real: DataFrame, synth: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(side, column, value)`` and the weight: bins of numeric columns, text of categorical ones."""
    cols = list(edges) + [c for c in categorical if c not in edges]
    weights = [weight] if weight else []
    both = sides(real, synth, [*cols, *weights], ("real", "synth"))
    picked = [
        F.when(try_double(f"`{c}`").isNotNull(), bin_of(try_double(f"`{c}`"), e).cast("string")).alias(c)
        for c, e in edges.items()
    ] + [missing_text(F.col(f"`{c}`")).alias(c) for c in categorical]
    keep = ["side", *weights]
    return unpivot(both.select(*keep, *picked), cols, keep).where(F.col("value").isNotNull())


def divergence_by_column(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    n_bins: int = 10,
    weight: str | None = None,
) -> DataFrame:
    """``(column, jsd, kld_sym)`` for every column in one pass over both tables.

    Unpivot, one combined count per ``(column, value)``, one sum per column.  Bins empty on
    both sides add nothing to the sums, so they only enter the normaliser.  A column
    without values on one side gets 0.  ``weight`` names a column of both tables that says how often a row stands.
    """
    edges = shared_edges(real, synth, numeric, n_bins)
    counts = _cells(real, synth, edges, categorical, weight).groupBy("column", "value").agg(*_side_counts(weight))
    totals = counts.groupBy("column").agg(
        F.sum("real_n").alias("_nr"), F.sum("synth_n").alias("_ns"), F.count(F.lit(1)).alias("_cats")
    )
    width = F.col("_cats")
    for c, e in edges.items():
        width = F.when(F.col("column") == c, F.lit(len(e) - 1)).otherwise(width)
    eps = F.lit(PROBABILITY_FLOOR)
    norm = F.lit(1.0) + eps * width
    joined = counts.join(F.broadcast(totals), "column").select(  # one row per column
        "column",
        ((F.try_divide("real_n", "_nr") + eps) / norm).alias("p"),
        ((F.try_divide("synth_n", "_ns") + eps) / norm).alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    m = (p + q) * 0.5
    sums = joined.groupBy("column").agg(
        metric(F.coalesce(F.sum(p * F.log(p / m) + q * F.log(q / m)) * 0.5, F.lit(0.0))).alias("jsd"),
        metric(F.coalesce(F.sum(p * F.log(p / q) + q * F.log(q / p)) * 0.5, F.lit(0.0))).alias("kld_sym"),
    )
    return sums


def fidelity_report(
    real: DataFrame, synth: DataFrame, target: str, n_bins: int = 10, weight: str | None = None
) -> DataFrame:
    """Long report ``(group, metric, value)``: every column, and the means as ``summary``."""
    features = [c for c in real.columns if c not in (target, weight)]
    for c in features:
        if c not in synth.columns:
            raise ValueError(f"the synthetic table has no column {c!r}")
    numeric = [c for c in features if is_numeric(real.schema[c].dataType)]
    categorical = [c for c in features if c not in numeric] + [target]
    by_column = divergence_by_column(real, synth, numeric, categorical, n_bins, weight)
    cells = F.array(
        F.struct(F.lit("jsd").alias("metric"), F.col("jsd").alias("value")),
        F.struct(F.lit("kld_sym").alias("metric"), F.col("kld_sym").alias("value")),
    )
    long = by_column.select(F.col("column").alias("group"), F.explode(cells).alias("m")).select("group", "m.*")
    # a column without values on either side has divergence 0 and counts in the mean
    n_columns = len(features) + 1
    means = long.groupBy("metric").agg((F.sum("value") / n_columns).alias("value"))
    summary = means.select(
        F.lit("summary").alias("group"), F.concat(F.lit("mean_"), "metric").alias("metric"),
        F.round("value", 6).alias("value"),
    )
    return long.withColumn("value", F.round("value", 6)).unionByName(summary)
