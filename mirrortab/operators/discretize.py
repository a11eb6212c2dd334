"""Numeric discretisers: equal width, quantile and one-dimensional k-means bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import try_double
from mirrortab.operators.clean import fill_with, medians
from mirrortab.operators.core import checkpointed, exact_quantiles, value_counts
from mirrortab.operators.divergence import bin_of

NARROWEST_BIN = 1e-8  # fixed value: quantile bins at most this wide are merged
KMEANS_TOLERANCE = 1e-4  # fixed value: relative to the column's variance


@dataclass(frozen=True)
class Bins:
    """Fitted edges per column, null fills and columns left alone (constant)."""

    edges: dict[str, list[float]]
    fills: dict[str, float]
    constant: list[str] = field(default_factory=list)


def fit_bins(
    df: DataFrame, cols: Sequence[str], n_bins: int = 10, strategy: str = "uniform", iterations: int = 300,
    tolerance: float = KMEANS_TOLERANCE,
) -> Bins:
    """Fit edges for all columns together; only edges (columns x bins) reach the driver."""
    if strategy not in ("uniform", "quantile", "kmeans"):
        raise ValueError(f"unknown binning strategy {strategy!r}")
    cols = list(cols)
    if not cols:
        return Bins({}, {}, [])
    typed = df.select(*[try_double(f"`{c}`").alias(c) for c in cols])
    stats = typed.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi"), F.count(f"`{c}`").alias("n"),
                F.var_pop(f"`{c}`").alias("var"),
            ).alias(c)
            for c in cols
        ],
    ).first()
    # only columns with nulls need the (costlier) exact median
    fills = medians(typed, [c for c in cols if stats[c]["n"] < stats["_rows"]])
    constant = [c for c in cols if stats[c]["lo"] is None or stats[c]["lo"] == stats[c]["hi"]]
    live = [c for c in cols if c not in constant]
    uniform = {c: _equal_width(stats[c]["lo"], stats[c]["hi"], n_bins) for c in live}
    if strategy == "uniform" or not live:
        return Bins(uniform, fills, constant)
    filled = fill_with(typed, fills)
    if strategy == "quantile":
        grid = [i / n_bins for i in range(n_bins + 1)]
        found: dict[str, list[float]] = {c: [] for c in live}
        for r in exact_quantiles(filled, live, grid).orderBy("column", "i").collect():
            found[r["column"]].append(r["value"])
        return Bins({c: _merged(e) for c, e in found.items()}, fills, constant)
    return Bins(_kmeans_edges(filled, uniform, stats, iterations, tolerance), fills, constant)


def _equal_width(lo: float, hi: float, n_bins: int) -> list[float]:
    step = (hi - lo) / n_bins
    return [i * step + lo for i in range(n_bins)] + [hi]


def _merged(edges: list[float]) -> list[float]:
    kept = edges[:1]
    for before, e in zip(edges, edges[1:]):
        if e - before > NARROWEST_BIN:
            kept.append(e)
    return kept


def _kmeans_edges(filled, uniform, stats, iterations: int, tolerance: float) -> dict[str, list[float]]:
    """Lloyd steps on ``(value, count)`` pairs of all columns; centres start at bin middles.

    Each step is one combined aggregation to ``columns x bins`` rows; those centres are all
    the driver holds.
    """
    counts = checkpointed(value_counts(filled, list(uniform), as_type="double"))
    centres = {c: [(a + b) / 2 for a, b in zip(e, e[1:])] for c, e in uniform.items()}
    moving = set(centres)
    for _ in range(iterations):
        if not moving:
            break
        cluster = F.lit(None).cast("int")
        for c in moving:
            middles = [(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])]
            nearest = F.lit(0)
            for m in middles:
                nearest = nearest + (F.col("value") > F.lit(m)).cast("int")
            cluster = F.when(F.col("column") == c, nearest).otherwise(cluster)
        means = (
            counts.where(F.col("column").isin(list(moving)))
            .groupBy("column", cluster.alias("cluster"))
            .agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
            .collect()
        )
        moved = {c: 0.0 for c in moving}
        for r in means:
            c, k = r["column"], r["cluster"]
            moved[c] += (centres[c][k] - r["mean"]) ** 2
            centres[c][k] = r["mean"]
        for c, shift in moved.items():
            if shift <= tolerance * stats[c]["var"]:
                moving.discard(c)
    edges = {}
    for c, e in uniform.items():
        inner = [(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])]
        edges[c] = [e[0], *inner, e[-1]]
    return edges


def discretize(df: DataFrame, bins: Bins) -> DataFrame:
    """Replace numbers by bin codes; nulls take the fill, constant columns keep their value."""
    cols = {}
    for c in [*bins.edges, *bins.constant]:
        number = try_double(f"`{c}`")
        if bins.fills.get(c) is not None:
            number = F.coalesce(number, F.lit(bins.fills[c]))
        cols[c] = bin_of(number, bins.edges[c]) if c in bins.edges else number.cast(df.schema[c].dataType)
    return df.withColumns(cols)
