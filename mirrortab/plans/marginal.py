"""Independent-marginals generator: categories by frequency, numbers normal in quantile space."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.functions import gaussian01, uniform01
from mirrortab.operators.clean import is_numeric
from mirrortab.operators.core import FitTable, fit_table
from mirrortab.operators.divergence import empirical_probabilities
from mirrortab.operators.profile import LOW_CARDINALITY, LOW_CARDINALITY_SHARE, distinct_counts
from mirrortab.operators.sampling import interval_lookup, intervals
from mirrortab.operators.scalers import QuantileGrid, fit_quantile_grids, from_normal, to_normal
from pyspark.sql.types import IntegralType

SIGMA_PADDING = 1e-6


@dataclass(frozen=True)
class MarginalModel:
    columns: tuple[str, ...]
    types: Mapping[str, str]
    categorical: tuple[str, ...]
    shares: FitTable | None  # column, value, lo, hi
    sizes: Mapping[str, int]
    grids: Mapping[str, QuantileGrid]
    normal: Mapping[str, tuple[float, float]]  # mean and deviation in quantile space
    rows: int


def categorical_columns(df: DataFrame) -> list[str]:
    """Text, and integers with at most 20 distinct values that are under 5 % of the rows."""
    text = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)]
    few: set[str] = set()
    if whole:
        few = {
            r["column"]
            for r in distinct_counts(df, whole).collect()
            if r["n_unique"] <= LOW_CARDINALITY and r["n_unique"] / max(r["n_rows"], 1) < LOW_CARDINALITY_SHARE
        }
    return [c for c in df.columns if c in text or c in few]


def fit_marginal(df: DataFrame, categorical: Sequence[str] | None = None) -> MarginalModel:
    categorical = list(categorical_columns(df) if categorical is None else categorical)
    continuous = [c for c in df.columns if c not in categorical]
    shares, sizes = None, {}
    if categorical:
        probabilities = empirical_probabilities(df, categorical)
        shares = fit_table(intervals(probabilities.drop("n"), ["column"], ["value"], "p"))
        sizes = {r["column"]: r["n"] for r in shares.df.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    grids, normal = {}, {}
    if continuous:
        typed = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in continuous])
        grids = fit_quantile_grids(typed, continuous)
        moments = typed.select(*[to_normal(F.col(f"`{c}`"), grids[c]).alias(c) for c in continuous]).agg(
            *[F.struct(F.avg(f"`{c}`").alias("m"), F.stddev_pop(f"`{c}`").alias("s")).alias(c) for c in continuous]
        ).first()
        normal = {c: (moments[c]["m"], moments[c]["s"] + SIGMA_PADDING) for c in continuous}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return MarginalModel(tuple(df.columns), types, tuple(categorical), shares, sizes, grids, normal, df.count())


def sample_marginal(
    model: MarginalModel, spark: SparkSession, n: int | None = None, seed: int = 42,
    conditional: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows with independent columns; a column in ``conditional`` has its given value in all rows.

    As the columns are independent, the others keep their own distributions.  A category that was
    not in the fitted table is refused.
    """
    fixed = dict(conditional or {})
    unknown = set(fixed) - set(model.columns)
    if unknown:
        raise ValueError(f"the model has no columns {sorted(unknown)}")
    for c in [c for c in fixed if c in model.categorical]:
        seen = model.shares.df.where((F.col("column") == c) & (F.col("value") == F.lit(fixed[c]).cast("string")))
        if seen.isEmpty():
            raise ValueError(f"{fixed[c]!r} is not a known value of {c!r}")
    rows = spark.range(model.rows if n is None else n)
    for c, value in fixed.items():
        rows = rows.withColumn(c, F.lit(value).cast(model.types[c] if c in model.categorical else "double"))
    for c in [c for c in model.categorical if c not in fixed]:
        size = model.sizes.get(c, 0)
        dim = model.shares.df.where(F.col("column") == c).select(F.col("value").alias("_value"), "lo", "hi")
        keyed = rows.withColumn("_u", uniform01(seed, "id", c))
        bytes_bound = model.shares.bytes  # of all columns together
        rows = (
            interval_lookup(keyed, FitTable(dim, size, bytes_bound), [], "_u")
            .withColumn(c, F.col("_value").cast(model.types[c])).drop("_u", "_value")
        )
    for c, grid in model.grids.items():
        if c in fixed:
            continue
        mean, deviation = model.normal[c]
        z = F.lit(mean) + F.lit(deviation) * gaussian01(seed, "id", c)
        rows = rows.withColumn(c, from_normal(z, grid))
    return rows.select("id", *model.columns)
