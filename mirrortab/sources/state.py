"""Fitted state as tables: dictionaries, bins, scaler moments, marginal generators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from mirrortab.operators.core import measure
from mirrortab.operators.discretize import Bins
from mirrortab.operators.encode import Dictionary, column_sizes
from mirrortab.operators.scalers import Moments, QuantileGrid
from mirrortab.plans.marginal import MarginalModel


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def save_dictionary(dictionary: Dictionary, path: str) -> None:
    _write(dictionary.df, f"{path}/values")
    spark = dictionary.df.sparkSession
    rows = [(c, t, dictionary.missing_first) for c, t in dictionary.types.items()]
    _write(spark.createDataFrame(rows, "column string, type string, missing_first boolean"), f"{path}/types")


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    values = spark.read.parquet(f"{path}/values")
    types = spark.read.parquet(f"{path}/types").collect()
    return Dictionary(
        values, column_sizes(values), {r["column"]: r["type"] for r in types}, any(r["missing_first"] for r in types)
    )


def save_bins(spark: SparkSession, bins: Bins, path: str) -> None:
    names = {*bins.edges, *bins.constant, *bins.fills}
    rows = [(c, bins.edges.get(c), bins.fills.get(c), c in bins.constant, i) for i, c in enumerate(sorted(names))]
    schema = "column string, edges array<double>, fill double, is_constant boolean, pos int"
    _write(spark.createDataFrame(rows, schema), path)


def load_bins(spark: SparkSession, path: str) -> Bins:
    rows = spark.read.parquet(path).orderBy("pos").collect()
    return Bins(
        {r["column"]: list(r["edges"]) for r in rows if r["edges"] is not None},
        {r["column"]: r["fill"] for r in rows if r["fill"] is not None},
        [r["column"] for r in rows if r["is_constant"]],
    )


def save_moments(spark: SparkSession, moments: Mapping[str, Moments], path: str) -> None:
    rows = [(c, m.lo, m.hi, m.mean, m.std) for c, m in moments.items()]
    _write(spark.createDataFrame(rows, "column string, lo double, hi double, mean double, std double"), path)


def load_moments(spark: SparkSession, path: str) -> dict[str, Moments]:
    return {
        r["column"]: Moments(r["lo"], r["hi"], r["mean"], r["std"]) for r in spark.read.parquet(path).collect()
    }


def save_marginal(spark: SparkSession, model: MarginalModel, path: str) -> None:
    if model.shares is not None:
        _write(model.shares.df, f"{path}/shares")
    rows = [
        (
            c, i, model.types[c], c in model.categorical, model.sizes.get(c),
            list(model.grids[c].values) if c in model.grids else None, *model.normal.get(c, (None, None)), model.rows,
        )
        for i, c in enumerate(model.columns)
    ]
    schema = (
        "column string, pos int, type string, is_categorical boolean, size bigint, grid array<double>, "
        "mean double, deviation double, n_rows bigint"
    )
    _write(spark.createDataFrame(rows, schema), f"{path}/columns")


def load_marginal(spark: SparkSession, path: str) -> MarginalModel:
    rows = spark.read.parquet(f"{path}/columns").orderBy("pos").collect()
    categorical = [r for r in rows if r["is_categorical"]]
    continuous = [r for r in rows if r["grid"] is not None]
    return MarginalModel(
        tuple(r["column"] for r in rows),
        {r["column"]: r["type"] for r in rows},
        tuple(r["column"] for r in categorical),
        measure(spark.read.parquet(f"{path}/shares")) if categorical else None,
        {r["column"]: r["size"] for r in categorical},
        {r["column"]: QuantileGrid(tuple(r["grid"])) for r in continuous},
        {r["column"]: (r["mean"], r["deviation"]) for r in continuous},
        rows[0]["n_rows"],
    )
