"""The two preprocessing flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.operators.clean import (
    drop_all_null_columns, fill_with, medians, null_tokens_to_null, numeric_columns, text_columns,
)
from mirrortab.operators.discretize import discretize, fit_bins
from mirrortab.operators.encode import encode, fit_dictionary


def _encode_target(df: DataFrame, target: str) -> DataFrame:
    """Target codes by sorted text, null as ``Missing``."""
    text = df.withColumn(target, F.col(f"`{target}`").cast("string"))
    return encode(text, fit_dictionary(text, [target]), [target])


def preprocess_tabular(
    df: DataFrame, target: str | None = None, bins: int = 10, strategy: str = "uniform"
) -> DataFrame:
    """Clean, discretise numbers, label-encode categories and the target."""
    target = target or df.columns[-1]
    clean = drop_all_null_columns(null_tokens_to_null(df))
    features = [c for c in clean.columns if c != target]
    numeric, text = numeric_columns(clean, features), text_columns(clean, features)
    fitted = fit_bins(clean, numeric, bins, strategy)
    binned = discretize(clean, fitted)
    coded = encode(binned, fit_dictionary(binned, text), text) if text else binned
    coded = _encode_target(coded, target)
    return coded.select(*[F.col(f"`{c}`").cast("int").alias(c) for c in features], target)


def encode_preprocess(df: DataFrame, target: str | None = None) -> DataFrame:
    """Clean, median-fill numbers, encode categories with ``Missing`` first, encode the
    target, and number the columns ``0..n-1`` (features first).

    Features become whole numbers, cut towards zero; an infinite or too large one is an error.
    """
    target = target or df.columns[-1]
    clean = drop_all_null_columns(null_tokens_to_null(df))
    features = [c for c in clean.columns if c != target]
    numeric, text = numeric_columns(clean, features), text_columns(clean, features)
    gaps = clean.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in numeric]).first() if numeric else {}
    filled = fill_with(clean, medians(clean, [c for c in numeric if gaps[c]]))
    coded = encode(filled, fit_dictionary(filled, text, missing_first=True), text) if text else filled
    whole = [F.col(f"`{c}`").cast("bigint" if c in numeric else "int").alias(c) for c in features]
    coded = _encode_target(coded, target).select(*whole, target)
    return coded.toDF(*[str(i) for i in range(len(coded.columns))])
