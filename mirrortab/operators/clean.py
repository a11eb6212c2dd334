"""Null tokens, coercion, imputation by constants, row filters, column alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType

from mirrortab.functions import try_double
from mirrortab.operators.core import exact_quantiles, value_counts

# Texts that mean "no value" in a delimited file.
NULL_TOKENS = (
    "?", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

MISSING = "Missing"
PLACEHOLDER = "placeholder"


def is_numeric(dtype: DataType) -> bool:
    return isinstance(dtype, NumericType) and not isinstance(dtype, BooleanType)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns) if is_numeric(df.schema[c].dataType)]


def text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns) if not is_numeric(df.schema[c].dataType)]


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Replace null tokens in string columns, and NaN in float columns, by null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            c = F.when(~c.isin(list(tokens)), c)
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one aggregate over all columns."""
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if seen[c]])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: try_double(c) for c in cols})


def medians(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> dict[str, float]:
    """Exact medians of all columns: one row per column reaches the driver."""
    if not cols:
        return {}
    counts = value_counts(df, cols, as_type="double", weight=weight)
    return {r["column"]: r["value"] for r in exact_quantiles(df, cols, [0.5], counts).collect()}


def fill_with(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls by column; the column keeps its place."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in values.items() if v is not None})


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols if cols is not None else numeric_columns(df))
    typed = df.withColumns({c: try_double(c) for c in cols})
    return fill_with(typed, medians(typed, cols))


def impute_missing_token(df: DataFrame, cols: Sequence[str], token: str = MISSING) -> DataFrame:
    return df.withColumns({c: missing_text(F.col(f"`{c}`"), token) for c in cols})


def missing_text(c: Column, token: str = MISSING) -> Column:
    return F.coalesce(c.cast("string"), F.lit(token))


def unified_missing(c: Column, token: str = MISSING) -> Column:
    """Trimmed text in which null and the lower-case token are the token."""
    trimmed = F.trim(c.cast("string"))
    return F.coalesce(F.when(trimmed == token.lower(), F.lit(token)).otherwise(trimmed), F.lit(token))


def clean_generated(
    df: DataFrame, numeric: Sequence[str], drop_nan: bool = False, placeholder: str = PLACEHOLDER
) -> DataFrame:
    """Keep generated rows that are complete enough and whose numbers parse; cast them.

    Drops rows with a placeholder cell, rows with only nulls (with ``drop_nan`` any null)
    and rows with an unparsable number; a null number stays.
    """
    complete = F.lit(True)
    for c in text_columns(df):
        complete &= F.coalesce(F.col(f"`{c}`") != placeholder, F.lit(True))
    rows = df.where(complete).dropna(how="any" if drop_nan else "all")
    for c in numeric:
        rows = rows.where(try_double(c).isNotNull() | F.col(f"`{c}`").isNull())
    return rows.withColumns({c: try_double(c) for c in numeric}) if numeric else rows


def align_columns(df: DataFrame, real_columns: Sequence[str]) -> DataFrame:
    """Give a table the real column names when the counts match, in the real order."""
    real_columns = list(real_columns)
    if set(df.columns) == set(real_columns):
        return df.select(*real_columns)
    if len(df.columns) == len(real_columns):
        return df.toDF(*real_columns)
    raise ValueError(f"{len(df.columns)} columns cannot be aligned to {len(real_columns)}")


def round_clip(c: Column, cardinality: int) -> Column:
    """Nearest code (half to even) inside ``0 .. cardinality-1``; null and NaN give null."""
    number = c.cast("double")
    inside = F.greatest(F.lit(0), F.least(F.rint(number), F.lit(cardinality - 1))).cast("int")
    return F.when(number.isNotNull() & ~F.isnan(number), inside)
