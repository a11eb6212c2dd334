"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

# Fixed value: marker a decoded row may end with.
END_OF_TEXT = "<|endoftext|>"


def slug(name: Column) -> Column:
    """Path-safe name: lower case letters, digits and single hyphens, never empty."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(words, "-")).when(name.isNotNull(), F.lit("unnamed"))


def clean_decoded_text(text: Column) -> Column:
    """Drop the end marker and carriage returns, turn line feeds into spaces."""
    unmarked = F.replace(text, F.lit(END_OF_TEXT), F.lit(""))
    return F.translate(unmarked, "\n\r", " ")


def format_float(value: Column, precision: int) -> Column:
    """Fixed-point text without trailing zeros."""
    fixed = F.when(value.isNotNull(), F.format_string(f"%.{precision}f", value))
    if precision == 0:
        return fixed
    return F.regexp_replace(fixed, r"\.?0+$", "")


def format_cell(value: Column, dtype: DataType, float_precision: int | None = None) -> Column:
    """A cell as text; floats use ``float_precision`` when it is given."""
    if float_precision is not None and isinstance(dtype, (DoubleType, FloatType)):
        return format_float(value, float_precision)
    if isinstance(dtype, (DoubleType, FloatType)):
        return plain_float(value)
    return F.trim(value.cast("string"))


def plain_float(value: Column) -> Column:
    """Shortest text of a float; without an exponent from 1e-4 to below 1e16."""
    shortest, size = value.cast("string"), F.abs(value)
    digits = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    exponent = F.contains(shortest, F.lit("E")) & (size >= 1e-4) & (size < 1e16)
    return F.when(exponent, F.coalesce(plain, shortest)).otherwise(shortest)


def first_number(text: Column) -> Column:
    """First signed decimal in the text, or null."""
    found = F.regexp_extract(text, r"-?\d+\.?\d*", 0)
    return F.when(found != "", found)
