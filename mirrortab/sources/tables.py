"""Tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mirrortab.operators.clean import NULL_TOKENS, drop_all_null_columns, is_numeric, null_tokens_to_null


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Delimited file with a header.  Give the schema for large files; without one the
    types are inferred by an extra pass."""
    reader = spark.read.option("header", True).option("nullValue", "?")
    return reader.csv(path, schema=schema) if schema is not None else reader.option("inferSchema", True).csv(path)


def load_and_clean(
    spark: SparkSession, path: str, schema: StructType | str | None = None, tokens: Sequence[str] = NULL_TOKENS
) -> DataFrame:
    """Read, turn null tokens into nulls, drop columns without a value."""
    return drop_all_null_columns(null_tokens_to_null(read_csv(spark, path, schema), tokens))


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One table partitioned by split; x and y are projections of it."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, part: str, split: str = "split") -> DataFrame:
    """One part of a split table; the filter prunes the other parts' files."""
    return spark.read.parquet(path).where(F.col(split) == part).drop(split)


def x_of(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(target or df.columns[-1])


def y_of(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.select(target or df.columns[-1])


def column_roles(df: DataFrame, target: str, task: str) -> DataFrame:
    """``(column, pos, block)``: numeric or categorical block of each column.

    The target joins the categorical block for classification, the numeric one for
    regression.  Known from the schema alone; the row count rides along.
    """
    rows = []
    for i, f in enumerate(df.schema.fields):
        number = (task == "regression") if f.name == target else is_numeric(f.dataType)
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("pos"), F.lit("numeric" if number else "categorical").alias("block")))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(F.array(*rows)).alias("r")).select("r.*", "n_rows")


def role_blocks(
    df: DataFrame, num_col_idx: Sequence[int], cat_col_idx: Sequence[int], target_col_idx: Sequence[int], task_type: str
) -> tuple[DataFrame, DataFrame]:
    """Numeric and categorical projections from column positions, target first in its block."""
    names = df.columns
    target = [names[i] for i in target_col_idx]
    numeric, categorical = [names[i] for i in num_col_idx], [names[i] for i in cat_col_idx]
    if task_type == "regression":
        numeric = target + numeric
    else:
        categorical = target + categorical
    return df.select(*numeric), df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in categorical])


def report_rows(report: DataFrame, decimals: int) -> DataFrame:
    return report.withColumn("value", F.round("value", decimals))


def write_report(report: DataFrame, path: str, decimals: int = 6) -> None:
    """Long metrics report as delimited text with a header."""
    report_rows(report, decimals).write.mode("errorifexists").option("header", True).csv(path)
