"""Dataset profile, task and schema inference, compatibility rules, presplit checks."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, NumericType, StringType,
    TimestampNTZType, TimestampType,
)

from mirrortab.operators.clean import is_numeric
from mirrortab.operators.core import with_scalars
from mirrortab.operators.divergence import label_tv_distance

# Thresholds of the inference rules.
CATEGORICAL_MAX_DISTINCT = 32
REGRESSION_ABOVE_DISTINCT = 10
LOW_CARDINALITY = 20
LOW_CARDINALITY_SHARE = 0.05
LABEL_SHIFT_WARNING = 0.25

BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, pos, n_rows, n_unique)``: distinct non-null values of all columns, one pass."""
    cols = list(cols or df.columns)
    exprs = [F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(cols)]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *exprs)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.columns.index(c)).alias("pos"),
                F.col(f"u{i}").alias("n_unique"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select("n_rows", F.explode(cells).alias("c")).select("c.column", "c.pos", "n_rows", "c.n_unique")


def _type_flag(df: DataFrame, test) -> Column:
    names = [f.name for f in df.schema.fields if test(f.dataType)]
    return F.col("column").isin(names) if names else F.lit(False)


def _is_datetime(t: DataType) -> bool:
    return isinstance(t, (TimestampType, TimestampNTZType, DateType))


def _is_float(t: DataType) -> bool:
    return isinstance(t, (FloatType, DoubleType))


def dataset_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: position, kind, distinct count, role, and the table's sizes."""
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not a column")
    numeric = lambda t: isinstance(t, (NumericType, BooleanType))
    kind = (
        F.when(_type_flag(df, _is_datetime), "datetime")
        .when(_type_flag(df, numeric), "numeric")
        .when(F.col("n_unique") <= CATEGORICAL_MAX_DISTINCT, "categorical")
        .otherwise("text")
    )
    return distinct_counts(df).select(
        "column", "pos", kind.alias("kind"), "n_unique",
        F.when(F.col("column") == target, "target").otherwise("feature").alias("role"),
        "n_rows",
        F.lit(len(df.columns) - 1).alias("n_features"),
    )


def infer_task(df: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """``(target, task, n_classes)`` for each candidate target, all in one pass."""
    targets = list(targets or [df.columns[-1]])
    is_number = lambda t: isinstance(t, (NumericType, BooleanType))
    n = F.col("n_unique")
    regression = _type_flag(df, is_number) & (n > REGRESSION_ABOVE_DISTINCT)
    task = F.when(regression, REGRESSION).when(n == 2, BINARY).otherwise(MULTICLASS)
    return distinct_counts(df, targets).select(
        F.col("column").alias("target"), task.alias("task"),
        F.when(~regression, n).alias("n_classes"),
    )


def infer_task_ratio(df: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """Alternative rules: by the share of distinct values, and by a fixed distinct limit."""
    targets = list(targets or [df.columns[-1]])
    n = F.col("n_unique")
    allowed = F.greatest(F.lit(LOW_CARDINALITY), F.floor(F.lit(LOW_CARDINALITY_SHARE) * F.col("n_rows")))
    by_share = ~_type_flag(df, _is_float) | (n <= allowed)
    by_count = _type_flag(df, lambda t: isinstance(t, StringType)) | (n < LOW_CARDINALITY)
    name = lambda c: F.when(c, "classification").otherwise("regression")
    return distinct_counts(df, targets).select(
        F.col("column").alias("target"), name(by_share).alias("task_by_share"),
        name(by_count).alias("task_by_count"),
    )


def infer_schema(df: DataFrame) -> DataFrame:
    """Column kinds under the three rule sets, with min / max / mean / sample deviation.

    ``kind_low_share``: text, or integers with at most 20 distinct values that are under
    5 % of the rows, are categorical.  ``kind_low_count``: text, or numbers with at most 20
    distinct values, are categorical.  ``kind_by_type``: text is categorical, integers are
    discrete, other numbers continuous.
    """
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    stats = [
        (c, fn(F.col(f"`{c}`").cast("double")).alias(f"{name}{i}"))
        for i, c in enumerate(df.columns)
        if c in numeric
        for name, fn in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp))
    ]
    missing = F.lit(None).cast("double")
    wide = df.agg(F.lit(1).alias("_one"), *[e for _, e in stats])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[
                    (F.col(f"{s}{i}") if c in numeric else missing).alias(s)
                    for s in ("min", "max", "avg", "std")
                ],
            )
            for i, c in enumerate(df.columns)
        ]
    )
    moments = wide.select(F.explode(cells).alias("m")).select("m.*")
    n, rows = F.col("n_unique"), F.greatest(F.col("n_rows"), F.lit(1))
    is_text = _type_flag(df, lambda t: not is_numeric(t))
    is_int = _type_flag(df, lambda t: isinstance(t, IntegralType))
    few_share = is_int & (n <= LOW_CARDINALITY) & (n / rows < LOW_CARDINALITY_SHARE)
    named = lambda c: F.when(c, "categorical").otherwise("continuous")
    return distinct_counts(df).join(F.broadcast(moments), "column").select(
        "column", "n_unique",
        named(is_text | few_share).alias("kind_low_share"),
        named(is_text | (n <= LOW_CARDINALITY)).alias("kind_low_count"),
        F.when(is_text, "categorical").when(is_int, "discrete").otherwise("continuous").alias("kind_by_type"),
        F.col("min").alias("min_value"), F.col("max").alias("max_value"),
        F.round("avg", 7).alias("mean_value"), F.round("std", 7).alias("std_value"),
    )


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return distinct_counts(df, cols).select(
        "column", "n_unique", (F.col("n_unique") <= 1).alias("is_constant")
    )


def check_compatibility(
    profile: DataFrame, task: DataFrame, requirements: Mapping[str, Mapping[str, object]]
) -> DataFrame:
    """``(model, ok, message)`` for every model's declared requirements.

    With several targets in ``task`` every model is judged for each, and ``target`` comes first.
    """
    named = [c for c in task.columns if c == "target"] if len(task.take(2)) > 1 else []
    features = profile.where(F.col("role") == "feature").agg(
        F.sum(F.when(F.col("kind") == "numeric", 0).otherwise(1)).alias("not_numeric")
    )
    one = with_scalars(task, features)
    checks = []
    for model, need in requirements.items():
        message = F.lit("ok")
        if need.get("requires_numeric_only"):
            message = F.when(F.col("not_numeric") > 0, "feature columns must be numeric").otherwise(message)
        if need.get("min_classes") is not None:
            message = F.when(F.col("n_classes") < need["min_classes"], f"fewer than {need['min_classes']} classes").otherwise(message)
        if need.get("max_classes") is not None:
            message = F.when(F.col("n_classes") > need["max_classes"], f"more than {need['max_classes']} classes").otherwise(message)
        if need.get("allowed_tasks"):
            allowed = list(need["allowed_tasks"])
            message = F.when(~F.col("task").isin(allowed), F.concat(F.lit("task not allowed: "), F.col("task"))).otherwise(message)
        if not need:
            message = F.lit("no requirements declared")
        checks.append(F.struct(F.lit(model).alias("model"), message.alias("message")))
    rows = one.select(*named, F.explode(F.array(*checks)).alias("c")).select(*named, "c.*")
    return rows.select(*named, "model", F.col("message").isin("ok", "no requirements declared").alias("ok"), "message")


def presplit_check(train: DataFrame, test: DataFrame, target: str | None = None) -> float:
    """Validate a given split; returns the total variation of the labels, warns when large."""
    if train.columns != test.columns:
        raise ValueError(f"Column mismatch: train has {train.columns}, test has {test.columns}")
    for name in train.columns:
        a, b = train.schema[name].dataType, test.schema[name].dataType
        if a != b:
            raise ValueError(f"Type mismatch for column {name!r}: train {a}, test {b}")
    if train.isEmpty():
        raise ValueError("train is empty")
    if test.isEmpty():
        raise ValueError("test is empty")
    tv = label_tv_distance(train, test, target or train.columns[-1]).first()["tv"]
    if tv > LABEL_SHIFT_WARNING:
        warnings.warn(f"train and test labels differ: total variation {tv:.3f}", stacklevel=2)
    return tv
