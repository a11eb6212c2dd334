"""Utility metrics from stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators.core import running_total


CLASSIFICATION_METRICS = ("accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted")
REGRESSION_METRICS = ("r2", "mae", "rmse")


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive for 0/1 labels; 1 when there is no positive."""
    counts = df.agg(
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
    )
    ratio = F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
    return counts.select("n_neg", "n_pos", metric(ratio).alias("scale_pos_weight"))


def _long(row: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return row.select(*keep, F.explode(cells).alias("m")).select(*keep, "m.*")


def classification_metrics(
    predictions: DataFrame, label: str, predicted: str, keep: Sequence[str] = (), counted: str | None = None
) -> DataFrame:
    """``(keep..., metric, value)``: accuracy, weighted and macro F1, weighted precision, recall.

    From the confusion counts; a class without predictions or rows scores 0.  Macro F1
    averages over the classes that occur as label or prediction.  A row stands for ``counted`` rows, if given.
    """
    keep = list(keep)
    rows = F.sum(counted) if counted else F.count(F.lit(1))
    confusion = predictions.groupBy(*keep, F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(
        rows.alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    as_label = confusion.select(*keep, F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).alias("called"), hit.alias("tp"))
    as_call = confusion.select(*keep, F.col("p").alias("c"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("tp"))
    per_class = as_label.unionByName(as_call).groupBy(*keep, "c").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    scored = per_class.select(
        *keep, "support", "tp",
        ratio(F.col("tp"), F.col("called")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
    )
    weighted = lambda c: metric(F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    summed = scored.groupBy(*keep).agg(
        metric(F.sum("tp") / F.sum("support")).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        metric(F.avg("f1")).alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
    )
    return _long(summed, CLASSIFICATION_METRICS, keep)


def roc_auc(predictions: DataFrame, label: str, score: str, counted: str | None = None) -> DataFrame:
    """One row ``auc``: rank formula, ties count half; null unless both classes occur.

    Scores are grouped first, then a distributed running total counts the negatives below.  A row stands
    for ``counted`` rows, if given.
    """
    one = F.col(counted) if counted else F.lit(1)
    grouped = predictions.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, one).otherwise(0)).alias("neg"),
    )
    run = running_total(grouped.withColumn("_all", F.lit(0)), ["_all"], ["s"], "neg", "cum", "total")
    below = F.col("cum") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") * 0.5))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.agg(metric(F.try_divide(won, pairs)).alias("auc"))


def regression_metrics(predictions: DataFrame, label: str, predicted: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., metric, value)``: R2, mean absolute error, root mean squared error."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    summed = predictions.groupBy(*keep).agg(
        metric(F.lit(1.0) - F.try_divide(residual, spread), 6).alias("r2"),
        metric(F.avg(F.abs(y - p)), 6).alias("mae"),
        metric(F.sqrt(F.avg((y - p) * (y - p))), 6).alias("rmse"),
    )
    return _long(summed, REGRESSION_METRICS, keep)
