"""Forests on counted rows.

A tree sees a row through its features and its label, so equal rows are counted first, in one pass.  The
bootstrap stays one of rows: ``n`` equal rows that are each drawn Poisson(1) times are drawn Poisson(n) times
together.  A regression tree needs of the labels under one feature vector only their weight, mean and spread,
so it is fitted on two points a vector.  What a tree holds follows the distinct rows, not the rows, and no row
carries a number for each tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fits that run in threads of the driver, as long as each is at most so many rows.
SIDE_BY_SIDE, SIDE_ROWS = 8, 2_000_000
#: Distinct rows of one task.
TASK_ROWS = 50_000
#: Below so many rows a bootstrap can come out empty.
FEW_ROWS = 100


def side_by_side(df: DataFrame, work: Callable, items: Sequence, threads: int = SIDE_BY_SIDE) -> list:
    """``work`` of each item, in threads of the driver: rounds of one fit leave cores to the others."""
    if not items:
        return []
    with ThreadPool(min(len(items), threads)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items, chunksize=1)


def parts_of(rows: int) -> int:
    return max(1, math.ceil(rows / TASK_ROWS))


@lru_cache(maxsize=65_536)
def _poisson(n: int) -> tuple[int, np.ndarray]:
    """First value and cumulated probabilities of Poisson(n); what lies beyond 12 deviations has less than 1e-30."""
    reach = 12.0 * math.sqrt(n) + 40.0
    low = max(0, int(n - reach))
    k = np.arange(low, int(n + reach) + 1, dtype=float)
    factorial = math.lgamma(low + 1.0) + np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return low, np.cumsum(np.exp(k * math.log(n) - n - factorial))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_counts(key: np.ndarray, n: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each of the rows that stand ``n`` times: Poisson(n) by a hash of row and tree."""
    step = np.uint64((0x9E3779B97F4A7C15 * (tree + 1)) % 2**64)
    u = (_mixed(_mixed(key.astype(np.int64).view(np.uint64)) + step) >> np.uint64(11)) / 2.0**53
    out = np.zeros(len(n), dtype=np.int64)
    order = np.argsort(n, kind="stable")
    sizes, starts = np.unique(n[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, starts[1:])):
        low, upto = _poisson(int(size))
        out[rows] = low + np.minimum(np.searchsorted(upto, u[rows], side="right"), len(upto) - 1)
    return out


def drawn(cols: Sequence[str], n: str, tree: int) -> Column:
    """Weight of a counted row in one tree."""
    @F.pandas_udf("bigint")
    def weight(key: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series(bootstrap_counts(key.to_numpy(), count.to_numpy(), tree))

    return weight(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.col(n))


def label_points(stats: DataFrame, weight: str, mean: str, variance: str) -> DataFrame:
    """Two points a row with its weight, mean and variance: ``(..., y, w)``; fits of squared loss see no more of the labels."""
    point = lambda y, share: F.struct(y.alias("y"), (F.col(weight) * share).alias("w"))
    spread = F.sqrt(F.greatest(F.col(variance), F.lit(0.0)))
    points = F.when(
        spread > 0, F.array(point(F.col(mean) - spread, 0.5), point(F.col(mean) + spread, 0.5))
    ).otherwise(F.array(point(F.col(mean), 1.0)))
    return stats.withColumn("_point", F.explode(points)).select("*", "_point.y", "_point.w").drop("_point")


def _grown(estimator, rows: DataFrame, parts: int, few: bool):
    kept = rows.coalesce(parts).persist()
    try:
        return None if few and kept.isEmpty() else estimator.fit(kept)
    finally:
        kept.unpersist()


def _one_tree(kind, tree: int, max_depth: int, strategy: str, **names):
    return kind(
        numTrees=1, bootstrap=False, featureSubsetStrategy=strategy, maxDepth=max_depth, seed=42 + tree, maxMemoryInMB=1024, **names
    )


def classified(
    counted: DataFrame, points: DataFrame, cols: Sequence[str], n: str, classes: int, trees: int, max_depth: int
) -> DataFrame:
    """``points`` with ``votes`` (an array, a number for each class) and ``prediction``.

    ``counted`` holds distinct rows of ``cols`` and ``label``, their ``features`` and how often they stand.
    """
    size = counted.agg(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("total")).first()
    # so that a bootstrap without the last class has the same classes
    label = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})

    def tree(t: int):
        rows = counted.withColumn("_w", drawn([*cols, "label"], n, t)).where("_w > 0").select("features", label, "_w")
        fit = _one_tree(RandomForestClassifier, t, max_depth, "sqrt", featuresCol="features", labelCol="label", weightCol="_w")
        return _grown(fit, rows, parts_of(size["rows"]), size["total"] < FEW_ROWS)

    models = side_by_side(counted, tree, range(trees), SIDE_BY_SIDE if size["rows"] <= SIDE_ROWS else 1)
    scored, votes = points, []
    for t, model in enumerate(models):
        if model is not None:
            scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{t}").transform(scored)
            votes.append(vector_to_array(f"_p{t}"))
    held = scored.select(*[F.col(f"`{c}`") for c in points.columns], F.array(*votes).alias("_all"))
    share = lambda c: F.aggregate("_all", F.lit(0.0), lambda s, p: s + p[c]) / len(votes)
    voted = held.withColumn("votes", F.array(*[share(c) for c in range(classes)])).drop("_all")
    return voted.withColumn("prediction", (F.array_position("votes", F.array_max("votes")) - 1).cast("double"))


def regressed(
    counted: DataFrame, points: DataFrame, cols: Sequence[str], n: str, prepared, trees: int, max_depth: int
) -> DataFrame:
    """``points`` with ``prediction``; ``counted`` holds distinct rows of ``cols`` and ``y`` and how often they stand."""
    vectors = counted.select(*[F.col(f"`{c}`") for c in cols]).distinct().count()
    few = counted.agg(F.sum(n)).first()[0] < FEW_ROWS

    def tree(t: int):
        w = counted.withColumn("_w", drawn([*cols, "y"], n, t)).where("_w > 0")
        stats = w.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(
            F.sum("_w").cast("double").alias("_n"), (F.sum(F.col("_w") * F.col("y")) / F.sum("_w")).alias("_mean"),
            (F.sum(F.col("_w") * F.col("y") * F.col("y")) / F.sum("_w")).alias("_square"),
        ).withColumn("_variance", F.col("_square") - F.col("_mean") * F.col("_mean"))
        rows = prepared.transform(label_points(stats, "_n", "_mean", "_variance")).select("features", "y", "w")
        fit = _one_tree(RandomForestRegressor, t, max_depth, "onethird", featuresCol="features", labelCol="y", weightCol="w")
        return _grown(fit, rows, parts_of(2 * vectors), few)

    models = side_by_side(counted, tree, range(trees), SIDE_BY_SIDE if vectors <= SIDE_ROWS else 1)
    scored, means = points, []
    for t, model in enumerate(models):
        if model is not None:
            scored = model.setPredictionCol(f"_p{t}").transform(scored)
            means.append(F.col(f"_p{t}"))
    mean = F.aggregate(F.array(*means), F.lit(0.0), lambda s, p: s + p) / len(means)
    return scored.select(*[F.col(f"`{c}`") for c in points.columns], mean.alias("prediction"))
