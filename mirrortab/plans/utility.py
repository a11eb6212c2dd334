"""Train on synthetic, test on real; real-against-synthetic detection; teacher votes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators.clean import numeric_columns
from mirrortab.operators.core import checkpointed, fit_table, lookup
from mirrortab.operators.encode import encode, fit_dictionary
from mirrortab.operators.metrics import (
    CLASSIFICATION_METRICS, REGRESSION_METRICS, classification_metrics, regression_metrics, roc_auc,
)
from mirrortab.operators.privacy import noisy_vote_aggregate
from mirrortab.operators.profile import infer_task_ratio
from mirrortab.operators.split import partition_disjoint
from mirrortab.plans.forest import SIDE_BY_SIDE, classified, label_points, parts_of, regressed, side_by_side
from mirrortab.plans.perceptron import fit_perceptron, perceived

CLASSIFIERS = ("LR", "MLP", "RF", "GBT")
DEEPEST_TREE = 30  # the library's limit; the usual default elsewhere is unlimited
GROWN = {"seed": 42, "checkpointInterval": 10, "maxMemoryInMB": 1024}
#: How often a distinct row stands, and that times its class's weight.
N, WEIGHT = "_n", "_weight"
CLIP = 1e-10
UTILITY_MODELS = {"lr": "LR", "rf": "RF", "mlp": "MLP", "gbt": "GBT"}


def _estimator(name: str, classes: int, rows: int, max_iter: int, rounds: int = 100):
    """Rows are counted in ``N``; with two classes the boosted trees weigh them evenly."""
    if name == "LR":
        # penalty 1/rows corresponds to an inverse strength of 1 on the summed loss
        return LogisticRegression(
            featuresCol="scaled", labelCol="label", maxIter=max_iter, regParam=1.0 / max(rows, 1), standardization=False, weightCol=N
        )
    if name == "GBT":
        tree = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, **GROWN)
        if classes == 2:
            return tree.setWeightCol(WEIGHT)
        # rounds follow each other, so classes are boosted side by side
        return OneVsRest(classifier=tree, featuresCol="features", labelCol="label", weightCol=N, parallelism=min(classes, SIDE_BY_SIDE))
    raise ValueError(f"unknown classifier {name!r}")


def _features(synth: DataFrame, real: DataFrame, target: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Numbers as they are, categories coded by one dictionary; classes from both tables."""
    features = [c for c in real.columns if c != target]
    both = synth.select(*features, target).unionByName(real.select(*features, target))
    text = [c for c in features if c not in numeric_columns(real, features)]
    dictionary = fit_dictionary(both, [*text, target])
    to_codes = lambda df: encode(df.select(*features, target), dictionary, [*text, target]).withColumn(
        "label", F.col(target).cast("double")
    )
    return to_codes(synth), to_codes(real), features, dictionary.cardinality(target)


def tstr_report(
    synth: DataFrame, real_test: DataFrame, target: str, classifiers: Sequence[str] = CLASSIFIERS,
    trees: int = 100, max_depth: int = DEEPEST_TREE, max_iter: int = 100, rounds: int = 100,
    metrics: Sequence[str] = ("accuracy", "f1_weighted", "auc"),
) -> DataFrame:
    """``(model, metric, value)``: each classifier fitted on synthetic, scored on real rows.

    ``metrics`` are those of :func:`classification_metrics` and ``auc``, which only two classes have.
    """
    unknown = set(metrics) - {*CLASSIFICATION_METRICS, "auc"}
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    train, test, features, classes = _features(synth, real_test, target)
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    prepared = Pipeline(stages=[assemble, scale]).fit(train)
    counted = lambda df: checkpointed(df.groupBy(*[F.col(f"`{c}`") for c in features], "label").agg(F.count(F.lit(1)).alias(N)))
    train_counts, test_counts = counted(train), counted(test)
    shape = train_counts.agg(
        F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum(N), F.lit(0)).alias("rows"), F.count_distinct("label").alias("labels"),
        F.sum(F.when(F.col("label") == 0, F.col(N)).otherwise(0)).alias("neg"),
        F.sum(F.when(F.col("label") == 1, F.col(N)).otherwise(0)).alias("pos"),
    ).first()
    if shape["labels"] < 2:
        return train.sparkSession.createDataFrame(
            [(m, "one synthetic class", None) for m in classifiers], "model string, metric string, value double"
        )
    ratio = shape["neg"] / shape["pos"] if shape["pos"] else 1.0
    points = checkpointed(prepared.transform(train_counts.coalesce(parts_of(shape["distinct"]))).withColumn(
        WEIGHT, F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)) * F.col(N)
    ))
    asked = checkpointed(prepared.transform(test_counts.coalesce(parts_of(test_counts.count()))))

    def scores(name: str) -> DataFrame:
        if name == "RF":
            scored = classified(points, asked, features, N, classes, trees, max_depth).withColumn("score", F.get("votes", F.lit(1)))
        elif name == "MLP":
            weights = fit_perceptron(points, len(features), classes, N, max_iter)
            scored = perceived(asked, weights, classes, ["label", N]).withColumn("score", F.get("votes", F.lit(1)))
        else:
            scored = _estimator(name, classes, shape["rows"], max_iter, rounds).fit(points).transform(asked)
            if classes == 2:
                scored = scored.withColumn("score", vector_to_array("probability")[1])
        return checkpointed(scored.select("label", "prediction", N, *(["score"] if classes == 2 else [])))

    reports = []
    for name, scored in zip(classifiers, side_by_side(train, scores, classifiers)):
        part = classification_metrics(scored, "label", "prediction", counted=N).where(F.col("metric").isin(*metrics))
        if classes == 2 and "auc" in metrics:
            part = part.unionByName(roc_auc(scored, "label", "score", N).select(F.lit("auc").alias("metric"), F.col("auc").alias("value")))
        reports.append(part.select(F.lit(name).alias("model"), "metric", F.round("value", 4).alias("value")))
    return reduce(DataFrame.unionByName, reports)


def utility_regression(
    synth: DataFrame, real_test: DataFrame, target: str, models: Sequence[str] = ("lr", "rf"), trees: int = 100,
    max_depth: int = DEEPEST_TREE,
) -> DataFrame:
    """``(model, metric, value)``: regressors fitted on synthetic, scored on real rows.

    Categories are one-hot with the values of both tables.  Equal rows are counted, and models are fitted on
    and applied to distinct feature vectors.
    """
    unknown = set(models) - {"lr", "rf"}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    features = [c for c in real_test.columns if c != target]
    numeric = numeric_columns(real_test, features)
    text = [c for c in features if c not in numeric]
    both = synth.select(*features).unionByName(real_test.select(*features))
    dictionary = fit_dictionary(both, text) if text else None
    # own names, as columns may be called anything
    names = {c: f"_x{i}" for i, c in enumerate(features)}
    inputs = list(names.values())
    coded = lambda df: (encode(df.select(*features, target), dictionary, text) if text else df).select(
        *[F.col(f"`{c}`").alias(x) for c, x in names.items()], F.col(f"`{target}`").cast("double").alias("y")
    )
    train, test = coded(synth), coded(real_test)
    stages = []
    if text:
        stages.append(OneHotEncoder(inputCols=[names[c] for c in text], outputCols=[f"_oh{names[c]}" for c in text], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*[names[c] for c in numeric], *[f"_oh{names[c]}" for c in text]], outputCol="features"))
    prepared = Pipeline(stages=stages).fit(train)
    counted = checkpointed(train.groupBy(*inputs, "y").agg(F.count(F.lit(1)).alias("n")))
    vectors = checkpointed(test.select(*inputs).distinct())
    points = prepared.transform(vectors.coalesce(parts_of(vectors.count()))).select(*inputs, "features")

    def predictions(name: str) -> DataFrame:
        if name == "rf":
            return regressed(counted, points, inputs, "n", prepared, trees, max_depth)
        mean = F.sum(F.col("n") * F.col("y")) / F.sum("n")
        stats = counted.groupBy(*inputs).agg(
            F.sum("n").cast("double").alias("_n"), mean.alias("_mean"),
            (F.sum(F.col("n") * F.col("y") * F.col("y")) / F.sum("n") - mean * mean).alias("_variance"),
        )
        rows = prepared.transform(label_points(stats, "_n", "_mean", "_variance")).select("features", "y", "w")
        return LinearRegression(labelCol="y", weightCol="w").fit(rows).transform(points).select(*inputs, "prediction")

    key = F.struct(*inputs).alias("_key")  # never null
    reports = []
    for name, found in zip(models, side_by_side(train, lambda m: fit_table(predictions(m).select(key, "prediction")), models)):
        scored = lookup(test.select(key, "y"), found, ["_key"])
        reports.append(regression_metrics(scored, "y", "prediction").select(F.lit(name).alias("model"), "metric", "value"))
    return reduce(DataFrame.unionByName, reports)


def utility_check(
    synth: DataFrame, real_test: DataFrame, target: str, model: str = "lr", task: str | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """``(model, metric, value)`` of one model; the task follows from the label when not given.

    Text labels and labels with fewer than 20 values are classes, others numbers.  ``metrics`` are
    accuracy, macro F1 and AUC, or all three of the regression, when not given.
    """
    if model not in UTILITY_MODELS:
        raise ValueError(f"unknown model {model!r}: choose from {sorted(UTILITY_MODELS)}")
    if task is None:
        task = infer_task_ratio(real_test, [target]).first()["task_by_count"]
    if task == "regression":
        if model not in ("lr", "rf"):
            raise ValueError(f"no regression with {model!r}: choose lr or rf")
        unknown = set(metrics or ()) - set(REGRESSION_METRICS)
        if unknown:
            raise ValueError(f"unknown metrics {sorted(unknown)}")
        report = utility_regression(synth, real_test, target, [model])
        return report.where(F.col("metric").isin(*metrics)) if metrics else report
    return tstr_report(
        synth, real_test, target, [UTILITY_MODELS[model]], metrics=metrics or ("accuracy", "f1_macro", "auc")
    )


def detection_score(real: DataFrame, synth: DataFrame, cols: Sequence[str], max_iter: int = 100) -> DataFrame:
    """``(metric, value)`` of a classifier telling real (1) from synthetic (0) rows.

    ``auc`` near 0.5 means indistinguishable; ``loss`` is the mean of ``-log(1 - p)`` over
    the real rows.
    """
    cols = list(cols)
    side = lambda df, y: df.select(*cols, F.lit(y).alias("side"))
    both = side(real, 1.0).unionByName(side(synth, 0.0))
    text = [c for c in cols if c not in numeric_columns(real, cols)]
    coded = encode(both, fit_dictionary(both, text), text) if text else both
    stages = []
    if text:
        stages.append(OneHotEncoder(inputCols=text, outputCols=[f"_oh_{c}" for c in text], handleInvalid="keep"))
    inputs = [c for c in cols if c not in text] + [f"_oh_{c}" for c in text]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
        LogisticRegression(labelCol="side", maxIter=max_iter),
    ]
    rows = checkpointed(coded)
    scored = checkpointed(
        Pipeline(stages=stages).fit(rows).transform(rows).select("side", vector_to_array("probability")[1].alias("p"))
    )
    loss = -F.log(F.greatest(F.lit(1.0) - F.col("p"), F.lit(CLIP)))
    return roc_auc(scored, "side", "p").select(F.lit("auc").alias("metric"), F.col("auc").alias("value")).unionByName(
        scored.where(F.col("side") == 1).agg(metric(F.avg(loss), 6).alias("value")).select(F.lit("loss").alias("metric"), "value")
    )


def teacher_ensemble(
    train: DataFrame, public: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
    teachers: int = 5, epsilon: float = 1.0, delta: float = 1e-5, seed: int = 42, noise_seed: int | str | None = None,
    max_iter: int = 100,
) -> DataFrame:
    """Noisy majority labels for public rows from teachers trained on disjoint parts.

    ``public`` needs a unique column ``record``; the label is 0/1.  A teacher whose part holds one
    class votes that class; one without rows does not vote, and the majority is of those who do.
    """
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    parts = checkpointed(assemble.transform(partition_disjoint(train, key, teachers, seed)).select("part", "features", F.col(label).cast("double").alias("label")))
    records = checkpointed(assemble.transform(public).select("record", "features"))
    held = parts.groupBy("part").agg(F.min("label").alias("low"), F.max("label").alias("high")).collect()  # a row a teacher
    classes = {r["part"]: (r["low"], r["high"]) for r in held if r["low"] is not None}
    if not classes:
        raise ValueError("no teacher has a labelled row")
    votes = []
    for t, (low, high) in sorted(classes.items()):
        if low == high:
            votes.append(records.select("record", F.lit(t).alias("teacher"), F.lit(int(low)).alias("vote")))
            continue
        fitted = LogisticRegression(maxIter=max_iter, regParam=1e-3).fit(parts.where(F.col("part") == t))
        votes.append(fitted.transform(records).select("record", F.lit(t).alias("teacher"), F.col("prediction").cast("int").alias("vote")))
    return noisy_vote_aggregate(reduce(DataFrame.unionByName, votes), len(classes), epsilon, delta, seed=noise_seed)
