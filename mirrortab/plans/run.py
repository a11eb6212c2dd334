"""Whole runs: split, fit, sample, evaluate; generators by name; comparison of generators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators.core import checkpointed, free_name, stored
from mirrortab.operators.divergence import fidelity_report
from mirrortab.operators.information import compact
from mirrortab.operators.nearest import dcr
from mirrortab.operators.profile import BINARY, MULTICLASS, presplit_check
from mirrortab.operators.split import stratified_kfold, stratified_split
from mirrortab.plans.kdb import fit_kdb, load_kdb, sample_conditional, sample_kdb
from mirrortab.plans.marginal import fit_marginal, sample_marginal
from mirrortab.plans.utility import tstr_report, utility_check
from mirrortab.sources.runs import DatasetRegistry, RunPaths, new_run_id, register_dataset
from mirrortab.sources.state import load_marginal, save_marginal
from mirrortab.sources.tables import read_split, write_report, write_split


class Synthesizer(Protocol):
    """A generator: fit on a table, then sample rows."""

    requirements: Mapping[str, object]

    def fit(self, df: DataFrame, target: str) -> "Synthesizer": ...

    def sample(self, spark: SparkSession, n: int | None = None, seed: int = 42) -> DataFrame: ...


def quick_check(
    generator: Synthesizer, spark: SparkSession, real_test: DataFrame, target: str, model: str, metrics: Sequence[str] | None
) -> DataFrame:
    synth = generator.sample(spark, real_test.count()).select(*real_test.columns)
    return utility_check(checkpointed(synth), real_test, target, model, metrics=metrics)


class KdbSynthesizer:
    """k-dependence Bayes network on discrete columns."""

    requirements: Mapping[str, object] = {"allowed_tasks": [BINARY, MULTICLASS]}

    def __init__(self, k: int = 2) -> None:
        self.k, self.model = k, None

    def fit(self, df: DataFrame, target: str) -> "KdbSynthesizer":
        self.model = fit_kdb(df, target, self.k)
        return self

    def sample(self, spark: SparkSession, n: int | None = None, seed: int = 42, conditional: Mapping[str, object] | None = None) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit before sample")
        if conditional:
            return sample_conditional(self.model, spark, self.model.rows if n is None else n, conditional, seed)
        return sample_kdb(self.model, spark, n, seed)

    def save(self, path: str) -> None:
        self.model.save(path)

    def load(self, spark: SparkSession, path: str) -> "KdbSynthesizer":
        self.model = load_kdb(spark, path)
        return self

    def evaluate(self, spark: SparkSession, real_test: DataFrame, model: str = "lr", metrics: Sequence[str] | None = None) -> DataFrame:
        """Utility check on as many sampled rows as there are real ones."""
        return quick_check(self, spark, real_test, self.model.target, model, metrics)


class MarginalSynthesizer:
    """Every column on its own."""

    requirements: Mapping[str, object] = {}

    def __init__(self, categorical: Sequence[str] | None = None) -> None:
        self.categorical, self.model, self.target = categorical, None, None

    def fit(self, df: DataFrame, target: str) -> "MarginalSynthesizer":
        self.target = target
        self.model = fit_marginal(df, self.categorical)
        return self

    def sample(self, spark: SparkSession, n: int | None = None, seed: int = 42, conditional: Mapping[str, object] | None = None) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit before sample")
        return sample_marginal(self.model, spark, n, seed, conditional)

    def evaluate(
        self, spark: SparkSession, real_test: DataFrame, model: str = "lr", metrics: Sequence[str] | None = None,
        target: str | None = None,
    ) -> DataFrame:
        """Utility check on as many sampled rows as there are real ones; a loaded model needs ``target``."""
        target = target or self.target
        if target is None:
            raise ValueError("name the target: the stored model has none")
        return quick_check(self, spark, real_test, target, model, metrics)

    def save(self, path: str) -> None:
        save_marginal(SparkSession.active(), self.model, path)

    def load(self, spark: SparkSession, path: str) -> "MarginalSynthesizer":
        self.model = load_marginal(spark, path)
        return self


SYNTHESIZERS: dict[str, type] = {"kdb": KdbSynthesizer, "marginal": MarginalSynthesizer}

Evaluation = Callable[..., DataFrame]


def evaluate_fidelity(real_train: DataFrame, real_test: DataFrame, synth: DataFrame, target: str, **options) -> DataFrame:
    """Marginal divergences and distance to the closest record, against the train rows.

    Each table is read once, for its distinct rows with their counts; everything follows from these.
    """
    columns = real_train.columns
    features, n = [c for c in columns if c != target], free_name("_n", columns)
    real, drawn = (compact(rows, columns, n) for rows in (real_train, synth))
    near = dcr(real, drawn, features, n).select(F.lit("summary").alias("group"), "metric", "value")
    return fidelity_report(real, drawn, target, weight=n, **options).unionByName(near)


def evaluate_utility(real_train: DataFrame, real_test: DataFrame, synth: DataFrame, target: str, **options) -> DataFrame:
    report = tstr_report(synth, real_test, target, **options)
    return report.select(F.col("model").alias("group"), "metric", "value")


EVALUATIONS: dict[str, Evaluation] = {"fidelity": evaluate_fidelity, "utility": evaluate_utility}


def run_train_test(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    synthesizer: str | Synthesizer | Callable[[], Synthesizer] = "kdb",
    evaluations: Mapping[str, Evaluation] | Sequence[str] = ("fidelity",),
    test_size: float = 0.2,
    seed: int = 42,
    n: int | None = None,
    options: Mapping[str, Mapping[str, object]] | None = None,
    dataset: str | None = None,
    root: str | None = None,
    test: DataFrame | None = None,
) -> tuple[DataFrame, Synthesizer]:
    """Split (or take a given ``test``), fit on train, sample, evaluate.

    Returns the long report ``(evaluation, group, metric, value)`` and the fitted generator.
    With ``root`` and ``dataset`` the dataset is registered and checked first, and split,
    model state, synthetic rows and reports are written under versioned paths.
    """
    spark = df.sparkSession
    maker = SYNTHESIZERS[synthesizer] if isinstance(synthesizer, str) else synthesizer
    generator = maker() if callable(maker) else maker
    name = synthesizer if isinstance(synthesizer, str) else type(generator).__name__
    paths = None
    if root is not None:
        if dataset is None:
            raise ValueError("a run under a root needs a dataset name")
        data = df.drop(*key)
        _, checks = register_dataset(DatasetRegistry(spark, root), data, dataset, target, {name: generator.requirements})
        verdict = checks.first()
        if not verdict["ok"]:
            raise ValueError(f"dataset {dataset!r} does not suit {name!r}: {verdict['message']}")
        paths = RunPaths(root, dataset, new_run_id("split"))
    if test is None:
        marked = stratified_split(df, target, key, test_size, seed)
    else:
        presplit_check(df, test, target)
        marked = df.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    if paths is not None:
        write_split(marked, paths.split)
        marked = spark.read.parquet(paths.split)
    else:
        marked = stored(marked.drop(*key))
    pick = lambda part: marked.where(F.col("split") == part).drop("split", *key)
    train, held_out = pick("train"), pick("test")
    generator.fit(train, target)
    synth = generator.sample(spark, n, seed).select(*train.columns)
    run_id = new_run_id("train")
    if paths is not None:
        synth.write.parquet(paths.synthetic(name, run_id))
        synth = spark.read.parquet(paths.synthetic(name, run_id))
        if hasattr(generator, "save"):
            generator.save(paths.state(name, run_id))
    else:
        synth = stored(synth)
    chosen = evaluations if isinstance(evaluations, Mapping) else {e: EVALUATIONS[e] for e in evaluations}
    reports = []
    for title, evaluation in chosen.items():
        report = evaluation(train, held_out, synth, target, **dict((options or {}).get(title, {})))
        if paths is not None:
            write_report(report, paths.report(name, run_id, title, new_run_id("eval")))
        reports.append(report.select(F.lit(title).alias("evaluation"), "group", "metric", "value"))
    return reduce(DataFrame.unionByName, reports), generator


def run_kfold(
    df: DataFrame, target: str, key: Sequence[str],
    synthesizer: str | Callable[[], Synthesizer] = "kdb",
    evaluations: Mapping[str, Evaluation] | Sequence[str] = ("fidelity",),
    k: int = 5, seed: int = 42, n: int | None = None,
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Cross-validation: each fold is held out once while a new generator is fitted on the others.

    Returns ``(evaluation, group, metric, folds, mean, deviation)`` over the folds that have the
    metric; the deviation is that of the population.
    """
    if k < 2:
        raise ValueError("cross-validation needs at least two folds")
    folds = checkpointed(stratified_kfold(df, target, key, k, seed))
    data = [c for c in df.columns if c not in key]
    reports = []
    for i in range(k):
        train, held_out = (folds.where(rows).select(*data) for rows in (F.col("fold") != i, F.col("fold") == i))
        maker = SYNTHESIZERS[synthesizer] if isinstance(synthesizer, str) else synthesizer
        generator = maker().fit(train, target)
        synth = checkpointed(generator.sample(df.sparkSession, n, seed).select(*data))
        chosen = evaluations if isinstance(evaluations, Mapping) else {e: EVALUATIONS[e] for e in evaluations}
        for title, evaluation in chosen.items():
            report = evaluation(train, held_out, synth, target, **dict((options or {}).get(title, {})))
            reports.append(checkpointed(report.select(F.lit(title).alias("evaluation"), "group", "metric", "value")))
    return reduce(DataFrame.unionByName, reports).groupBy("evaluation", "group", "metric").agg(
        F.count("value").alias("folds"), metric(F.avg("value"), 6).alias("mean"),
        metric(F.stddev_pop("value"), 6).alias("deviation"),
    )


def evaluate_run(
    spark: SparkSession, paths: RunPaths, name: str, run_id: str, target: str, key: Sequence[str],
    evaluations: Mapping[str, Evaluation] | Sequence[str] = ("fidelity",),
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Evaluate the stored synthetic rows of a run against its stored split."""
    train, held_out = (read_split(spark, paths.split, part).drop(*key) for part in ("train", "test"))
    synth = spark.read.parquet(paths.synthetic(name, run_id))
    chosen = evaluations if isinstance(evaluations, Mapping) else {e: EVALUATIONS[e] for e in evaluations}
    reports = []
    for title, evaluation in chosen.items():
        report = evaluation(train, held_out, synth, target, **dict((options or {}).get(title, {})))
        write_report(report, paths.report(name, run_id, title, new_run_id("eval")))
        reports.append(report.select(F.lit(title).alias("evaluation"), "group", "metric", "value"))
    return reduce(DataFrame.unionByName, reports)


def compare_models(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Long reports ``(group, metric, value)`` of several generators side by side."""
    long = reduce(
        DataFrame.unionByName,
        [r.select(F.lit(name).alias("generator"), "group", "metric", "value") for name, r in reports.items()],
    )
    return long.groupBy("group", "metric").pivot("generator", list(reports)).agg(F.first("value"))
