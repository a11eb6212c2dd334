"""Models of the utility reports are fitted on distinct rows, with results of all rows."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mirrortab.plans import utility


@pytest.fixture
def fitted_rows(monkeypatch):
    """Rows that every fit of a model on labelled rows was given."""
    seen, fit = [], Estimator.fit

    def counted(self, dataset, params=None):
        if self.hasParam("labelCol"):
            seen.append(dataset.count())
        return fit(self, dataset, params)

    monkeypatch.setattr(Estimator, "fit", counted)
    return seen


def test_regression_reads_distinct_vectors(spark, fitted_rows):
    df = spark.range(4000).select((F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "u").alias("b"), (F.col("id") % 6 * 10 + F.col("id") % 7).cast("double").alias("y"))
    got = {(r["model"], r["metric"]): r["value"] for r in utility.utility_regression(df, df, "y", trees=4).collect()}
    assert max(fitted_rows) <= 12  # two points for each of six vectors
    rows = np.array([(r["a"], r["b"] is None, r["y"]) for r in df.collect()], dtype=float)
    x = np.column_stack([np.ones(len(rows)), rows[:, :2]])
    residual = rows[:, 2] - x @ np.linalg.lstsq(x, rows[:, 2], rcond=None)[0]
    assert got["lr", "rmse"] == pytest.approx(np.sqrt((residual**2).mean()), abs=1e-5)
    assert got["lr", "mae"] == pytest.approx(np.abs(residual).mean(), abs=1e-5)
    assert 0.2 < got["rf", "r2"] < 0.99


def test_classifiers_read_distinct_rows(spark, fitted_rows):
    df = spark.range(3000).select((F.col("id") % 5).alias("a"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("b"), F.when((F.col("id") % 10 < 4) | (F.col("id") % 90 == 7), "p").otherwise("q").alias("y"))
    report = utility.tstr_report(df, df, "y", trees=3, max_depth=4, max_iter=60, rounds=3)
    got = {(r["model"], r["metric"]): r["value"] for r in report.collect()}
    assert max(fitted_rows) <= 20
    for model in ("MLP", "RF", "GBT"):
        assert 0.75 < got[model, "accuracy"] <= 0.9887 and got[model, "auc"] > 0.75


def test_bootstrap_is_one_of_rows():
    from mirrortab.plans.forest import bootstrap_counts

    key = np.arange(20_000, dtype=np.int64) * 7919
    for n in (1, 7, 5000):
        drawn = bootstrap_counts(key, np.full(len(key), n), 3)
        assert drawn.mean() == pytest.approx(n, rel=0.03) and drawn.var() == pytest.approx(n, rel=0.05)
    assert abs(np.corrcoef(bootstrap_counts(key, np.ones(len(key), int), 0), bootstrap_counts(key, np.ones(len(key), int), 1))[0, 1]) < 0.03
    mixed = np.where(np.arange(len(key)) % 2 == 0, 1, 9)
    turned = bootstrap_counts(key[::-1], mixed[::-1], 5)[::-1]
    assert (turned == bootstrap_counts(key, mixed, 5)).all()


def test_perceptron_of_counted_rows(spark):
    from mirrortab.plans.perceptron import fit_perceptron, loss_and_gradient

    rng = np.random.default_rng(1)
    x, y, n, w = rng.normal(size=(9, 2)), rng.integers(0, 3, 9), rng.integers(1, 5, 9), rng.normal(size=2 * 4 + 4 + 4 * 3 + 3)
    whole = loss_and_gradient(w, x, y, n.astype(float), 4, 3)
    again = loss_and_gradient(w, x.repeat(n, axis=0), y.repeat(n), np.ones(n.sum()), 4, 3)
    assert np.allclose(whole, again)
    for i in (0, 9, 15, 26):
        step = np.zeros(len(w)); step[i] = 1e-5
        slope = (loss_and_gradient(w + step, x, y, n, 4, 3)[0] - loss_and_gradient(w - step, x, y, n, 4, 3)[0]) / 2e-5
        assert whole[2 + i] == pytest.approx(slope, abs=1e-4)
    rows = [(Vectors.dense(a, b), float(a * b > 0), 5) for a in (-1.0, -0.5, 0.5, 1.0) for b in (-1.0, -0.5, 0.5, 1.0)]
    fitted = fit_perceptron(spark.createDataFrame(rows, ["scaled", "label", "n"]), 2, 2, "n", hidden=8)
    points, label = np.array([r[0].toArray() for r in rows]), np.array([int(r[1]) for r in rows])
    assert loss_and_gradient(fitted, points, label, np.ones(16), 8, 2)[0] / 16 < 0.05
