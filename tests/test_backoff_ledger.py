"""Back-off in the sampler, the linear-time discrepancy, privacy spent, teachers without a choice."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.functions.random import gaussian01, gaussian_number, uniform01, uniform_number
from mirrortab.operators import core, mmd, privacy, profile, sampling
from mirrortab.plans import backoff, kdb, utility

EDGES = [("y", "a"), ("y", "b"), ("y", "c"), ("a", "c"), ("b", "c")]


def _thin(spark):
    # c follows from y and a; of a and b only the pairs on the diagonal occur
    rows = [(i % 8, i % 8, f"{i % 2}-{i % 8}", f"y{i % 2}") for i in range(400)]
    return spark.createDataFrame(rows, "a int, b int, c string, y string")


@pytest.mark.parametrize("shuffled", [False, True])
def test_unseen_configurations_follow_the_shorter_context(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    model = kdb.fit_kdb(_thin(spark), "y", edges=EDGES)
    rows = kdb.sample_kdb(model, spark, 600, backoff=True).collect()
    assert len(rows) == 600 == len({r["id"] for r in rows})
    unseen = [r for r in rows if r["a"] != r["b"]]
    assert len(unseen) > 300
    assert all(r["c"] == f"{r['y'][1]}-{r['a']}" for r in rows)
    if not shuffled:
        uniform = kdb.sample_kdb(model, spark, 600).where("a <> b AND c <> concat(substring(y, 2, 1), '-', a)")
        assert uniform.count() > 100


def test_longest_prefix_of_every_configuration(spark):
    model = kdb.fit_kdb(_thin(spark), "y", edges=EDGES)
    contexts = backoff.fit_contexts(model.cpt.df)
    seen = {tuple(r["config"]) for r in model.cpt.df.where("feature = 'c'").select("config").distinct().collect()}
    cards = [2, 8, 8]
    given = [(y, a, b) for y in range(2) for a in range(8) for b in range(8)] + [(7, 0, 0)]
    rows = spark.createDataFrame([(i, list(c)) for i, c in enumerate(given)], "i int, config array<int>")
    found = {r["i"]: tuple(r["config"]) for r in backoff.longest_seen(rows, contexts, "c", "config", cards).collect()}
    prefixes = {s[:k] for s in seen for k in range(4)}
    for i, c in enumerate(given[:-1]):
        assert found[i] == next(c[:k] for k in (3, 2, 1, 0) if c[:k] in prefixes)
    assert len(found) == len(given)


def test_counts_of_a_prefix_are_sums(spark):
    model = kdb.fit_kdb(_thin(spark), "y", edges=EDGES)
    table = backoff.fit_contexts(model.cpt.df).table.df.where("feature = 'c'")
    totals = [r["n"] for r in table.groupBy(F.size("config").alias("l")).agg(F.sum("n").alias("n")).collect()]
    assert totals == [400] * 4


def test_exact_conditions_refuse_back_off(spark):
    model = kdb.fit_kdb(_thin(spark), "y", edges=EDGES)
    contexts = backoff.fit_contexts(model.cpt.df)
    with pytest.raises(ValueError):
        kdb.sample_codes(model, spark, 5, fixed={"a": 0}, contexts=contexts)
    assert {r["y"] for r in kdb.sample_codes(model, spark, 5, fixed={"y": 1}, contexts=contexts).collect()} == {1}


def test_numbers_on_the_spot_equal_the_columns(spark):
    row = spark.range(20).select("id", uniform01(7, "id", "s").alias("u"), gaussian01(7, "id", "s").alias("g")).collect()
    for r in row:
        assert uniform_number(7, r["id"], "s") == r["u"]
        assert gaussian_number(7, r["id"], "s") == pytest.approx(r["g"], abs=1e-12)


def test_linear_time_discrepancy_is_within_its_bound(spark):
    rng = np.random.default_rng(5)
    frame = lambda a: spark.createDataFrame([([float(v) for v in r],) for r in a], "v array<double>")
    x, y = rng.normal(size=(300, 4)), rng.normal(loc=0.8, size=(200, 4))
    exact = mmd.mmd_rbf(frame(x), frame(y), "v", 2.0).first()["mmd"]
    got = mmd.mmd_fourier(frame(x), frame(y), "v", 2.0, features=2048).first()
    assert abs(got["mmd"] - exact) <= got["bound"] and abs(got["mmd"] - exact) <= 4 * got["std_error"]
    w, b = mmd._waves(4, 2048, 2.0, 42)
    gap = np.cos(x @ w.T + b).mean(0) - np.cos(y @ w.T + b).mean(0)
    assert got["mmd"] == pytest.approx((2 * gap**2).mean(), abs=1e-8)
    again = mmd.mmd_fourier(frame(x).repartition(7), frame(y).repartition(3), "v", 2.0, features=2048).first()
    assert again["mmd"] == pytest.approx(got["mmd"], abs=1e-8)
    assert mmd.mmd_fourier(frame(x), frame(x), "v").first()["mmd"] == 0.0


def test_linear_time_discrepancy_of_odd_input(spark):
    frame = lambda r: spark.createDataFrame([(v,) for v in r], "v array<double>")
    some = frame([[0.0, 1.0], None, [2.0, 0.5]])
    assert mmd.mmd_fourier(some, frame([[0.0, 1.0], [2.0, 0.5]]), "v").first()["mmd"] == 0.0
    assert mmd.mmd_fourier(some, frame([]), "v").first()["mmd"] == pytest.approx(
        mmd.mmd_rbf(some.where("v IS NOT NULL"), frame([]), "v").first()["mmd"], abs=0.3
    )
    assert mmd.mmd_fourier(frame([]), frame([]), "v").first()["mmd"] == 0.0
    with pytest.raises(ValueError):
        mmd.mmd_fourier(some, frame([[1.0]]), "v")


def test_spent_is_the_best_order(spark):
    rows = [("a", 4.0), ("a", 9.0), ("b", 20.0), ("b", 20.0), ("c", None), ("c", 5.0)]
    spent = {r["g"]: r for r in privacy.privacy_spent(spark.createDataFrame(rows, "g string, sigma double"), ["g"]).collect()}
    for g, sigmas in {"a": [4.0, 9.0], "b": [20.0, 20.0]}.items():
        rho = sum(1 / (2 * s * s) for s in sigmas)
        orders = 1 + np.geomspace(1e-3, 1e5, 200_000)
        assert spent[g]["epsilon"] == pytest.approx((orders * rho + math.log(1e5) / (orders - 1)).min(), rel=1e-6)
        best = spent[g]["best_order"]
        assert best * rho + math.log(1e5) / (best - 1) == pytest.approx(spent[g]["epsilon"])
        assert spent[g]["n_released"] == 2
    assert spent["c"]["epsilon"] == math.inf  # a record was released without noise
    none = privacy.privacy_spent(spark.createDataFrame([], "sigma double")).first()
    assert (none["n_released"], none["rho"], none["best_order"], none["epsilon"]) == (0, 0.0, None, 0.0)


@pytest.mark.parametrize("releases", [1, 10, 5_000])
def test_noise_for_a_budget(releases):
    sigma = privacy.sigma_for(2.0, 1e-5, releases)
    assert privacy.renyi_epsilon(releases / (2 * sigma * sigma), 1e-5) == pytest.approx(2.0)
    assert privacy.affordable_releases(2.0, 1e-5, sigma) == releases


def test_renyi_composition_beats_the_sum(spark):
    sigma = privacy.gaussian_sigma(1.0, 1e-5)
    assert privacy.renyi_epsilon(100 / (2 * sigma * sigma), 1e-5) < privacy.composed_epsilon(1.0, 100) / 5


def test_teachers_of_one_class_vote_it(spark):
    rows = spark.createDataFrame([(i, float(i), 1) for i in range(12)], "id int, x double, y int")
    public = spark.createDataFrame([(i, float(i)) for i in range(5)], "record int, x double")
    out = utility.teacher_ensemble(rows, public, ["x"], "y", ["id"], teachers=3, epsilon=1e6, noise_seed=1).collect()
    assert [(r["votes"], r["label"]) for r in out] == [(3, 1)] * 5
    with pytest.raises(ValueError):
        utility.teacher_ensemble(rows.where("id < 0"), public, ["x"], "y", ["id"], teachers=3)


def test_every_target_is_judged(spark):
    rows = spark.createDataFrame([(i % 2, i % 3, float(i)) for i in range(30)], "a int, b int, x double")
    judged = profile.check_compatibility(
        profile.dataset_profile(rows, "a"), profile.infer_task(rows, ["a", "b"]), {"two": {"max_classes": 2}}
    )
    assert sorted((r["target"], r["ok"]) for r in judged.collect()) == [("a", True), ("b", False)]
