import os

import pytest
from pyspark.sql import functions as F

from mirrortab.operators.divergence import label_distribution
from mirrortab.plans import run, utility
from mirrortab.sources import runs, tables
from mirrortab.streaming.drift import label_drift, window_label_counts


def _small(spark, n=30, classes=2):
    rows = [(i, i % 5, i % 3, i % classes) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, f0 bigint, f1 bigint, y bigint")


def test_path_segments_and_ids():
    assert runs.path_segment(" My Data -- Set! ") == "my-data-set"
    assert runs.path_segment("???") == "unnamed"
    assert len({runs.new_run_id("train") for _ in range(50)}) == 50


def test_registry(spark, tmp_path):
    registry = runs.DatasetRegistry(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 0), (2, 1)], "a bigint, y bigint")
    assert registry.get("Mini") is None
    entry = registry.register("Mini", df)
    assert {r["column"]: r["role"] for r in entry.collect()} == {"a": "feature", "y": "target"}
    assert {r["task"] for r in entry.collect()} == {"binary_classification"}
    with pytest.raises(ValueError, match="already registered"):
        registry.register("mini", df)
    assert sorted(map(str, registry.register_if_absent("MINI", df).collect())) == sorted(map(str, entry.collect()))
    with pytest.warns(UserWarning, match="other columns"):
        registry.register_if_absent("Mini", df.withColumnRenamed("a", "b"))
    drift = runs.schema_drift(runs.registry_entry(df, "mini"), runs.registry_entry(df.select("y", "a"), "mini", "y")).first()
    assert drift["drifted"] and drift["registered_columns"] == "a,y" and drift["fresh_columns"] == "y,a"
    _, checks = runs.register_dataset(registry, df, "mini", None, {"kdb": run.KdbSynthesizer.requirements, "n": {"min_classes": 3}})
    assert {r["model"]: r["ok"] for r in checks.collect()} == {"kdb": True, "n": False}


def test_run_in_memory(spark):
    report, generator = run.run_train_test(_small(spark, 60), "y", ["id"], "kdb", ["fidelity"])
    got = {(r["group"], r["metric"]): r["value"] for r in report.collect()}
    assert {("summary", "mean_jsd"), ("summary", "mean_kld_sym"), ("summary", "dcr_mean"), ("summary", "dcr_p5")} <= set(got)
    assert generator.model.rows == 48


def test_run_with_artifacts(spark, tmp_path):
    root = str(tmp_path / "store")
    seen = []

    def count_rows(train, test, synth, target, **options):
        seen.append((train.count(), test.count(), synth.count(), options))
        return spark.createDataFrame([("rows", "n", float(synth.count()))], "`group` string, metric string, value double")

    report, generator = run.run_train_test(
        _small(spark, 40, 4), "y", ["id"], run.KdbSynthesizer, {"count": count_rows}, options={"count": {"tag": 1}},
        dataset="Four Classes", root=root,
    )
    assert seen == [(32, 8, 32, {"tag": 1})]
    assert [tuple(r) for r in report.collect()] == [("count", "rows", "n", 32.0)]
    assert os.path.isdir(f"{root}/registry/datasets/dataset_key=four-classes")
    state = [d for d, _, _ in os.walk(f"{root}/models") if d.endswith("/state")]
    again = run.KdbSynthesizer().load(spark, state[0])
    assert again.sample(spark, 10).count() == 10
    split_dir = [d for d, _, _ in os.walk(f"{root}/splits/dataset=four-classes") if "/version=" in d][0]
    assert tables.read_split(spark, split_dir, "test").count() == 8
    reports = [f for d, _, fs in os.walk(f"{root}/reports") for f in fs if f.endswith(".csv")]
    assert reports


def test_run_with_a_given_split(spark):
    rows = _small(spark, 30)
    train, test = rows.where("id < 20"), rows.where("id >= 20")
    report, generator = run.run_train_test(train, "y", ["id"], "marginal", ["fidelity"], test=test)
    assert generator.model.rows == 20 and report.count() > 0
    with pytest.raises(ValueError, match="Column mismatch"):
        run.run_train_test(train, "y", ["id"], "marginal", test=test.withColumnRenamed("f0", "z"))


def test_unsuitable_dataset_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id bigint, f bigint, y double")
    with pytest.raises(ValueError, match="does not suit"):
        run.run_train_test(df, "y", ["id"], "kdb", dataset="numbers", root=str(tmp_path))


def test_reports_side_by_side(spark):
    a = spark.createDataFrame([("x", "jsd", 0.1), ("summary", "mean", 0.2)], "`group` string, metric string, value double")
    b = a.withColumn("value", F.col("value") * 2)
    got = {(r["group"], r["metric"]): (r["one"], r["two"]) for r in run.compare_models({"one": a, "two": b}).collect()}
    assert got == {("x", "jsd"): (0.1, 0.2), ("summary", "mean"): (0.2, 0.4)}


def _separable(spark, n, text=True):
    rows = [(float(i % 17), "u" if i % 2 else "v", float((i * 7) % 5), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "x double, c string, z double, y int")


def test_utility_of_a_separable_table(spark):
    df = _separable(spark, 120)
    report = utility.tstr_report(df, df, "y", ["LR", "RF"], trees=5, max_depth=4, max_iter=20)
    got = {(r["model"], r["metric"]): r["value"] for r in report.collect()}
    assert got["LR", "accuracy"] == 1.0 and got["RF", "auc"] == 1.0 and got["LR", "f1_weighted"] == 1.0
    one = utility.tstr_report(df.where("y = 1"), df, "y", ["LR"]).collect()
    assert [tuple(r) for r in one] == [("LR", "one synthetic class", None)]


def test_detection(spark):
    df = _separable(spark, 200)
    same = {r["metric"]: r["value"] for r in utility.detection_score(df, df, ["x", "c", "z"]).collect()}
    assert same["auc"] == pytest.approx(0.5, abs=0.01)
    far = {r["metric"]: r["value"] for r in utility.detection_score(df, df.withColumn("x", F.col("x") + 100), ["x", "c", "z"]).collect()}
    assert far["auc"] > 0.99 and far["loss"] > same["loss"]


def test_regression_utility(spark):
    df = spark.createDataFrame([(float(i), "p" if i % 2 else "q", 3.0 * i + (i % 2)) for i in range(80)], "x double, c string, y double")
    got = {(r["model"], r["metric"]): r["value"] for r in utility.utility_regression(df, df, "y", ["lr"]).collect()}
    assert got["lr", "r2"] > 0.999 and got["lr", "rmse"] < 0.1


def test_teachers_on_disjoint_parts(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    public = df.where("id < 50").select(F.col("id").alias("record"), "x")
    out = utility.teacher_ensemble(df, public, ["x"], "y", ["id"], teachers=2, epsilon=1e6, noise_seed=1).collect()
    assert len(out) == 50 and all(r["label"] == int(r["record"] % 10 > 4) for r in out)


def test_label_drift_of_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "b"), ("2024-01-02 03:00:00", "a"), ("2024-01-02 04:00:00", "a")]
    df = spark.createDataFrame(rows, "t string, label string").select(F.col("t").cast("timestamp").alias("ts"), "label")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = (
        window_label_counts(stream, "ts", "label").writeStream.outputMode("complete")
        .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(sink))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    reference = label_distribution(df, "label")
    got = {r["window_start"].day: (r["n"], r["tv"]) for r in label_drift(spark.read.parquet(sink), reference).collect()}
    assert got == {1: (2, 0.25), 2: (2, 0.25)}


def test_fitted_state_round_trips(spark, tmp_path):
    from mirrortab.operators import encode as enc
    from mirrortab.operators.discretize import discretize, fit_bins
    from mirrortab.operators.scalers import fit_moments
    from mirrortab.plans.marginal import fit_marginal, sample_marginal
    from mirrortab.sources import state

    df = spark.createDataFrame([(float(i), None if i == 3 else i % 4, "ab"[i % 2], 7) for i in range(60)], "x double, n int, t string, k int")
    dictionary = enc.fit_dictionary(df, ["t", "n"])
    state.save_dictionary(dictionary, f"{tmp_path}/d")
    again = state.load_dictionary(spark, f"{tmp_path}/d")
    assert again.sizes == dictionary.sizes and again.types == dictionary.types
    coded = lambda d: sorted(map(tuple, enc.encode(df, d, ["t", "n"]).collect()))
    assert coded(again) == coded(dictionary)
    bins = fit_bins(df, ["x", "n", "k"], 5)
    state.save_bins(spark, bins, f"{tmp_path}/b")
    loaded = state.load_bins(spark, f"{tmp_path}/b")
    assert loaded == bins and discretize(df, loaded).first() == discretize(df, bins).first()
    moments = fit_moments(df, ["x", "n"])
    state.save_moments(spark, moments, f"{tmp_path}/m")
    assert state.load_moments(spark, f"{tmp_path}/m") == moments
    model = fit_marginal(df.select("x", "t"))
    state.save_marginal(spark, model, f"{tmp_path}/g")
    rows = lambda m: sorted(map(tuple, sample_marginal(m, spark, 50).collect()))
    assert rows(state.load_marginal(spark, f"{tmp_path}/g")) == rows(model)


def test_stored_run_is_evaluated_again(spark, tmp_path):
    root = str(tmp_path / "store")
    first, _ = run.run_train_test(_small(spark, 40), "y", ["id"], "kdb", ["fidelity"], dataset="again", root=root)
    version = os.listdir(f"{root}/splits/dataset=again")[0].split("=")[1]
    run_id = os.listdir(f"{root}/models/dataset=again/version={version}/model=kdb")[0].split("=")[1]
    second = run.evaluate_run(spark, runs.RunPaths(root, "again", version), "kdb", run_id, "y", ["id"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_single_model_check_picks_the_task(spark):
    df = _separable(spark, 120)
    classes = {r["metric"]: r["value"] for r in utility.utility_check(df, df, "y").collect()}
    assert classes["accuracy"] == 1.0 and classes["f1_macro"] == 1.0
    chosen = utility.utility_check(df, df, "y", metrics=["recall_weighted"]).collect()
    assert [r["metric"] for r in chosen] == ["recall_weighted"]
    with pytest.raises(ValueError, match="unknown metrics"):
        utility.utility_check(df, df, "y", metrics=["log_loss"])
    numbers = spark.createDataFrame([(float(i), 2.0 * i) for i in range(60)], "x double, y double")
    assert {r["metric"]: r["value"] for r in utility.utility_check(numbers, numbers, "y").collect()}["r2"] > 0.999


def test_cross_validation_averages_over_the_folds(spark):
    seen = []

    def sizes(train, held_out, synth, target):
        seen.append((train.count(), held_out.count(), synth.count()))
        return train.sparkSession.createDataFrame([("all", "held_out", float(seen[-1][1]))], "`group` string, metric string, value double")

    report = run.run_kfold(_small(spark, 41), "y", ["id"], "marginal", {"sizes": sizes}, k=3, n=7)
    rows = report.collect()
    assert sum(h for _, h, _ in seen) == 41 and all(t + h == 41 and s == 7 for t, h, s in seen)
    held = [h for _, h, _ in seen]
    assert [(r["evaluation"], r["metric"], r["folds"]) for r in rows] == [("sizes", "held_out", 3)]
    assert rows[0]["mean"] == pytest.approx(sum(held) / 3, abs=1e-5)
    with pytest.raises(ValueError):
        run.run_kfold(_small(spark, 10), "y", ["id"], k=1)


def test_marginal_generator_takes_conditions_and_is_checked(spark):
    df = _separable(spark, 120)
    generator = run.MarginalSynthesizer().fit(df, "y")
    label = df.first()["y"]
    fixed = generator.sample(spark, 50, conditional={"y": label})
    free = generator.sample(spark, 50)
    others = [c for c in df.columns if c != "y"]
    assert {r["y"] for r in fixed.collect()} == {label}
    assert sorted(map(tuple, fixed.select(others).collect())) == sorted(map(tuple, free.select(others).collect()))
    with pytest.raises(ValueError):
        generator.sample(spark, 5, conditional={"y": "never seen"})
    assert {r["metric"] for r in generator.evaluate(spark, df).collect()} >= {"accuracy", "f1_macro"}
