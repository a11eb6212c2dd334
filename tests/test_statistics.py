import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import cpt as tables
from mirrortab.operators import divergence, information, metrics, mmd, nearest, privacy


def _jsd(p, q):
    p, q = np.asarray(p, float) + 1e-12, np.asarray(q, float) + 1e-12
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return 0.5 * float((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()), 0.5 * float((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum())


def test_identical_tables_have_no_divergence(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "f0 bigint, y bigint")
    report = {(r["group"], r["metric"]): r["value"] for r in divergence.fidelity_report(df, df, "y").collect()}
    assert set(report.values()) == {0.0}
    assert ("summary", "mean_jsd") in report and ("f0", "kld_sym") in report
    near = {r["metric"]: r["value"] for r in nearest.dcr(df, df, ["f0"]).collect()}
    assert near == {"dcr_mean": 0.0, "dcr_p5": 0.0}


def test_numeric_divergence_equals_histograms(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(0.5, 1.3, size=150)
    real = spark.createDataFrame([(float(v),) for v in a] + [(None,)], "x double")
    synth = spark.createDataFrame([(float(v),) for v in b], "x double")
    edges = np.histogram_bin_edges(np.concatenate([a, b]), bins=10)
    expected = _jsd(np.histogram(a, edges)[0] / 200, np.histogram(b, edges)[0] / 150)
    got = divergence.divergence_by_column(real, synth, ["x"], []).first()
    assert (got["jsd"], got["kld_sym"]) == pytest.approx(expected, abs=1e-8)


def test_few_distinct_values_give_few_bins(spark):
    for values, bins in (([0.0, 1.0], 3), ([0.0, 1.0, 2.0, 3.0], 4), ([float(i) for i in range(10)], 10), ([float(i) for i in range(30)], 10), ([5.0], 3)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        edges = divergence.shared_edges(df, df, ["x"])["x"]
        assert len(edges) - 1 == bins
        assert edges == pytest.approx(list(np.histogram_bin_edges(values, bins=bins)))


def test_categorical_divergence_with_nulls_and_one_sided_values(spark):
    real = spark.createDataFrame([("a",)] * 6 + [(None,)] * 4, "c string")
    synth = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "c string")
    expected = _jsd([0.6, 0.4, 0.0], [0.5, 0.0, 0.5])
    got = divergence.divergence_by_column(real, synth, [], ["c"]).first()
    assert (got["jsd"], got["kld_sym"]) == pytest.approx(expected, abs=1e-8)
    assert 0 <= got["jsd"] <= math.log(2)


def test_empty_side_has_no_divergence(spark):
    real = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    report = divergence.fidelity_report(real, real.limit(0), "y").where("`group` = 'summary'")
    assert all(r["value"] == 0.0 for r in report.collect())


def test_label_distance(spark):
    a = spark.createDataFrame([("p",)] * 3 + [("q",)], "y string")
    b = spark.createDataFrame([("p",)] * 1 + [("r",)], "y string")
    assert divergence.label_tv_distance(a, b, "y").first()["tv"] == 0.5


def _table(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a = (y + rng.integers(0, 2, n)) % 3
    b = (a + rng.integers(0, 2, n)) % 3
    c = rng.integers(0, 4, n)
    rows = [tuple(int(v) for v in r) for r in zip(a, b, c, y)]
    return spark.createDataFrame(rows, "a int, b int, c int, y int"), rows


def _mi(pairs):
    n = len(pairs)
    xy, x, y = Counter(pairs), Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    return sum(m / n * math.log2(m * n / (x[i] * y[j])) for (i, j), m in xy.items())


def test_mutual_information_equals_the_definition(spark):
    df, rows = _table(spark)
    counted = information.compact(df, ["a", "b", "c", "y"])
    got = {r["column"]: r["mi"] for r in information.mutual_information(counted, ["a", "b", "c"], "y").collect()}
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(_mi([(r[i], r[3]) for r in rows]), abs=1e-8)
    cmi = {(r["a"], r["b"]): r["cmi"] for r in information.conditional_mutual_information(counted, ["a", "b", "c"], "y").collect()}
    for (i, p), (j, q) in itertools.combinations(enumerate("abc"), 2):
        expected = 0.0
        for label in (0, 1):
            part = [(r[i], r[j]) for r in rows if r[3] == label]
            expected += len(part) / len(rows) * _mi(part)
        assert cmi[p, q] == pytest.approx(expected, abs=1e-8)


def test_structure_has_label_first_and_at_most_k_parents(spark):
    df, _ = _table(spark)
    counted = information.compact(df, ["a", "b", "c", "y"])
    ranking = information.mi_ranking(information.mutual_information(counted, ["a", "b", "c"], "y"))
    order = [r["column"] for r in ranking.orderBy("rank").collect()]
    cmi = information.conditional_mutual_information(counted, ["a", "b", "c"], "y")
    for k in (0, 1, 2):
        edges = [(r["parent"], r["child"]) for r in information.kdb_edges(ranking, cmi, "y", k).collect()]
        for at, child in enumerate(order):
            parents = [p for p, c in edges if c == child]
            assert parents.count("y") == 1 and len(parents) == 1 + min(k, at)
            assert all(p == "y" or order.index(p) < at for p in parents)


def test_conditional_tables(spark):
    df, rows = _table(spark)
    sums = tables.cpt(df, "b", ["a", "y"]).groupBy("a", "y").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    weighted = tables.cross_table(df.withColumn("w", F.lit(0.5)), ["a", "y"], "w")
    assert {(r["a"], r["y"]): r["w"] for r in weighted.collect()} == {k: v / 2 for k, v in Counter((r[0], r[3]) for r in rows).items()}


def test_backoff_and_uniform_fill(spark):
    rows = [(0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 0, 2)]
    df = spark.createDataFrame(rows, "p int, q int, x int")
    cards = {"p": 2, "q": 2, "x": 3}

    def smooth(x, parents):
        values = rows if not parents else [r for r in rows if all(r[i] == v for i, v in parents)]
        n, hit = len(values), sum(r[2] == x for r in values)
        if hit or not parents:
            return hit / n if n else 0.0
        return smooth(x, parents[:-1])

    got = {(r["p"], r["q"], r["x"]): r["p_"] for r in tables.cpt_backoff(df.withColumnRenamed("p", "pp"), "x", ["pp", "q"], {"pp": 2, "q": 2, "x": 3}).select(F.col("pp").alias("p"), "q", "x", F.col("p").alias("p_")).collect()}
    assert len(got) == 12
    for (p, q, x), value in got.items():
        assert value == pytest.approx(smooth(x, [(0, p), (1, q)]))
    fill = tables.cpt_uniform_fill(df.withColumnRenamed("p", "pp"), "x", ["pp", "q"], {"pp": 2, "q": 2, "x": 3}, noise=0.0)
    filled = {(r["pp"], r["q"], r["x"]): r["p"] for r in fill.collect()}
    assert [filled[1, 1, x] for x in range(3)] == pytest.approx([1 / 3] * 3)
    assert [filled[0, 0, x] for x in range(3)] == pytest.approx([2 / 3, 1 / 3, 0])


def test_classification_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    got = {r["metric"]: r["value"] for r in metrics.classification_metrics(df, "y", "p").collect()}
    f1 = {"a": 0.5, "b": 0.8, "c": 0.0}
    assert got["accuracy"] == pytest.approx(0.6)
    assert got["f1_macro"] == pytest.approx(sum(f1.values()) / 3, abs=1e-8)
    assert got["f1_weighted"] == pytest.approx((2 * 0.5 + 2 * 0.8) / 5, abs=1e-8)
    assert got["precision_weighted"] == pytest.approx((2 * 0.5 + 2 * 2 / 3) / 5, abs=1e-8)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 60), rng.integers(0, 9, 60))]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(expected, abs=1e-8)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_regression_metrics_and_imbalance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 4.0)], "y double, p double")
    got = {r["metric"]: r["value"] for r in metrics.regression_metrics(df, "y", "p").collect()}
    assert got == {"r2": pytest.approx(1 - 5 / 14, abs=1e-6), "mae": pytest.approx(1.0), "rmse": pytest.approx(math.sqrt(5 / 3), abs=1e-6)}
    labels = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert metrics.class_imbalance(labels, "y").first()["scale_pos_weight"] == 3.0
    assert metrics.class_imbalance(labels.where("y = 0"), "y").first()["scale_pos_weight"] == 1.0


def _brute_force(real, synth, numeric, categorical):
    r = np.array([[x[i] for i in numeric] for x in real], float)
    s = np.array([[x[i] for i in numeric] for x in synth], float)
    mean, std = r.mean(0), r.std(0)
    std[std == 0] = 1
    square = (((s - mean) / std)[:, None, :] - ((r - mean) / std)[None, :, :]) ** 2
    total = square.sum(2)
    for i in categorical:
        total += 2.0 * (np.array([x[i] for x in synth])[:, None] != np.array([x[i] for x in real])[None, :])
    return np.sqrt(total).min(1)


@pytest.mark.parametrize("block, pivots", [(4096, 4096), (5, 4096), (3, 2), (4096, 1)])
def test_closest_record_equals_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "MAX_PIVOTS", pivots)
    rng = np.random.default_rng(11)
    make = lambda n, shift: [
        (float(rng.normal(shift)), float(rng.integers(0, 5)), 7.0, "uvw"[rng.integers(0, 3)], "pq"[rng.integers(0, 2)]) for _ in range(n)
    ]
    real, synth = make(90, 0.0), make(60, 0.7)
    real += [real[0]] * 40  # a heavy copy
    synth += [synth[1]] * 30 + [real[3]] * 5
    schema = "a double, b double, k double, c string, d string"
    out = nearest.closest_record(spark.createDataFrame(real, schema), spark.createDataFrame(synth, schema), ["a", "b", "k", "c", "d"])
    got = sorted(d for r in out.collect() for d in [r["d"]] * r["n"])
    expected = sorted(_brute_force(real, synth, [0, 1, 2], [3, 4]))
    assert got == pytest.approx(expected, abs=1e-9)
    summary = {r["metric"]: r["value"] for r in nearest.dcr(spark.createDataFrame(real, schema), spark.createDataFrame(synth, schema), ["a", "b", "k", "c", "d"]).collect()}
    assert summary["dcr_mean"] == pytest.approx(np.mean(expected), abs=1e-6)
    assert summary["dcr_p5"] == pytest.approx(np.percentile(expected, 5), abs=1e-6)


def test_closest_record_with_only_categories_or_nulls(spark):
    real = spark.createDataFrame([("a", "x"), ("b", "y")], "c string, d string")
    synth = spark.createDataFrame([("a", "y"), ("z", "z"), ("b", "y")], "c string, d string")
    got = sorted(r["d"] for r in nearest.closest_record(real, synth, ["c", "d"]).collect())
    assert got == pytest.approx([0.0, math.sqrt(2), 2.0])
    gaps = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert [r["d"] for r in nearest.closest_record(gaps, gaps, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_discrepancy_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(mmd, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 4)), rng.normal(0.4, 1, size=(25, 4))
    x[5:12] = x[0]
    frame = lambda m: spark.createDataFrame([([float(v) for v in r],) for r in m], "v array<double>")

    def kernel(a, b):
        return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / 2 / 1.5**2)

    expected = kernel(x, x).mean() + kernel(y, y).mean() - 2 * kernel(x, y).mean()
    assert mmd.mmd_rbf(frame(x), frame(y), "v", 1.5).first()["mmd"] == pytest.approx(expected, abs=1e-8)
    assert mmd.mmd_linear(frame(x), frame(y), "v").first()["mmd"] == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum(), abs=1e-8)
    assert mmd.mmd_rbf(frame(x), frame(x), "v").first()["mmd"] == pytest.approx(0.0, abs=1e-8)


def test_noise_scale_and_votes(spark):
    assert privacy.gaussian_sigma(1.0, 1e-5) == pytest.approx(4.844805262605389, abs=1e-12)
    assert privacy.composed_epsilon(0.5, 10) == 5.0
    votes = spark.createDataFrame([(r, t, int(r % 2 == 0)) for r in range(400) for t in range(200)], "record int, teacher int, vote int")
    out = privacy.noisy_vote_aggregate(votes, 200, epsilon=1.0, delta=1e-5)
    rows = out.collect()
    assert all(r["label"] == int(r["record"] % 2 == 0) for r in rows)
    noise = np.array([r["noisy_votes"] - r["votes"] for r in rows])
    assert noise.std() == pytest.approx(4.84, rel=0.2)
    assert {r["record"]: r["noisy_votes"] for r in out.collect()} == {r["record"]: r["noisy_votes"] for r in rows}
    fresh = privacy.noisy_vote_aggregate(votes, 200)
    assert {r["record"]: r["noisy_votes"] for r in fresh.collect()} != {r["record"]: r["noisy_votes"] for r in rows}


def test_kernel_blocks_meet_without_a_shuffle_of_pairs(spark, monkeypatch):
    import numpy as np

    from mirrortab.operators import mmd

    monkeypatch.setattr(mmd, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mmd, "BLOCK_PARTS", 3)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(41, 3)) + 0.5
    table = lambda m: spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>")
    got = mmd.mmd_rbf(table(a), table(b), "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoop" not in plan and "hashpartitioning" not in plan
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / 2).mean()
    assert abs(got.first()["mmd"] - (k(a, a) + k(b, b) - 2 * k(a, b))) < 1e-8
