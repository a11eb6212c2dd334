import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import core, repair, rowtext, sampling
from mirrortab.plans import impute as imp
from mirrortab.plans import kdb, marginal


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = rng.choice(["no", "yes"], n, p=[0.65, 0.35])
    a = np.where(y == "yes", rng.integers(0, 2, n), rng.integers(1, 4, n))
    b = [f"b{v}" for v in (a + rng.integers(0, 2, n)) % 3]
    c = [f"c{v}" for v in (a * 2 + (y == "yes") + rng.integers(0, 2, n)) % 4]
    rows = [(int(p), q, r, s) for p, q, r, s in zip(a, b, c, y)]
    return spark.createDataFrame(rows, "a int, b string, c string, y string"), rows


@pytest.fixture(scope="module")
def model(table):
    return kdb.fit_kdb(table[0], "y", 2)


def test_probability_tables_sum_to_one(model):
    sums = model.cpt.df.groupBy("feature", "config").agg(F.sum("p").alias("s"), F.max("hi").alias("top"), F.min("lo").alias("low")).collect()
    assert all(r["s"] == pytest.approx(1.0) and r["top"] == 1.0 and r["low"] == 0.0 for r in sums)


def test_samples_have_seen_values_and_near_frequencies(spark, table, model):
    df, rows = table
    synth = kdb.sample_kdb(model, spark, 3000)
    got = synth.collect()
    assert len(got) == 3000 and synth.columns == ["id", "a", "b", "c", "y"]
    for i, c in enumerate(df.columns):
        real, fake = Counter(r[i] for r in rows), Counter(r[c] for r in got)
        assert set(fake) <= set(real)
        for v, n in real.items():
            assert fake[v] / 3000 == pytest.approx(n / len(rows), abs=0.04)
    real, fake = Counter((r[0], r[3]) for r in rows), Counter((r["a"], r["y"]) for r in got)
    for v, n in real.items():
        assert fake[v] / 3000 == pytest.approx(n / len(rows), abs=0.04)


def test_fit_and_sample_do_not_depend_on_partitioning(spark, table, model):
    df, _ = table
    expected = sorted(map(tuple, kdb.sample_kdb(model, spark, 200).collect()))
    for n in (1, 4, 17):
        again = kdb.fit_kdb(df.repartition(n), "y", 2)
        assert again.parents == model.parents and again.order == model.order
        assert sorted(map(tuple, kdb.sample_kdb(again, spark, 200).collect())) == expected


def test_sampling_is_the_same_without_broadcast(spark, model, monkeypatch):
    expected = sorted(map(tuple, kdb.sample_kdb(model, spark, 300).collect()))
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, kdb.sample_kdb(model, spark, 300).collect())) == expected


def test_lineage_cuts_do_not_change_samples(spark, model, monkeypatch):
    expected = sorted(map(tuple, kdb.sample_kdb(model, spark, 100).collect()))
    monkeypatch.setattr(kdb, "CHECKPOINT_EVERY", 1)
    assert sorted(map(tuple, kdb.sample_kdb(model, spark, 100).collect())) == expected


def test_unseen_configuration_draws_uniformly(spark):
    # y -> p, y -> q independent; r's parents p, q: the pair (1, 1) never occurs in training
    rows = [(0, 0, 0, 0)] * 40 + [(1, 0, 1, 0)] * 40 + [(0, 1, 2, 0)] * 40
    df = spark.createDataFrame(rows, "p int, q int, r int, y int")
    fitted = kdb.fit_kdb(df, "y", edges=[("y", "p"), ("y", "q"), ("y", "r"), ("p", "r"), ("q", "r")])
    got = Counter(r["r"] for r in kdb.sample_kdb(fitted, spark, 6000).where("p = 1 and q = 1").collect())
    assert set(got) == {0, 1, 2}
    assert max(got.values()) / sum(got.values()) < 0.45


def test_model_survives_a_round_trip(spark, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    again = kdb.load_kdb(spark, path)
    assert again.features == model.features and again.order == model.order and again.parents == model.parents
    assert sorted(map(tuple, kdb.sample_kdb(again, spark, 150).collect())) == sorted(map(tuple, kdb.sample_kdb(model, spark, 150).collect()))


def test_conditional_samples(spark, table, model):
    _, rows = table
    fixed = kdb.sample_conditional(model, spark, 500, {"y": "yes"}).collect()
    assert len(fixed) == 500 and {r["y"] for r in fixed} == {"yes"}
    given = kdb.sample_conditional(model, spark, 2000, {"a": 1}).collect()
    assert len(given) == 2000 and {r["a"] for r in given} == {1}
    part = [r for r in rows if r[0] == 1]
    share = sum(r[3] == "yes" for r in part) / len(part)
    assert sum(r["y"] == "yes" for r in given) / 2000 == pytest.approx(share, abs=0.05)
    with pytest.raises(ValueError):
        kdb.sample_conditional(model, spark, 10, {"a": 99})


def _log_p(model_rows, parents, label, row, column):
    """log P(column | parents) from counts over the training rows; rows are dicts."""
    names = [] if column == label else [label, *parents[column]]
    if row[column] is None or any(row[n] is None for n in names):
        return 0.0
    same = [r for r in model_rows if all(r[n] == row[n] for n in names)]
    hits = sum(r[column] == row[column] for r in same)
    return math.log(hits / len(same)) if hits else math.log(1e-12)


def test_imputation_equals_brute_force(spark, table, model):
    df, rows = table
    names = df.columns
    train = [dict(zip(names, r)) for r in rows]
    rng = np.random.default_rng(8)
    holes = []
    for i, r in enumerate(train[:80]):
        row = {c: (None if rng.random() < 0.35 else v) for c, v in r.items()}
        holes.append((i, *[row[c] for c in names]))
    holes.append((999, None, None, None, None))
    got = {r["k"]: r for r in imp.impute(model, spark.createDataFrame(holes, "k int, a int, b string, c string, y string"), "k").collect()}
    assert len(got) == len(holes)
    values = {c: sorted({r[c] for r in train}) for c in names}
    for k, *cells in holes:
        row = dict(zip(names, cells))
        for column in ["y", *model.order]:
            if row[column] is not None:
                continue
            children = [c for c in model.order if column == "y" or column in model.parents[c]]
            best = None
            for v in values[column]:
                trial = {**row, column: v}
                score = round(sum(_log_p(train, model.parents, "y", trial, c) for c in [column, *children]), 9)
                if best is None or score > best[0]:
                    best = (score, v)
            row[column] = best[1]
        assert {c: got[k][c] for c in names} == row


def test_drawn_imputation_follows_the_distribution(spark, table, model):
    _, rows = table
    holes = spark.range(3000).select(
        F.col("id").alias("k"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("string").alias("b"),
        F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("y"),
    )
    got = imp.impute(model, holes, "k", seed=1).collect()
    assert sum(r["y"] == "yes" for r in got) / 3000 == pytest.approx(sum(r[3] == "yes" for r in rows) / len(rows), abs=0.03)
    fake, real = Counter(r["a"] for r in got), Counter(r[0] for r in rows)
    assert all(fake[v] / 3000 == pytest.approx(n / len(rows), abs=0.04) for v, n in real.items())


def test_partial_rows_are_completed(spark, model):
    prompts = spark.createDataFrame([(1, "a is 2, y is yes"), (2, "b is b1, nonsense"), (3, "y is")], "k int, t string")
    got = {r["k"]: r for r in imp.complete_partial_rows(model, prompts, "t", "k").collect()}
    assert got[1]["a"] == 2 and got[1]["y"] == "yes" and got[2]["b"] == "b1"
    assert all(v is not None for r in got.values() for v in r)


def test_imputation_without_broadcast(spark, model, monkeypatch):
    holes = spark.createDataFrame([(1, None, "b1", None, "yes"), (2, 1, None, None, None)], "k int, a int, b string, c string, y string")
    expected = sorted(map(tuple, imp.impute(model, holes, "k").collect()))
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, imp.impute(model, holes, "k").collect())) == expected


def test_marginal_generator(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x), int(k), t) for x, k, t in zip(rng.gamma(2, 3, 900), rng.integers(0, 3, 900), rng.choice(["u", "v"], 900, p=[0.8, 0.2]))]
    df = spark.createDataFrame(rows, "x double, k int, t string")
    fitted = marginal.fit_marginal(df)
    assert fitted.categorical == ("k", "t")
    synth = marginal.sample_marginal(fitted, spark, 2000).collect()
    assert len(synth) == 2000 and {r["t"] for r in synth} == {"u", "v"} and {r["k"] for r in synth} == {0, 1, 2}
    x = np.array([r["x"] for r in synth])
    real = np.array([r[0] for r in rows])
    assert real.min() <= x.min() and x.max() <= real.max()
    assert np.median(x) == pytest.approx(np.median(real), rel=0.15)


def test_repairs(spark):
    real = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "b", "q"), (4, "c", "q")], "id int, y string, f string")
    synth = spark.createDataFrame([(10, "a", "p"), (11, "a", "p")], "id int, y string, f string")
    assert {r["label"] for r in repair.missing_classes(real, synth, "y").collect()} == {"b", "c"}
    fixed = sorted(map(tuple, repair.class_coverage_repair(real, synth, "y", "id").collect()))
    assert fixed == [(2, "b", "p"), (4, "c", "q"), (10, "a", "p"), (11, "a", "p")]
    covered = sorted(map(tuple, repair.category_coverage_repair(real, synth, ["y", "f"], "id").collect()))
    assert covered == [(10, "a", "p"), (11, "a", "p"), (11, "a", "q"), (11, "b", "p"), (11, "c", "p")]
    guarded = sorted(map(tuple, repair.guard_two_classes(real, synth, "y", "id").collect()))
    assert guarded == [(10, "b", "p"), (11, "a", "p")]
    assert repair.guard_two_classes(real, real, "y", "id").count() == 4


def test_unseen_test_labels_are_dropped(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    test = spark.createDataFrame([(1, "a"), (2, "z"), (3, "b"), (4, None)], "id int, y string")
    got = sorted(map(tuple, repair.filter_unseen_labels(train, test, "y").select("id", "label_code").collect()))
    assert got == [(1, 0), (3, 1)]


def test_rows_to_text_and_back(spark):
    rows = [(1, "x", 2.50, None), (2, None, 10.0, 7), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, f double, n int")
    plain = rowtext.row_to_text(df, ["s", "f", "n"], "k", seed=None, float_precision=2)
    assert [r["text"] for r in plain.orderBy("k").collect()] == ["s is x, f is 2.5", "f is 10, n is 7", ""]
    shuffled = rowtext.row_to_text(df, ["s", "f", "n"], "k", seed=5)
    back = rowtext.text_to_row(shuffled.select("k", "text"), "text", ["s", "f", "n"]).orderBy("k").collect()
    assert [(r["s"], r["f"], r["n"]) for r in back] == [("x", "2.5", "placeholder"), ("placeholder", "10.0", "7"), ("placeholder",) * 3]


def test_parsing_rules(spark):
    texts = ["a is 1, a is 2", "a is , a is 3", "b is None", "c is 1, junk", "  a is x is y , b is 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = [(r["a"], r["b"]) for r in rowtext.text_to_row(df, "t", ["a", "b"]).orderBy("k").collect()]
    p = "placeholder"
    assert got == [("1", p), ("3", p), (p, None), (p, p), ("x", "2")]


def test_prompts_name_a_missing_column(spark):
    rows = [(1, "x", None, None), (2, None, None, None), (3, "x", 1.0, 2)]
    df = spark.createDataFrame(rows, "k int, s string, f double, n int")
    got = [r["prompt"] for r in rowtext.partial_row_prompt(df, ["s", "f", "n"], "k").orderBy("k").collect()]
    assert got[0] in ("s is x, f is", "s is x, n is")
    assert got[1] in ("s is", "f is", "n is")
    assert not got[2].endswith(" is") and got[2].endswith(", ")


def test_generated_values_are_cleaned(spark):
    raws = ["Private; more", "private!!", "12.75", "-3 years", "x" * 40, "the SELF-emp person", "  ?? "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "k int, r string")
    token = [r[0] for r in df.orderBy("k").select(rowtext.cut_generated_value(F.col("r"))).collect()]
    assert token == ["Private", "private", "12", "-3", "x" * 40, "the", ""]
    limited = df.where("k = 4").select(rowtext.cut_generated_value(F.col("r"), longest=30)).first()[0]
    assert limited == "x" * 30
    number = [r[0] for r in df.orderBy("k").select(rowtext.clean_generated_number(F.col("r"))).collect()]
    assert number[2:4] == ["12", "-3"] and number[0] == "Private"
    cats = spark.createDataFrame([("Private",), ("Priv",), ("Self",), (None,)], "c string")
    got = [r["value"] for r in rowtext.clean_generated_category(df, "r", cats).orderBy("k").collect()]
    assert got[:2] == ["Private", "Private"] and got[3] == "-3"
    inside = spark.createDataFrame([(1, "MyPrivateJob")], "k int, r string")
    assert rowtext.clean_generated_category(inside, "r", cats).first()["value"] == "Priv"
