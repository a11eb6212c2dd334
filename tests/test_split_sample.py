from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import core, sampling, split


def _classes(spark, counts):
    rows = [(i, str(c)) for i, c in enumerate(c for c, n in enumerate(counts) for _ in range(n))]
    return spark.createDataFrame(rows, "id int, y string")


@pytest.mark.parametrize("counts, expected", [
    ((384, 69, 1210, 65), (77, 14, 242, 13)),
    ((4320, 4266, 2, 4044, 328), (864, 853, 0, 809, 66)),
    ((15, 15), (3, 3)),
])
def test_split_counts_by_largest_remainder(spark, counts, expected):
    df = _classes(spark, counts)
    out = split.stratified_split(df, "y", ["id"])
    got = Counter((r["y"], r["split"]) for r in out.collect())
    assert tuple(got[str(c), "test"] for c in range(len(counts))) == expected
    assert sum(got.values()) == sum(counts)


def test_split_is_the_same_under_any_partitioning(spark):
    df = _classes(spark, (100, 300))
    tests = [
        {r["id"] for r in split.stratified_split(df.repartition(n), "y", ["id"]).where("split = 'test'").collect()} for n in (1, 4, 17)
    ]
    assert tests[0] == tests[1] == tests[2] and len(tests[0]) == 80
    other = {r["id"] for r in split.stratified_split(df, "y", ["id"], seed=7).where("split = 'test'").collect()}
    assert other != tests[0]


def test_class_of_one_row_turns_stratification_off(spark):
    out = split.stratified_split(_classes(spark, (30, 1)), "y", ["id"])
    assert out.where("split = 'test'").count() == 7 and out.count() == 31
    counts = split.split_counts(_classes(spark, (30, 1)), "y").collect()
    assert [r["n_test"] for r in counts] == [None, None]


def test_empty_table_splits(spark):
    assert split.stratified_split(_classes(spark, (2,)).limit(0), "y", ["id"]).count() == 0


def test_folds_cover_everything_evenly(spark):
    out = split.stratified_kfold(_classes(spark, (23, 4, 2)), "y", ["id"], 5)
    got = Counter((r["y"], r["fold"]) for r in out.collect())
    assert sum(got.values()) == 29
    for y, n in (("0", 23), ("1", 4), ("2", 2)):
        sizes = [got[y, f] for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_disjoint_parts(spark):
    out = split.partition_disjoint(spark.range(103), ["id"], 10)
    assert sorted(Counter(r["part"] for r in out.collect()).items()) == [(i, 10) for i in range(9)] + [(9, 13)]
    few = split.partition_disjoint(spark.range(3), ["id"], 10)
    assert {r["part"] for r in few.collect()} == {9}


def test_exact_sample_sizes(spark):
    df = spark.range(1000)
    assert split.sample_rows(df, ["id"], n=123).count() == 123
    assert split.sample_rows(df, ["id"], fraction=0.1).distinct().count() == 100
    assert split.sample_rows(df, ["id"], n=0).count() == 0
    assert split.sample_rows(df, ["id"], n=5000).count() == 1000
    with pytest.raises(ValueError):
        split.sample_rows(df, ["id"])


def test_copies_get_their_own_identity(spark, monkeypatch):
    monkeypatch.setattr(split, "COPY_BLOCK", 7)
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, None)] * 3 + [(3, "c")], "x int, y string")
    keyed = split.with_row_identity(df)
    assert keyed.count() == 54 and keyed.select("row_key").distinct().count() == 54
    assert Counter(map(tuple, keyed.select("x", "y").collect())) == Counter(map(tuple, df.collect()))
    out = split.stratified_split(keyed, "x", ["row_key"], 0.5)
    assert out.where("split = 'test'").count() == 27


@pytest.mark.parametrize("broadcast", [True, False])
def test_draws_follow_the_weights(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", 4.0)], "value string, weight double")
    got = Counter(r["value"] for r in sampling.sample_categorical(spark.range(4000), weights, stream="t").collect())
    assert set(got) == {"a", "b", "d"} and sum(got.values()) == 4000
    assert got["d"] / 4000 == pytest.approx(0.5, abs=0.03) and got["a"] / 4000 == pytest.approx(0.125, abs=0.03)


def test_draws_are_the_same_on_both_paths(spark, monkeypatch):
    numbers = spark.range(3000).select((F.col("id") % 700).cast("double").alias("x"))
    draw = lambda: sorted(map(tuple, sampling.sample_continuous(spark.range(500), numbers, "x").collect()))
    small = draw()
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(core, "WINDOW_ROWS", 50)
    assert draw() == small and all(v.endswith(".00000") for _, v in small)


def test_conditions_come_from_the_picked_column(spark):
    p = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "u", 0.9), ("b", "v", 0.1)], "column string, value string, p double")
    got = Counter((r["column"], r["value"]) for r in sampling.sample_conditions(spark.range(2000), p, ["a", "b"]).collect())
    assert sum(got.values()) == 2000 and set(got) == {("a", "x"), ("a", "y"), ("b", "u"), ("b", "v")}
    assert got["b", "u"] == pytest.approx(900, abs=90)


def test_start_prompts_by_distribution(spark):
    ids, numbers = spark.range(50), spark.createDataFrame([(1.5,), (2.5,)], "x double")
    one = sampling.start_prompts(ids, "c", {"p": 0.2, "q": 0.8}, ["c", "x"])
    assert {r["prompt"] for r in one.collect()} <= {"c is p,", "c is q,"}
    two = sampling.start_prompts(ids, "x", numbers, ["c", "x"])
    assert {r["prompt"] for r in two.collect()} == {"x is 1.50000,", "x is 2.50000,"}
    three = sampling.start_prompts(ids, None, None, ["c", "x"])
    assert {r["prompt"] for r in three.collect()} == {"c is ", "x is "}
    with pytest.raises(ValueError):
        sampling.start_prompts(ids, "c", None, ["c"])
    with pytest.raises(ValueError):
        sampling.start_prompts(ids, None, {"p": 1.0}, ["c"])


def test_resampling_gives_exactly_n(spark):
    df = core.fit_table(spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "id int, w double"))
    out = [r["id"] for r in sampling.resample_by_weight(df, 60, "w", ["id"]).collect()]
    assert len(out) == 60 and all(i % 4 for i in out)
    share = np.mean([i % 4 == 3 for i in out])
    assert share == pytest.approx(0.5, abs=0.05)
