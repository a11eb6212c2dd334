"""Nulls, NaN, unseen values and awkward column names."""

import math

import pytest
from pyspark.sql import functions as F

from mirrortab.functions import first_number  # noqa: F401
from mirrortab.functions.text import plain_float
from mirrortab.operators import clean, core, discretize, encode, nearest, rowtext, sampling, split
from mirrortab.plans import impute, kdb, utility


def test_null_labels_are_split_like_a_class(spark):
    rows = spark.range(1000).withColumn("y", F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")))
    got = {(r["y"], r["split"]): r["count"] for r in split.stratified_split(rows, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert sum(n for (_, s), n in got.items() if s == "test") == math.ceil(1000 * 0.2)
    assert got[None, "test"] == 50
    folds = split.stratified_kfold(rows, "y", ["id"], 5).where("y is null").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [50] * 5


def test_null_and_nan_codes_decode_to_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    dictionary = encode.fit_dictionary(df, ["x"])
    coded = encode.encode(spark.createDataFrame([("zz",), ("b",)], "x string"), dictionary, ["x"])
    assert {r.x for r in encode.decode(coded, dictionary, ["x"]).collect()} == {None, "b"}
    odd = spark.createDataFrame([(None,), (float("nan"),), (7.0,)], "c double")
    assert [r[0] for r in odd.select(clean.round_clip(F.col("c"), 5)).collect()] == [None, None, 4]


def test_nan_is_a_missing_number(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (9.0,)], "x double")
    assert discretize.fit_bins(df, ["x"], 2).edges["x"] == [1.0, 5.0, 9.0]
    assert sorted(r.x for r in clean.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 9.0]
    assert clean.null_tokens_to_null(df).where("x is null").count() == 1


def test_nearest_record_with_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "b")], "x double, e double, c string")
    real, synth = nearest.mixed_points(df, df, ["x", "e", "c"])
    assert all(len(r.nums) == 1 for r in real.collect())
    del synth


def test_imputation_keeps_given_cells(spark):
    train = spark.createDataFrame([(str(i % 3), str(i % 2)) for i in range(60)], "f string, g string")
    model = kdb.fit_kdb(train, "g", k=1)
    df = spark.createDataFrame([(1, "99", "0"), (2, None, "1"), (3, "1", "7"), (4, None, None)], "row int, f string, g string")
    got = {r.row: (r.f, r.g) for r in impute.impute(model, df, "row").collect()}
    assert got[1] == ("99", "0") and got[3] == ("1", "7")
    assert got[2][0] in ("0", "1", "2") and got[2][1] == "1" and None not in got[4]


def test_network_on_awkward_names(spark):
    rows = [(str(i % 3), str(i % 2), str(i % 4), str(i % 5), str(i % 2)) for i in range(120)]
    train = spark.createDataFrame(rows, "value string, id string, n string, config string, lo string")
    model = kdb.fit_kdb(train, "lo", k=2)
    sample = kdb.sample_kdb(model, spark, 200)
    assert model.row_key == "row_id" and sorted(sample.columns) == sorted(["row_id", *train.columns])
    assert sample.where("id is null or value is null").count() == 0
    assert kdb.sample_conditional(model, spark, 50, {"value": "1"}).where("value = '1'").count() == 50


def test_lookup_spreads_rows_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    fact = spark.range(20_000).withColumn("k", F.when(F.col("id") % 10 == 0, F.col("id") % 7))
    table = core.fit_table(spark.createDataFrame([(i, f"v{i}") for i in range(7)], "k bigint, v string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = core.lookup(fact, table, ["k"])
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.count() == 20_000 and found.where("v is not null").count() == 2_000
        assert max(sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_copies_of_a_heavy_candidate(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_BLOCK", 10)
    table = core.fit_table(spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "id bigint, w double"))
    got = sampling.resample_by_weight(table, 100, "w", ["id"]).collect()
    assert sorted((r.id, r.copy) for r in got) == [(0, i) for i in range(1, 26)] + [(2, i) for i in range(1, 76)]


def test_text_forms(spark):
    df = spark.createDataFrame([(12345678.0,), (5e-4,), (1.5,), (1e20,), (None,)], "x double")
    assert [r[0] for r in df.select(plain_float(F.col("x"))).collect()] == ["12345678.0", "0.0005", "1.5", "1.0E20", None]
    raw = spark.createDataFrame([("\n 5",), ("\tblue",), ("x" * 50,)], "t string")
    assert [r[0] for r in raw.select(rowtext.cut_generated_value(F.col("t"))).collect()] == ["5", "blue", "x" * 50]


def test_unknown_models_are_refused(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    with pytest.raises(ValueError):
        utility.utility_check(df, df, "y", model="svm")
