"""A run reads its tables once for their distinct rows, and draws by hex digits; results are those of all rows."""

import math

import pytest
from pyspark.sql import functions as F

from mirrortab.functions import uniform01
from mirrortab.functions.random import uniform_digits
from mirrortab.operators import clean, core, divergence, nearest, sampling, scalers
from mirrortab.plans import kdb, run


def _tables(spark):
    odd = lambda i, n: F.when(F.col("id") % n != i, F.col("id") % n)
    real = spark.range(900).select(
        odd(2, 5).cast("double").alias("a"), F.lit(0.1).alias("_n"), odd(1, 3).cast("string").alias("side_c"),
        (F.col("id") % 2).cast("string").alias("y"),
    )
    synth = real.where("id % 4 > 0").select((F.col("a") + 0.25).alias("a"), "_n", "side_c", "y")
    return real, synth


def _watched(df):
    """``df`` and a count of its rows that were read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(passed, df.schema), seen


def test_evaluation_reads_each_table_once(spark):
    real, synth = _tables(spark)
    expected = {(r["group"], r["metric"]): r["value"] for r in divergence.fidelity_report(real, synth, "y").collect()}
    (real_watched, real_seen), (synth_watched, synth_seen) = _watched(real), _watched(synth)
    report = run.evaluate_fidelity(real_watched, real, synth_watched, "y").collect()
    assert (real_seen.value, synth_seen.value) == (900, 675)
    got = {(r["group"], r["metric"]): r["value"] for r in report}
    near = {("summary", r["metric"]): r["value"] for r in nearest.dcr(real, synth, ["a", "_n", "side_c"]).collect()}
    assert got == {**expected, **near} and got["summary", "dcr_mean"] > 0


def test_network_fit_reads_rows_once(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("a"), ((F.col("id") % 4 - 1.5) * 0.0).alias("z"),
        F.when(F.col("id") % 3 > 0, "x").alias("c"), (F.col("id") % 2).alias("y"),
    )
    watched, seen = _watched(df)
    model = kdb.fit_kdb(watched, "y")
    assert seen.value == 600 and model.rows == 600
    assert model.cards == {"a": 7, "z": 2, "c": 2, "y": 2}  # both zeros, as their texts differ
    known = {(r["column"], r["value"]): (r["code"], r["n"]) for r in model.dictionary.df.collect()}
    assert known["a", "Missing"] == (6, 86) and known["c", "Missing"] == (0, 200) and known["z", "-0.0"][1] == 300
    assert model.dictionary.types == {"a": "bigint", "z": "double", "c": "string", "y": "bigint"}


def test_counted_moments_and_medians(spark):
    real, _ = _tables(spark)
    counted = real.groupBy("a", F.col("_n").alias("k"), "y").agg(F.count(F.lit(1)).alias("w"))
    a, k = (scalers.fit_moments(counted, ["a", "k"], "w")[c] for c in ("a", "k"))
    plain = scalers.fit_moments(real, ["a"])["a"]
    assert (a.lo, a.hi) == (plain.lo, plain.hi)
    assert math.isclose(a.mean, plain.mean, rel_tol=1e-12) and math.isclose(a.std, plain.std, rel_tol=1e-12)
    assert k.std == 0.0  # whatever the rounded mean of 900 times 0.1 is
    none = scalers.fit_moments(counted.withColumn("a", F.lit(None).cast("double")), ["a"], "w")["a"]
    assert none.mean is None and none.std is None
    assert clean.medians(counted, ["a"], "w") == clean.medians(real, ["a"])


@pytest.mark.parametrize("values", [1, 3, 40, 700])
def test_digits_find_the_interval_of_the_number(spark, values):
    cells = spark.range(3 * values).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") % 11).alias("w"))
    table = core.fit_table(sampling.intervals(cells.where("w > 0 or v < 3").withColumn("w", F.col("w") + 1), ["g"], ["v"], "w").drop("w"))
    draws = spark.range(4000).select(
        "id", (F.col("id") % 4).alias("c"), uniform01(3, "id", "s").alias("_u"), uniform_digits(3, "id", "s").alias("_d")
    )
    edges = spark.createDataFrame([(-1, 0, 0.0, "0" * 32), (-2, 1, 0.5, "8" + "0" * 31), (-3, 2, (16**13 - 1) / 16**13, "f" * 32)], draws.schema)
    draws = draws.unionByName(edges)
    depth = sampling.digits_depth(table, 3)
    assert depth == {1: 0, 3: 0, 40: 1, 700: 2}[values]
    table = core.FitTable(table.df.withColumnRenamed("g", "c"), table.rows, table.bytes)
    fast = sampling.digits_lookup(draws, table, "c", "_d", depth)
    slow = sampling.interval_lookup(draws, table, ["c"], "_u", 3)
    got = {r.id: r.v for r in fast.collect()}
    assert got == {r.id: r.v for r in slow.collect()} and len(got) == 4003
    assert all((v is None) == (i % 4 == 3) for i, v in got.items() if i >= 0)


def test_sample_is_the_same_from_numbers(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 3).alias("y")).where("a + b > 2")
    model = kdb.fit_kdb(df, "y")
    rows = lambda fixed=None: sorted(map(tuple, kdb.sample_codes(model, spark, 800, 5, fixed).collect()))
    digits, given = rows(), rows({"y": 1})
    monkeypatch.setattr(kdb, "NUMBERED", 0)
    assert digits == rows() and given == rows({"y": 1})


def test_stored_keeps_names_and_odd_types(spark):
    df = spark.range(5).select(F.col("id").alias("a b,(c)"), F.lit(None).alias("nothing"))
    assert sorted(r[0] for r in core.stored(df).collect()) == list(range(5)) and core.stored(df).columns == df.columns
    some = df.drop("nothing")
    assert core.stored(some).columns == some.columns and core.stored(some.where("false")).count() == 0
