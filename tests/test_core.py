import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.functions import (
    clean_decoded_text, format_float, gaussian01, inverse_normal_cdf, normal_cdf, row_hash, slug, uniform01,
)
from mirrortab.operators import core


@pytest.fixture
def small_windows(monkeypatch):
    monkeypatch.setattr(core, "WINDOW_ROWS", 7)


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)


def _weights(spark):
    rows = [(g, v, (v * 7) % 5 + 1) for g in "abc" for v in range(40 if g == "a" else 5)]
    return spark.createDataFrame(rows, "g string, v int, n bigint"), rows


def _check_running(spark):
    df, rows = _weights(spark)
    got = {(r["g"], r["v"]): (r["cum"], r["total"]) for r in core.running_total(df, ["g"], ["v"], "n").collect()}
    assert len(got) == len(rows)
    for g, v, n in rows:
        mine = [(x, m) for h, x, m in rows if h == g]
        assert got[g, v] == (sum(m for x, m in mine if x <= v), sum(m for _, m in mine))


def test_running_total_in_one_window(spark):
    _check_running(spark)


def test_running_total_over_range_partitions(spark, small_windows):
    _check_running(spark)


def test_running_total_descending_over_range_partitions(spark, small_windows):
    df, rows = _weights(spark)
    run = core.running_total(df, ["g"], [F.desc("v")], "n")
    got = {(r["g"], r["v"]): r["cum"] for r in run.collect()}
    for g, v, _ in rows:
        assert got[g, v] == sum(m for h, x, m in rows if h == g and x >= v)


@pytest.mark.parametrize("windows", [None, 7])
def test_quantiles_equal_linear_interpolation(spark, monkeypatch, windows):
    if windows:
        monkeypatch.setattr(core, "WINDOW_ROWS", windows)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 101).astype(float), rng.normal(size=101)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    for probs in ([0.5], [0.05, 0.3, 0.77], [i / 10 for i in range(11)], [i / 99 for i in range(100)]):
        got = {(r["column"], r["i"]): r["value"] for r in core.exact_quantiles(df, ["a", "b"], probs).collect()}
        assert len(got) == 2 * len(probs)
        for i, p in enumerate(probs):
            assert got["a", i] == pytest.approx(np.quantile(a, p), abs=1e-12)
            assert got["b", i] == pytest.approx(np.quantile(b, p), abs=1e-12)


def test_quantiles_of_one_row_and_no_row(spark):
    one = spark.createDataFrame([(3.0,)], "a double")
    assert [r["value"] for r in core.exact_quantiles(one, ["a"], [0.1, 0.9]).orderBy("i").collect()] == [3.0, 3.0]
    assert core.exact_quantiles(one.limit(0), ["a"], [0.5]).count() == 0


def test_lookup_large_path_equals_broadcast(spark, monkeypatch):
    fact = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(-5)).otherwise(F.col("id") % 50).cast("int").alias("k")
    )
    dim = core.fit_table(spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v")))
    plain = sorted(map(tuple, core.lookup(fact, dim, ["k"]).select("id", "k", "v").collect()), key=str)
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(core, "HOT_ROWS", 100)
    for how in ("left", "inner"):
        salted = core.lookup(fact, dim, ["k"], how).select("id", "k", "v").collect()
        expected = [r for r in plain if how == "left" or r[2] is not None]
        assert sorted(map(tuple, salted), key=str) == expected


def test_lookup_spreads_heavy_and_missing_keys(spark, monkeypatch):
    fact = spark.range(0, 20000, 1, 8).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("k"))
    dim = core.fit_table(spark.range(3).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v")))
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(core, "HOT_ROWS", 50)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = core.lookup(fact, dim, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 7000  # of 5,000 on average in four partitions
        assert joined.where("k is null and v is not null or k is not null and v is distinct from 2 * k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_salts_follow_the_count_and_the_bound(spark, monkeypatch):
    fact = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("j"))
    monkeypatch.setattr(core, "HOT_ROWS", 100)
    k, j = core.heavy_keys(fact, [["k"], ["j"]])
    assert [r["_salts"] for r in k.collect()] == [9] and [r["_salts"] for r in j.collect()] == [5, 5]
    monkeypatch.setattr(core, "HOT_KEYS", 2)
    k, j = core.heavy_keys(fact, [["k"], ["j"]])
    assert [r["_salts"] for r in k.collect()] == [2] and j.count() == 0  # no key has over a half of the heavy rows


def test_chain_of_broadcasts_has_a_budget(spark, monkeypatch):
    monkeypatch.setattr(core, "CHAIN_BYTES", 100)
    tables = [core.FitTable(spark.range(1), 1, size) for size in (60, 30, 50, 20)]
    assert core.within_budget(tables) == [False, True, True, True]


@pytest.mark.parametrize("windows", [None, 1])
def test_rank_cutoffs_are_the_exact_hashes(spark, monkeypatch, windows):
    if windows:
        monkeypatch.setattr(core, "WINDOW_ROWS", windows)
        monkeypatch.setattr(core, "HASH_BUCKET_HEX_DIGITS", 1)
    rows = spark.range(2000).select(
        F.when(F.col("id") < 1500, "big").otherwise("small").alias("g"), row_hash(1, "id").alias("h")
    )
    targets = spark.createDataFrame([("big", 0, 1), ("big", 1, 700), ("big", 2, 1500), ("small", 0, 250)], "g string, cut int, rank bigint")
    got = {(r["g"], r["cut"]): r["cut_hash"] for r in core.rank_cutoffs(rows, ["g"], "h", targets).collect()}
    hashes = {g: sorted(r["h"] for r in rows.where(F.col("g") == g).collect()) for g in ("big", "small")}
    assert got == {("big", 0): hashes["big"][0], ("big", 1): hashes["big"][699], ("big", 2): hashes["big"][1499], ("small", 0): hashes["small"][249]}


def test_randomness_does_not_depend_on_partitioning(spark):
    draw = lambda n: {
        r["id"]: (r["u"], r["z"], r["h"])
        for r in spark.range(0, 500, 1, n).select(
            "id", uniform01(3, "id", "s").alias("u"), gaussian01(3, "id").alias("z"), row_hash(3, "id").alias("h")
        ).collect()
    }
    one, many = draw(1), draw(17)
    assert one == many
    u, z = np.array([v[0] for v in one.values()]), np.array([v[1] for v in one.values()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    assert abs(z.mean()) < 0.15 and abs(z.std() - 1) < 0.12


def test_normal_functions(spark):
    df = spark.createDataFrame([(0.001,), (0.01,), (0.3,), (0.5,), (0.9,), (0.999,)], "p double")
    for r in df.select("p", inverse_normal_cdf(F.col("p")).alias("z"), normal_cdf(inverse_normal_cdf(F.col("p"))).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=2e-7)
    known = spark.range(1).select(inverse_normal_cdf(F.lit(0.975)).alias("z")).first()["z"]
    assert known == pytest.approx(1.959963985, abs=1e-8)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Hello -- World! ", 1.50), ("***", 100.0), ("a\r\nb<|endoftext|>", 0.125)], "t string, x double")
    got = df.select(slug(F.col("t")).alias("s"), format_float(F.col("x"), 2).alias("f"), clean_decoded_text(F.col("t")).alias("c")).collect()
    assert [r["s"] for r in got] == ["hello-world", "unnamed", "a-b-endoftext"]
    assert [r["f"] for r in got] == ["1.5", "100", "0.13"]
    assert got[2]["c"] == "a b"
