import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.operators import clean, core, profile, scalers
from mirrortab.operators import encode as enc
from mirrortab.operators.discretize import discretize, fit_bins
from mirrortab.plans.preprocess import encode_preprocess, preprocess_tabular
from mirrortab.sources import tables

NINE_ROWS = [(3, 3, 0, 0, a, b, 2) for a in (2, 1, 0) for b in (1, 2, 0)]
NINE_BINNED = [
    (3, 3, 0, 0, 9, 5, 0), (3, 3, 0, 0, 9, 9, 0), (3, 3, 0, 0, 9, 0, 0),
    (3, 3, 0, 0, 5, 5, 0), (3, 3, 0, 0, 5, 9, 0), (3, 3, 0, 0, 5, 0, 0),
    (3, 3, 0, 0, 0, 5, 0), (3, 3, 0, 0, 0, 9, 0), (3, 3, 0, 0, 0, 0, 0),
]


def test_uniform_preprocessing_of_the_nine_row_table(spark):
    schema = ", ".join(f"`{i}` bigint" for i in range(7))
    out = preprocess_tabular(spark.createDataFrame(NINE_ROWS, schema))
    assert sorted(map(tuple, out.collect())) == sorted(NINE_BINNED)
    assert out.columns == [str(i) for i in range(7)]


def test_csv_cleaning(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,y\n1,?,x,p\n?,?,NA,q\n3,?,z,p\n")
    df = tables.load_and_clean(spark, str(path))
    assert df.columns == ["a", "c", "y"]
    assert [tuple(r) for r in df.orderBy("y", "a").collect()] == [(1, "x", "p"), (3, "z", "p"), (None, None, "q")]


def test_encode_preprocess_puts_missing_first_and_fills_the_median(spark):
    rows = [(1.0, "b", "n"), (None, None, "y"), (3.0, " b ", "n"), (8.0, "missing", None), (2.0, "A", "y")]
    out = encode_preprocess(spark.createDataFrame(rows, "x double, c string, y string"))
    assert out.columns == ["0", "1", "2"]
    # target text sorts as Missing < n < y; the median of 1, 2, 3, 8 is 2.5, cut to 2 like all features
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1), (2, 0, 2), (2, 1, 2), (3, 2, 1), (8, 0, 0)]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "int"]


def test_encode_preprocess_cuts_features_towards_zero(spark):
    rows = [(-1.9, "a"), (1.9, "b"), (3e10, "a")]
    out = encode_preprocess(spark.createDataFrame(rows, "x double, y string"))
    assert sorted(r[0] for r in out.collect()) == [-1, 1, 30_000_000_000]


@pytest.mark.parametrize("strategy", ["uniform", "quantile", "kmeans"])
def test_bins(spark, strategy):
    values = [float(v) for v in (0, 1, 1, 1, 2, 5, 9, 10, 10, 10)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bins = fit_bins(df, ["x"], 4, strategy)
    edges = bins.edges["x"]
    codes = [r["x"] for r in discretize(df, bins).collect()]
    assert codes == list(np.searchsorted(edges[1:-1], values, side="right"))
    if strategy == "uniform":
        assert edges == [0.0, 2.5, 5.0, 7.5, 10]
    if strategy == "quantile":
        assert edges == pytest.approx(sorted(set(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]))))
    if strategy == "kmeans":
        assert len(edges) == 5 and edges[0] == 0 and edges[-1] == 10


def test_bins_of_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, 4, None), (2.0, None, None), (None, 4, None), (10.0, 4, None)], "x double, k int, e double")
    bins = fit_bins(df, ["x", "k", "e"], 3)
    assert bins.constant == ["k", "e"] and bins.fills["x"] == 2.0
    assert [tuple(r) for r in discretize(df, bins).collect()] == [(0, 4, None), (0, 4, None), (0, 4, None), (2, 4, None)]


def test_dictionary_sorts_text_by_bytes_and_numbers_by_value(spark):
    df = spark.createDataFrame([("b", 10), ("B", 9), (None, 100), ("a", None)], "t string, n int")
    d = enc.fit_dictionary(df, ["t", "n"])
    table = {(r["column"], r["value"]): r["code"] for r in d.df.collect()}
    assert table == {
        ("t", "B"): 0, ("t", "Missing"): 1, ("t", "a"): 2, ("t", "b"): 3,
        ("n", "9"): 0, ("n", "10"): 1, ("n", "100"): 2, ("n", "Missing"): 3,
    }
    back = enc.decode(enc.encode(df, d, ["t", "n"]), d, ["t", "n"])
    assert back.schema["n"].dataType == T.IntegerType()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_encoding_is_the_same_on_the_large_path(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 37).cast("string").alias("v"), "id")
    small = {r["id"]: r["v"] for r in enc.encode(df, enc.fit_dictionary(df, ["v"]), ["v"]).collect()}
    monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(core, "WINDOW_ROWS", 5)
    monkeypatch.setattr(core, "HOT_ROWS", 3)
    large = {r["id"]: r["v"] for r in enc.encode(df.repartition(5), enc.fit_dictionary(df, ["v"]), ["v"]).collect()}
    assert small == large


def test_unknown_values_and_codes_out_of_range(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "t string")
    d = enc.fit_dictionary(fit, ["t"])
    new = spark.createDataFrame([("b",), ("z",)], "t string")
    assert [r["t"] for r in enc.encode(new, d, ["t"], unknown=-1).collect()] == [1, -1]
    scores = spark.createDataFrame([(-3.0,), (0.5,), (0.6,), (9.0,)], "t double")
    assert [r["t"] for r in enc.decode(scores, d, ["t"]).collect()] == ["a", "a", "b", "b"]


def test_one_hot_and_argmax(spark):
    df = spark.createDataFrame([(0,), (2,), (-1,), (None,)], "c int")
    got = [r[0] for r in df.select(enc.one_hot(F.col("c"), 3)).collect()]
    assert got == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]
    scores = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0, 1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in scores.select(enc.argmax_code(F.col("s"))).collect()] == [1, 0]


def test_mixed_radix_id_is_unique(spark):
    df = spark.range(24).select((F.col("id") % 2).alias("a"), (F.floor(F.col("id") / 2) % 3).alias("b"), F.floor(F.col("id") / 6).alias("c"))
    ids = [r[0] for r in df.select(enc.high_order_id("c", ["a", "b"], {"a": 2, "b": 3, "c": 4})).collect()]
    assert sorted(ids) == list(range(24))


def test_scalers_and_inverses(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double")
    m = scalers.fit_moments(df, ["x", "k"])
    pairs = [
        (scalers.minmax_padded, scalers.minmax_padded_inverse), (scalers.minmax, scalers.minmax_inverse),
        (scalers.minmax_symmetric, scalers.minmax_symmetric_inverse), (scalers.standardize, scalers.standardize_inverse),
    ]
    for forward, back in pairs:
        for c in ("x", "k"):
            for r in df.select(F.col(c).alias("v"), back(forward(F.col(c), m[c]), m[c]).alias("b")).collect():
                assert r["b"] == pytest.approx(r["v"])
    assert [r[0] for r in df.select(scalers.minmax_symmetric(F.col("x"), m["x"])).collect()] == pytest.approx([-1, -1 / 3, 1])
    assert [r[0] for r in df.select(scalers.minmax_symmetric(F.col("k"), m["k"])).collect()] == [0, 0, 0]


def test_quantile_transform_handles_ties_and_inverts(spark):
    values = [1.0] * 5 + [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    grid = scalers.fit_quantile_grids(df, ["x"])["x"]
    u = [r[0] for r in df.select(scalers.to_uniform(F.col("x"), grid)).collect()]
    assert u[:5] == [0.0] * 5 and u[-1] == 1.0 and sorted(u) == u
    back = [r[0] for r in df.select(scalers.from_normal(scalers.to_normal(F.col("x"), grid), grid)).collect()]
    assert back == pytest.approx(values, abs=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_quantile_transform_equals_interpolation_from_both_sides(spark, seed):
    rng = np.random.default_rng(seed)
    q = np.sort(rng.integers(0, [5, 40, 10**6][seed], 57).astype(float))
    refs = np.linspace(0.0, 1.0, len(q))
    x = np.concatenate([q, rng.uniform(q[0] - 1, q[-1] + 1, 200)])
    expected = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    expected[x <= q[0]], expected[x >= q[-1]] = 0.0, 1.0
    grid = scalers.QuantileGrid(tuple(q))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None), (-2, float("nan"))], "i int, x double")
    u = scalers.to_uniform(F.col("x"), grid)
    out = {r[0]: r for r in df.select("i", u.alias("u"), scalers.from_uniform(u, grid).alias("b")).collect()}
    assert [out[-1]["u"], out[-1]["b"], out[-2]["u"]] == [None] * 3
    assert [out[i]["u"] for i in range(len(x))] == pytest.approx(list(expected), abs=1e-12)
    assert [out[i]["b"] for i in range(len(x))] == pytest.approx(list(np.interp(expected, refs, q)), rel=1e-9, abs=1e-9)


def test_generated_rows_are_filtered(spark):
    rows = [("1.5", "a"), ("x", "a"), (None, "b"), ("2", "placeholder"), (None, None), ("3", None)]
    df = spark.createDataFrame(rows, "n string, c string")
    assert sorted(map(tuple, clean.clean_generated(df, ["n"]).collect()), key=str) == [(1.5, "a"), (3.0, None), (None, "b")]
    assert [tuple(r) for r in clean.clean_generated(df, ["n"], drop_nan=True).collect()] == [(1.5, "a")]


def test_columns_are_aligned_by_name_or_count(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert clean.align_columns(df, ["a", "b"]).first() == (2, 1)
    assert clean.align_columns(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        clean.align_columns(df, ["x"])


def test_profile_and_tasks(spark):
    df = spark.createDataFrame([(i, float(i), "t%d" % i, i % 2) for i in range(40)], "i int, f double, s string, y int")
    got = {r["column"]: (r["kind"], r["n_unique"], r["role"]) for r in profile.dataset_profile(df).collect()}
    assert got == {"i": ("numeric", 40, "feature"), "f": ("numeric", 40, "feature"), "s": ("text", 40, "feature"), "y": ("numeric", 2, "target")}
    tasks = {r["target"]: (r["task"], r["n_classes"]) for r in profile.infer_task(df, ["i", "s", "y"]).collect()}
    assert tasks == {"i": ("regression", None), "s": ("multiclass_classification", 40), "y": ("binary_classification", 2)}


def test_presplit_check(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)] * 10, "x int, y int")
    assert profile.presplit_check(a, a) == 0
    with pytest.raises(ValueError, match="Column mismatch"):
        profile.presplit_check(a, a.withColumnRenamed("x", "z"))
    with pytest.raises(ValueError, match="Type mismatch"):
        profile.presplit_check(a, a.withColumn("x", F.col("x").cast("double")))
    with pytest.raises(ValueError, match="empty"):
        profile.presplit_check(a, a.limit(0))
    with pytest.warns(UserWarning):
        profile.presplit_check(a, a.where("y = 0"))


def test_role_blocks(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "p")], "n1 int, c1 string, n2 double, y string")
    numeric, categorical = tables.role_blocks(df, [0, 2], [1], [3], "binclass")
    assert numeric.columns == ["n1", "n2"] and categorical.columns == ["y", "c1"]
    numeric, categorical = tables.role_blocks(df, [0], [1, 3], [2], "regression")
    assert numeric.columns == ["n2", "n1"]
