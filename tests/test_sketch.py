"""Profiles that merge, against exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.operators import sketch


def _rows(spark, n, start=0):
    wide = spark.range(start, start + n).select(
        "id", (F.col("id") % 33).cast("double").alias("few"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("gaps"), F.lit(None).cast("double").alias("void"),
    )
    return wide


def test_merged_parts_equal_the_whole(spark):
    parts = sketch.fit_sketches(_rows(spark, 3_000)).unionByName(sketch.fit_sketches(_rows(spark, 5_000, 2_000)))
    got = {r["column"]: r for r in sketch.estimates(sketch.merge_sketches(parts)).collect()}
    assert {c: (r["n_rows"], r["n_values"]) for c, r in got.items()} == {
        "id": (8_000, 8_000), "few": (8_000, 8_000), "text": (8_000, 8_000), "gaps": (8_000, 6_400), "void": (8_000, 0)
    }
    assert (got["few"]["n_unique"], got["text"]["n_unique"], got["void"]["n_unique"]) == (33, 7, 0)
    assert got["id"]["n_unique"] == pytest.approx(7_000, rel=6 * sketch.DISTINCT_ERROR)
    assert (got["gaps"]["lo"], got["gaps"]["hi"]) == (0.5, 3_499.5) and got["text"]["lo"] is None
    seen = np.concatenate([np.arange(3_000), np.arange(2_000, 7_000)])
    ranks = [(seen <= q).mean() for q in got["id"]["quantiles"]]
    assert ranks == pytest.approx([0.25, 0.5, 0.75], abs=0.03)
    assert got["void"]["quantiles"] is None and got["text"]["quantiles"] is None


def test_rules_equal_exact_counts_at_every_limit(spark):
    rows = _rows(spark, 4_000)
    merged = sketch.merge_sketches(sketch.fit_sketches(rows))
    for shift in (-1, 0, 1):
        limits = {"id": 4_000 + shift, "few": 33 + shift, "text": 7 + shift, "gaps": 10}
        out = {r["column"]: r for r in sketch.distinct_at_most(rows, merged, limits).collect()}
        assert {c: r["at_most"] for c, r in out.items()} == {"id": shift >= 0, "few": shift >= 0, "text": shift >= 0, "gaps": False}
        assert out["id"]["counted"] and not out["gaps"]["counted"]
    with pytest.raises(ValueError):
        sketch.distinct_at_most(rows, merged, {"nothing": 1})


def test_odd_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,), (2.0,)], "x double")
    row = sketch.estimates(sketch.fit_sketches(df)).first()
    assert (row["n_rows"], row["n_values"], row["n_unique"], row["lo"], row["hi"]) == (5, 4, 3, 0.0, 2.0)
    none = sketch.estimates(sketch.merge_sketches(sketch.fit_sketches(df.where("false")))).first()
    assert (none["n_rows"], none["n_values"], none["n_unique"], none["quantiles"]) == (0, 0, 0, None)


def test_plan_does_not_expand_rows(spark):
    plan = sketch.fit_sketches(_rows(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
