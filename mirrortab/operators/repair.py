"""Make a synthetic table cover the real one's classes and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.operators.core import fit_table, lookup, sized_broadcast, unpivot, with_scalars
from mirrortab.operators.encode import fit_dictionary


def missing_classes(real: DataFrame, synth: DataFrame, label: str) -> DataFrame:
    """Classes of the real table that the synthetic one lacks."""
    have = synth.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n")).select("label")
    want = real.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, "label", "left_anti")


def class_coverage_repair(real: DataFrame, synth: DataFrame, label: str, key: str) -> DataFrame:
    """Append, for every class the synthetic table lacks, its first real row by key.

    The first row per class is a combined aggregate, not a sort of the class.
    """
    absent = fit_table(missing_classes(real, synth, label).select(F.col("label").alias(label)))
    row = F.struct(*[F.col(f"`{c}`") for c in synth.columns])
    rows = real.join(sized_broadcast(absent.df, absent), label, "left_semi")
    firsts = rows.groupBy(label).agg(F.min_by(row, F.col(key)).alias("_row")).select("_row.*")
    return synth.unionByName(firsts)


def guard_two_classes(real: DataFrame, synth: DataFrame, label: str, key: str) -> DataFrame:
    """If the synthetic table has a single class but the real one more, relabel its first row."""
    state = synth.agg(F.min(label).alias("a"), F.max(label).alias("b"), F.min(key).alias("first")).first()
    if state["a"] is None or state["a"] != state["b"]:
        return synth
    other = real.where(F.col(label) != F.lit(state["a"])).agg(F.min(label).alias("c")).first()["c"]
    if other is None:
        return synth
    return synth.withColumn(
        label, F.when(F.col(key) == F.lit(state["first"]), F.lit(other)).otherwise(F.col(label))
    )


def category_coverage_repair(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], key: str
) -> DataFrame:
    """Append, for every category of every column the synthetic table lacks, a copy of its
    last row (highest key) with that cell replaced."""
    seen = lambda df: unpivot(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    absent = seen(real).join(seen(synth).drop("_n"), ["column", "value"], "left_anti").drop("_n")
    row = F.struct(*[F.col(f"`{c}`") for c in synth.columns])
    template = synth.agg(F.max_by(row, F.col(key)).alias("_row"))
    patched = with_scalars(absent, template).select(
        *[
            (
                F.when(F.col("column") == c, F.col("value").cast(synth.schema[c].dataType)).otherwise(F.col(f"_row.`{c}`"))
                if c in cols
                else F.col(f"_row.`{c}`")
            ).alias(c)
            for c in synth.columns
        ]
    )
    return synth.unionByName(patched)


def filter_unseen_labels(train: DataFrame, test: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Test rows whose label occurs in train, with the train's label code added."""
    known = fit_dictionary(train.where(F.col(label).isNotNull()).select(label), [label])
    keyed = test.where(F.col(label).isNotNull()).withColumn("_v", F.col(label).cast("string"))
    return lookup(keyed, known.column(label, "_v", out), ["_v"], "inner").drop("_v")
