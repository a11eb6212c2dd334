"""Mutual information, conditional mutual information and the k-dependence structure.

All measures come from sums of ``n * log2(n)`` over grouped counts, so there is no join or
window over the count tables; everything reads the compacted table of distinct code rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrortab.functions import metric, xlog2
from mirrortab.operators.core import checkpointed, unpivot


def compact(df: DataFrame, cols: Sequence[str], n: str = "_n") -> DataFrame:
    """Distinct rows of discrete columns with their count ``n``, checkpointed.

    One shuffle with map-side combining; every later statistic reads this table, which for
    discretised data is bounded by the combinations that occur, not by the rows.
    """
    named = [F.col(f"`{c}`") for c in cols]
    return checkpointed(df.groupBy(*named).agg(F.count(F.lit(1)).alias(n)))


def entropy_sums(counted: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(column, s_xy, s_x, s_y, total)`` with s = sum of n log2 n; one row per feature."""
    joint = checkpointed(
        unpivot(counted.withColumn("_y", F.col(f"`{label}`").cast("string")), features, ["_y", "_n"])
        .groupBy("column", "value", "_y")
        .agg(F.sum("_n").alias("n"))
    )
    by = lambda keys, name: (
        joint.groupBy("column", *keys).agg(F.sum("n").alias("n"))
        .groupBy("column").agg(F.sum(xlog2(F.col("n"))).alias(name))
    )
    xy = joint.groupBy("column").agg(F.sum(xlog2(F.col("n"))).alias("s_xy"), F.sum("n").alias("total"))
    return checkpointed(xy.join(by(["value"], "s_x"), "column").join(by(["_y"], "s_y"), "column"))


def mutual_information(
    counted: DataFrame, features: Sequence[str], label: str, sums: DataFrame | None = None
) -> DataFrame:
    """``(column, mi)`` in bits between each feature and the label."""
    sums = entropy_sums(counted, features, label) if sums is None else sums
    n = F.col("total")
    mi = F.log2(n) + (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / n
    return sums.select("column", metric(mi).alias("mi"))


def conditional_mutual_information(
    counted: DataFrame, features: Sequence[str], label: str, sums: DataFrame | None = None
) -> DataFrame:
    """``(a, b, cmi)`` in bits given the label, for every feature pair with a < b by name."""
    names = sorted(features)
    text = lambda c: F.col(f"`{c}`").cast("string")
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text(a).alias("va"), text(b).alias("vb"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    if not pairs:
        return counted.sparkSession.createDataFrame([], "a string, b string, cmi double")
    long = counted.select(text(label).alias("_y"), F.col("_n").alias("n"), F.explode(F.array(*pairs)).alias("_p")).select("_y", "n", "_p.*")
    triple = (
        long.groupBy("a", "b", "va", "vb", "_y").agg(F.sum("n").alias("n"))
        .groupBy("a", "b").agg(F.sum(xlog2(F.col("n"))).alias("s_xzy"))
    )
    sums = entropy_sums(counted, features, label) if sums is None else sums
    left = sums.select(F.col("column").alias("a"), F.col("s_xy").alias("s_ay"), "s_y", "total")
    right = sums.select(F.col("column").alias("b"), F.col("s_xy").alias("s_by"))
    joined = triple.join(F.broadcast(left), "a").join(F.broadcast(right), "b")
    cmi = (F.col("s_xzy") - F.col("s_ay") - F.col("s_by") + F.col("s_y")) / F.col("total")
    return joined.select("a", "b", metric(cmi).alias("cmi"))


def mi_ranking(mi: DataFrame) -> DataFrame:
    """``(column, mi, rank)``; ties go by name.  One row per feature."""
    order = Window.orderBy(F.desc("mi"), F.col("column"))
    return mi.withColumn("rank", F.row_number().over(order) - 1)


def kdb_edges(ranking: DataFrame, cmi: DataFrame, label: str, k: int) -> DataFrame:
    """``(parent, child, rank)``: the label first, then up to k earlier features by CMI.

    All inputs have one row per feature or feature pair.
    """
    both = cmi.select(F.col("a").alias("child"), F.col("b").alias("parent"), "cmi").unionByName(
        cmi.select(F.col("b").alias("child"), F.col("a").alias("parent"), "cmi")
    )
    child = ranking.select(F.col("column").alias("child"), F.col("rank").alias("_child_rank"))
    parent = ranking.select(F.col("column").alias("parent"), F.col("rank").alias("_parent_rank"))
    earlier = both.join(child, "child").join(parent, "parent").where(F.col("_parent_rank") < F.col("_child_rank"))
    best = Window.partitionBy("child").orderBy(F.desc("cmi"), F.col("parent"))
    chosen = earlier.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    roots = ranking.select(F.lit(label).alias("parent"), F.col("column").alias("child"), F.lit(0).alias("rank"))
    return roots.unionByName(chosen.select("parent", "child", "rank"))


def feature_parents(edges: Sequence[tuple[str, str]], label: str, features: Sequence[str]) -> dict[str, list[str]]:
    """Parents of each feature without the label, by name."""
    return {c: sorted(p for p, child in edges if child == c and p != label) for c in features}
