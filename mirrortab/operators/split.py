"""Splits, folds, parts and samples without replacement.

All of them rank rows by a hash of seed and key.  The ranks themselves are never computed
for every row: ``rank_cutoffs`` finds the hash at the few ranks that matter, and each row
compares its own hash with its group's cutoffs.  The wide rows are scanned once, unshuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import row_hash
from mirrortab.operators.core import (
    checkpointed, fit_table, hash_histogram, lookup, rank_cutoffs, running_total, with_scalars,
)

COPY_BLOCK = 100_000
INLINE_CUTS = 16


def with_row_identity(df: DataFrame, key: str = "row_key") -> DataFrame:
    """Give rows without a key a stable one: content hash and copy number.

    Copies are counted first (combined map-side) and then laid out again in two steps, so
    a row with a third of all copies is written by many tasks.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    text = F.to_json(F.struct(*cols))
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPY_BLOCK))).alias("_block"),
    ).withColumn("_content", F.md5(text)).repartition("_content", "_block")
    first = F.col("_block") * COPY_BLOCK
    last = F.least(first + COPY_BLOCK - 1, F.col("_n") - 1)
    return blocks.select(*cols, "_content", F.explode(F.sequence(first, last)).alias("_copy")).select(
        *cols, F.concat_ws("-", "_content", F.col("_copy").cast("string")).alias(key)
    )


def split_counts(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """``(label, n, n_test)``: test rows per class by largest remainder.

    The total is ``ceil(rows * test_size)``.  If a class has a single row the split is not
    stratified and ``n_test`` is null.
    """
    return _quota(df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n")), test_size)


def _quota(counts: DataFrame, test_size: float) -> DataFrame:
    summed = counts.agg(F.sum("n").alias("_total"), F.min("n").alias("_least"))
    target = F.ceil(F.col("_total") * F.lit(test_size))
    share = F.col("n") * target / F.col("_total")
    rows = with_scalars(counts, summed).select(
        "label", "n", "_least", target.alias("_target"),
        F.floor(share).alias("_base"), F.round(share - F.floor(share), 9).alias("_rest"),
    )
    ranked = running_total(
        rows.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_all", F.lit(0)),
        ["_all"], [F.desc("_rest"), F.col("label")], "_one", "_pos",
    )
    base = ranked.agg(F.sum("_base").alias("_given"))
    return with_scalars(ranked, base).select(
        "label", "n",
        F.when(
            F.col("_least") >= 2,
            F.col("_base") + (F.col("_pos") <= F.col("_target") - F.col("_given")).cast("bigint"),
        ).cast("bigint").alias("n_test"),
    )


class _Ranked:
    """Rows with their hash and group, and the hash histogram that also gives the sizes."""

    def __init__(self, df: DataFrame, group: Column, seed: int, key: Sequence[str]) -> None:
        self.columns = df.columns
        # never null, so that rows without a label are a group of their own in every join
        group = F.struct(group.isNotNull().alias("known"), group.alias("value"))
        self.rows = df.withColumn("_group", group).withColumn("_hash", row_hash(seed, *key))
        self.narrow = self.rows.select("_group", "_hash")
        self.histogram = hash_histogram(self.narrow, ["_group"], "_hash")

    def sizes(self) -> DataFrame:
        return self.histogram.groupBy(F.col("_group").alias("label")).agg(F.sum("_n").alias("n"))

    def total(self) -> int:
        return int(self.histogram.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])

    def parts(self, targets: DataFrame, cuts_per_group: int, out: str) -> DataFrame:
        """Add ``out``: how many of the cutoffs at ``(_group, cut, rank)`` lie below the row.

        A cutoff at rank 0 lies below every row of its group.  A few cutoffs are compared
        one by one, inside generated code.
        """
        cuts = rank_cutoffs(self.narrow, ["_group"], "_hash", targets, self.histogram)
        at_zero = targets.where(F.col("rank") < 1).select("_group", "cut", F.lit("").alias("cut_hash"))
        packed = fit_table(
            cuts.unionByName(at_zero).groupBy("_group").agg(F.sort_array(F.collect_list("cut_hash")).alias("_cuts"))
        )
        joined = lookup(self.rows, packed, ["_group"])
        if cuts_per_group <= INLINE_CUTS:
            below = F.lit(0)
            for i in range(cuts_per_group):
                above = F.col("_hash") > F.get("_cuts", F.lit(i))
                below = below + F.coalesce(above.cast("int"), F.lit(0))
        else:
            none = F.array().cast("array<string>")
            below = F.size(F.filter(F.coalesce(F.col("_cuts"), none), lambda c: c < F.col("_hash")))
        return joined.select(*[F.col(f"`{c}`") for c in self.columns], below.alias(out))


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Add ``split`` = ``train`` or ``test``; falls back to an unstratified split when a
    class has a single row.  Rows without a label are a class.  ``key`` must be unique (see ``with_row_identity``)."""
    ranked = _Ranked(df, F.col(f"`{label}`"), seed, key)
    quota = checkpointed(_quota(ranked.sizes(), test_size))
    total = quota.agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    if total["n"] is None:
        return df.withColumn(out, F.lit("train"))
    if total["least"] >= 2:
        targets = quota.select(F.col("label").alias("_group"), F.lit(0).alias("cut"), F.col("n_test").alias("rank"))
    else:
        ranked = _Ranked(df, F.lit(0), seed, key)
        targets = _targets(df, [math.ceil(total["n"] * test_size)])
    parted = ranked.parts(targets, 1, "_part")
    return parted.withColumn(out, F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def _targets(df: DataFrame, ranks: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [((True, 0), i, r) for i, r in enumerate(ranks)], "_group struct<known:boolean,value:int>, cut int, rank bigint"
    )


def stratified_kfold(
    df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add ``fold`` in ``0..k-1``; within each class the folds differ by at most one row."""
    if k < 2:
        return df.withColumn(out, F.lit(0))
    ranked = _Ranked(df, F.col(f"`{label}`"), seed, key)
    targets = ranked.sizes().select(
        F.col("label").alias("_group"), "n", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cut")
    ).select("_group", "cut", F.floor(F.col("n") * F.col("cut") / k).alias("rank"))
    return ranked.parts(targets, k - 1, out)


def partition_disjoint(df: DataFrame, key: Sequence[str], parts: int, seed: int = 42, out: str = "part") -> DataFrame:
    """Shuffle rows into disjoint parts of equal size; the last takes the remainder."""
    ranked = _Ranked(df, F.lit(0), seed, key)
    size = ranked.total() // parts
    return ranked.parts(_targets(df, [i * size for i in range(1, parts)]), parts - 1, out)


def sample_rows(
    df: DataFrame, key: Sequence[str], n: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Exactly ``n`` rows, or ``int(rows * fraction)``, without replacement."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    ranked = _Ranked(df, F.lit(0), seed, key)
    total = ranked.total()
    n = int(total * fraction) if n is None else min(n, total)
    parted = ranked.parts(_targets(df, [n]), 1, "_part")
    return parted.where(F.col("_part") == 0).drop("_part")
