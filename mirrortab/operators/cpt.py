"""Cross tables and conditional probability tables in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.operators.core import fit_table, lookup, with_scalars


def cross_table(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Observed combinations with their count ``n`` or summed weight ``w``."""
    measure = F.sum(weight).alias("w") if weight else F.count(F.lit(1)).alias("n")
    return df.groupBy(*cols).agg(measure)


def cpt(df: DataFrame, child: str, parents: Sequence[str], n: str | None = None) -> DataFrame:
    """``(parents..., child, n, p)``: P(child | parents) for observed combinations."""
    parents = list(parents)
    count = F.sum(n) if n else F.count(F.lit(1))
    counts = df.groupBy(*parents, child).agg(count.alias("n"))
    if not parents:
        total = counts.agg(F.sum("n").alias("_total"))
        return with_scalars(counts, total).select(child, "n", (F.col("n") / F.col("_total")).alias("p"))
    totals = counts.groupBy(*parents).agg(F.sum("n").alias("_total"))
    return counts.join(totals, parents).select(*parents, child, "n", (F.col("n") / F.col("_total")).alias("p"))


def dense_cells(df: DataFrame, cards: Mapping[str, int]) -> DataFrame:
    """Every combination of codes ``0..card-1``: a numbered range split into digits.

    The dense form is as large as the product of the cardinalities; ``cpt`` and
    ``conditional_counts`` keep to the combinations that occur.
    """
    cells = prod(cards.values())
    rest = F.col("id")
    digits = {}
    for c, card in reversed(list(cards.items())):
        digits[c] = (rest % card).cast("int")
        rest = F.floor(rest / card)
    return df.sparkSession.range(cells).select(*[digits[c].alias(c) for c in cards])


def cpt_backoff(coded: DataFrame, child: str, parents: Sequence[str], cards: Mapping[str, int]) -> DataFrame:
    """Dense P(child | parents) where an empty cell takes the table without the last parent,
    and so on down to P(child)."""
    parents = list(parents)
    cells = dense_cells(coded, {c: cards[c] for c in [*parents, child]})
    p = F.lit(None).cast("double")
    names = []
    for depth in range(len(parents), -1, -1):
        keys = parents[:depth]
        level = fit_table(cpt(coded, child, keys).select(*keys, child, F.col("p").alias(f"_p{depth}")))
        cells = lookup(cells, level, [*keys, child], "left")
        names.append(f"_p{depth}")
    return cells.select(*parents, child, F.coalesce(*names, F.lit(0.0)).alias("p"))


def cpt_uniform_fill(
    coded: DataFrame, child: str, parents: Sequence[str], cards: Mapping[str, int], noise: float = 1e-5
) -> DataFrame:
    """Dense P(child | parents): uniform where the parents were never seen, ``noise`` added
    to the other empty cells."""
    parents = list(parents)
    cells = dense_cells(coded, {c: cards[c] for c in [*parents, child]})
    table = fit_table(cpt(coded, child, parents).select(*parents, child, "p"))
    seen = fit_table(table.df.select(*parents).distinct().withColumn("_seen", F.lit(True)))
    filled = lookup(lookup(cells, table, [*parents, child], "left"), seen, parents, "left")
    p = (
        F.when(F.col("_seen").isNull(), F.lit(1.0 / cards[child]))
        .when(F.col("p").isNull(), F.lit(float(noise)))
        .otherwise(F.col("p"))
    )
    return filled.select(*parents, child, p.alias("p"))


def observed_combinations(df: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """``(parents..., n_values)``: how many child values occur under each configuration."""
    return df.groupBy(*parents).agg(F.count_distinct(child).alias("n_values"))


def conditional_counts(
    counted: DataFrame, parents: Mapping[str, Sequence[str]], label: str | None
) -> DataFrame:
    """``(feature, config, value, n)`` for all features in one pass over the compacted table.

    ``config`` is the label code (when given) followed by the parents' codes.
    """
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.array(*[F.col(f"`{p}`").cast("int") for p in ([label] if label else []) + list(ps)]).alias("config"),
            F.col(f"`{c}`").cast("int").alias("value"),
        )
        for c, ps in parents.items()
    ]
    long = counted.select(F.col("_n").alias("n"), F.explode(F.array(*cells)).alias("_c")).select("n", "_c.*")
    return long.groupBy("feature", "config", "value").agg(F.sum("n").alias("n"))
