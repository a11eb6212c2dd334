"""Exact draws from the network under fixed values, by eliminating variables.

Fixed features say something about their ancestors only.  From the last ancestor to the first, the
tables that mention a column are multiplied and summed over its values: the sum is the message to
the columns before it, and the product is the column's table given these and all fixed values.  Rows
are then drawn forward from those tables, as without fixed values: nothing is weighed or drawn anew.

Tables are joined on the columns they share and live in storage; none is collected.  Their size is the
product of the cardinalities of the columns they mention, fixed ones left out.  As in sampling, a
configuration that was never seen is uniform; a fixed value that was not seen under a configuration
that was has probability ``NEVER_SEEN``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.operators.core import FitTable, fit_table
from mirrortab.operators.sampling import intervals

NEVER_SEEN = 1e-12  # probability of a cell that was not observed, for scoring


@dataclass(frozen=True)
class Conditional:
    """Intervals of a column's values for each configuration of ``scope``: ``_config, _value, lo, hi``."""

    scope: tuple[str, ...]
    table: FitTable
    configs: int


@dataclass(frozen=True)
class Factor:
    """A weight ``w`` for each combination of codes; the column of ``scope[i]`` is called ``x<number of the column>``."""

    scope: tuple[str, ...]
    df: DataFrame


def _grid(spark: SparkSession, cards: Mapping[str, int]) -> DataFrame:
    rest, digits = F.col("id"), []
    for name, card in cards.items():
        digits.append((rest % card).cast("int").alias(name))
        rest = F.floor(rest / card)
    return spark.range(prod(cards.values())).select(*digits)


def _ancestors(parents: Mapping[str, list[str]], target: str, fixed: Mapping[str, int]) -> set[str]:
    found: set[str] = set()
    waiting = [c for c in fixed]
    while waiting:
        c = waiting.pop()
        if c not in found:
            found.add(c)
            waiting += [] if c == target else [target, *parents[c]]
    return found


def conditionals(model, fixed: Mapping[str, int]) -> dict[str, Conditional]:
    """For every ancestor of a fixed column that is not fixed itself, its values given the columns before it."""
    spark = model.cpt.df.sparkSession
    order = [model.target, *model.order]
    name = {c: f"x{i}" for i, c in enumerate(order)}
    cards = model.cards
    asked = _ancestors(model.parents, model.target, fixed)

    def factor(column: str) -> Factor:
        """P(column | parents) over all codes, at the fixed values of the fixed columns."""
        parents = [] if column == model.target else [model.target, *model.parents[column]]
        scope = tuple(c for c in (*parents, column) if c not in fixed)
        code = lambda c: F.lit(int(fixed[c])) if c in fixed else F.col(name[c])
        grid = _grid(spark, {name[c]: cards[c] for c in scope}) if scope else spark.range(1)
        keyed = grid.withColumns({
            "_config": F.array(*[code(c).cast("int") for c in parents]).cast("array<int>"), "_value": code(column).cast("int")
        })
        cells = model.cpt.df.where(F.col("feature") == column)
        seen = cells.select(F.col("config").alias("_config"), F.lit(True).alias("_seen")).distinct()
        p = cells.select(F.col("config").alias("_config"), F.col("value").alias("_value"), "p")
        joined = keyed.join(p, ["_config", "_value"], "left").join(seen, ["_config"], "left")
        empty = F.when(F.col("_seen"), F.lit(NEVER_SEEN if column in fixed else 0.0)).otherwise(1.0 / max(cards[column], 1))
        return Factor(scope, joined.select(*[name[c] for c in scope], F.coalesce("p", empty).alias("w")))

    def product(a: Factor, b: Factor) -> Factor:
        shared = [name[c] for c in a.scope if c in b.scope]
        scope = tuple(dict.fromkeys((*a.scope, *b.scope)))
        other = b.df.withColumnRenamed("w", "_w")
        # factors without a common column are numbers: one row each
        joined = a.df.join(other, shared) if shared else a.df.join(F.broadcast(other))
        return Factor(scope, joined.select(*[name[c] for c in scope], (F.col("w") * F.col("_w")).alias("w")))

    factors = [factor(c) for c in order if c in asked]
    out: dict[str, Conditional] = {}
    for column in reversed([c for c in order if c in asked and c not in fixed]):
        mine = [f for f in factors if column in f.scope]
        whole = mine[0]
        for f in mine[1:]:
            whole = product(whole, f)
        before = tuple(sorted((c for c in whole.scope if c != column), key=order.index))
        table = fit_table(whole.df)
        factors = [f for f in factors if column not in f.scope]
        if before:
            factors.append(Factor(before, table.df.groupBy(*[name[c] for c in before]).agg(F.sum("w").alias("w"))))
        config = F.array(*[F.col(name[c]) for c in before]).cast("array<int>")
        cells = fit_table(table.df.select(config.alias("_config"), F.col(name[column]).alias("_value"), "w"))
        shares = fit_table(intervals(cells, ["_config"], ["_value"], "w").select("_config", "_value", "lo", "hi"))
        out[column] = Conditional(before, shares, prod(cards[c] for c in before))
    return out


def config_of(conditional: Conditional) -> Column:
    """The configuration of a row, from its columns."""
    return F.array(*[F.col(f"`{c}`").cast("int") for c in conditional.scope]).cast("array<int>")
