"""Weighted draws by alias slots: a draw is one slot number and one comparison, whatever the weights.

A group of ``m`` values has ``m`` slots of equal mass.  A slot belongs to a value; what the value does not
fill goes to one other value, its alias.  Values are light (weight below the mean) or heavy: light ones are
filled up by the heavy ones in order, and a heavy one that runs out on the way is filled up by the next.
Who fills whom follows from two running sums, of what the light ones lack and of what the heavy ones have
over, so that a group may be as large as the table.  Weights are whole numbers and everything is exact:
a group's weights times its number of values must stay below 2**63, or Spark reports an overflow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import uniform01
from mirrortab.operators.core import FitTable, checkpointed, fit_table, lookup, running_total


@dataclass(frozen=True)
class AliasTable:
    """``slots``: group, ``_slot``, value, ``_alias``, ``_keep``; ``groups``: group, ``_m``, ``_total``."""

    group: tuple[str, ...]
    value: str
    slots: FitTable
    groups: FitTable


def _counted(events: DataFrame, group: Sequence[str], first: Column, counts: Column) -> DataFrame:
    """``_seen``: events of the kind ``counts`` up to each event, those of the kind ``first`` first on ties."""
    marked = events.withColumns({"_order": F.when(first, 0).otherwise(1), "_one": counts.cast("bigint")})
    return running_total(marked, group, ["_pos", "_order"], "_one", "_seen", "_all").drop("_all", "_order", "_one")


def fit_alias(weights: DataFrame, group: Sequence[str], value: str, weight: str) -> AliasTable:
    """Slots from ``(group..., value, weight)`` with distinct values and whole weights.

    Weights of zero, null or less are left out, and so are rows with a null in a group column: no draw
    would meet them.  A null value is a value.
    """
    group = list(group)
    one = F.lit(1).cast("bigint")
    known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in group], F.col(weight) > 0)
    rows = weights.where(known).select(*group, value, F.col(weight).cast("bigint").alias("_w"), one.alias("_n"))
    numbered = running_total(rows, group, [value], "_n", "_rank", "_m").drop("_n")
    sized = running_total(numbered, group, ["_rank"], "_w", "_cum", "_total").withColumn(
        "_over", F.col("_w") * F.col("_m") - F.col("_total")
    ).drop("_cum", "_w")
    sized = checkpointed(sized)

    def side(part: DataFrame, amount: Column) -> DataFrame:
        """Numbered, with the running sum before (``_lo``) and after (``_hi``) each row."""
        run = running_total(part.withColumns({"_amount": amount, "_n": one}), group, ["_rank"], "_amount", "_hi", "_t")
        run = running_total(run.drop("_t"), group, ["_rank"], "_n", "_i", "_t").drop("_t", "_n")
        return checkpointed(run.withColumn("_lo", F.col("_hi") - F.col("_amount")))

    light = side(sized.where("_over < 0"), -F.col("_over"))
    heavy = side(sized.where("_over > 0"), F.col("_over"))
    kinds = lambda at: light.select(*group, F.col(at).alias("_pos"), "_i", F.lit(True).alias("_light")).unionByName(
        heavy.select(*group, F.col(at).alias("_pos"), "_i", F.lit(False).alias("_light"))
    )
    # the heavy value whose surplus a light one begins in, and the light one in which a heavy one's surplus ends
    giver = _counted(kinds("_lo"), group, ~F.col("_light"), ~F.col("_light")).where("_light").select(*group, "_i", F.col("_seen").alias("_j"))
    taker = _counted(kinds("_hi"), group, ~F.col("_light"), F.col("_light")).where("NOT _light").select(
        *group, "_i", (F.col("_seen") + 1).alias("_k"), (F.col("_i") + 1).alias("_j")
    )
    heirs = heavy.select(*group, F.col("_i").alias("_j"), F.col(value).alias("_alias"))
    ends = light.select(*group, F.col("_i").alias("_k"), F.col("_hi").alias("_end"))
    slot = (F.col("_rank") - 1).alias("_slot")
    join = lambda a, b, on, how="inner": _joined(a, b, [*group, *on], how)
    low = join(join(light, giver, ["_i"]), heirs, ["_j"]).select(
        *group, slot, value, "_alias", (F.col("_total") - F.col("_amount")).alias("_keep")
    )
    high = join(join(join(heavy, taker, ["_i"]), ends, ["_k"]), heirs, ["_j"], "left").select(
        *group, slot, value, "_alias", (F.col("_total") - (F.col("_end") - F.col("_hi"))).alias("_keep")
    )
    even = sized.where("_over = 0").select(*group, slot, value, F.col(value).alias("_alias"), F.col("_total").alias("_keep"))
    slots = fit_table(low.unionByName(high).unionByName(even))
    groups = fit_table(sized.where("_rank = 1").select(*group, "_m", "_total"))
    return AliasTable(tuple(group), value, slots, groups)


def _joined(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys of which there is one row each; nulls are equal."""
    named = b.withColumnsRenamed({c: f"_b_{c}" for c in on})
    same = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_b_{c}`")) for c in on])
    return a.join(named, same, how).drop(*[f"_b_{c}" for c in on])


def alias_draw(draws: DataFrame, table: AliasTable, key: str, seed: int = 42, stream: str = "", out: str = "value") -> DataFrame:
    """Add ``out``: a value of the row's group by weight, null where the group is unknown.

    Two equi-joins: the group's number of slots, then ``(group, slot)``.  Rows of one hot group spread
    over its slots, and over salts where few slots hold most rows.
    """
    group, kept = list(table.group), draws.columns
    u = draws.withColumn("_u", uniform01(seed, key, stream))
    if group:
        at = lookup(u, table.groups, group, "left")
    else:
        at = u.join(F.broadcast(table.groups.df), F.lit(True), "left")  # one row
    at = at.withColumn("_at", F.col("_u") * F.col("_m")).withColumn("_slot", F.floor("_at"))
    dim = table.slots.df.withColumnRenamed(table.value, "_value")
    found = lookup(at, FitTable(dim, table.slots.rows, table.slots.bytes), [*group, "_slot"], "left")
    mine = (F.col("_at") - F.col("_slot")) * F.col("_total") < F.col("_keep")
    return found.select(*[F.col(f"`{c}`") for c in kept if c != out], F.when(mine, F.col("_value")).otherwise(F.col("_alias")).alias(out))
