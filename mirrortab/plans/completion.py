"""All missing cells of a row at once: the likeliest completion, or a draw from their joint distribution.

A row asks a *problem*: which cells are missing, and the codes of the given cells that have a bearing
on them.  Rows that ask the same problem share it.  Problems are solved together, column by column in
topological order.  A state is a problem with codes for the missing cells met so far and the log
weight of the terms met so far; a missing cell multiplies states by its candidates.  Once no later
term mentions a column, states that differ only in closed columns are merged, so a problem has at
most as many states as its *open* missing cells have combinations, however many cells are missing.

* the likeliest completion keeps the best state of each merge, with the codes that led to it;
* for a draw a merge adds the weights up and stores the shares of what it merged.  Rows then go
  through the stored shares backwards, each with its own uniform numbers: filter forward, sample back.

As in sampling, a configuration that was never seen is uniform, and so is one with a given value the
model does not know; a given value that was never seen under a seen configuration has ``NEVER_SEEN``.
States grow with the cardinalities of columns that are missing together and linked, not with rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import uniform01
from mirrortab.operators.core import FitTable, checkpointed, fit_table, lookup
from mirrortab.plans.condition import NEVER_SEEN

MISSING, UNRELATED, UNKNOWN = -1, -2, -3  # in place of a code in a problem
ROUNDING = 9  # decimals of a log weight that tell completions apart
STEPS_PER_CUT = 12  # columns between lineage cuts


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


@dataclass(frozen=True)
class Plan:
    """Columns in topological order; all else by position in it."""

    names: tuple[str, ...]
    parents: tuple[tuple[int, ...], ...]
    cards: tuple[int, ...]

    @staticmethod
    def of(model) -> Plan:
        names = (model.target, *model.order)
        at = {c: i for i, c in enumerate(names)}
        parents = [()] + [(0, *[at[p] for p in model.parents[c]]) for c in model.order]
        return Plan(names, tuple(parents), tuple(model.cards[c] for c in names))

    def blanket(self, i: int) -> set[int]:
        """Columns that share a term with column ``i``."""
        terms = [{c, *ps} for c, ps in enumerate(self.parents)]
        return set().union(*[t for t in terms if i in t]) - {i}

    def last_use(self, i: int) -> int:
        return max([i, *[c for c, ps in enumerate(self.parents) if i in ps]])


def problems_of(model, coded: DataFrame, given: Mapping[str, str]) -> tuple[DataFrame, Plan]:
    """``coded`` with ``_problem``: a code or one of the marks above for every column of the plan."""
    plan = Plan.of(model)
    null = [F.col(f"`{c}`").isNull() for c in plan.names]
    gap = [
        F.lit(False) if not plan.cards[i] else null[i] & F.col(f"`{given[c]}`").isNull() if c in given else null[i]
        for i, c in enumerate(plan.names)
    ]
    marks = [
        F.when(gap[i], F.lit(MISSING)).when(null[i], F.lit(UNKNOWN))
        .when(_any([gap[j] for j in sorted(plan.blanket(i))]), F.col(f"`{c}`").cast("int")).otherwise(F.lit(UNRELATED))
        for i, c in enumerate(plan.names)
    ]
    return coded.withColumn("_problem", F.array(*marks)), plan


def _candidates(model, plan: Plan) -> list[FitTable]:
    """``(_config, _cands)`` of each column: the seen values of a configuration with their log probability."""
    cells = F.struct(F.col("value").alias("v"), F.log("p").alias("s"))
    packed = checkpointed(
        model.cpt.df.groupBy("feature", F.col("config").alias("_config")).agg(F.sort_array(F.collect_list(cells)).alias("_cands"))
    )
    size = F.sum(F.lit(32) + F.size("_config") * 4 + F.size("_cands") * 40).alias("bytes")
    sizes = {r["feature"]: r for r in packed.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), size).collect()}
    return [
        FitTable(packed.where(F.col("feature") == c).drop("feature"), *((sizes[c]["rows"], sizes[c]["bytes"]) if c in sizes else (0, 0)))
        for c in plan.names
    ]


def _extend(states: DataFrame, plan: Plan, i: int, table: FitTable, gaps: set[int]) -> DataFrame:
    """States with column ``i``: missing cells take each candidate, and its term joins the weight."""
    x, card = F.col(f"x{i}"), plan.cards[i]
    missing = F.col(f"g{i}") if i in gaps else F.lit(False)
    touched = missing | _any([F.col(f"g{j}") for j in plan.parents[i] if j in gaps])
    config = F.array(*[F.col(f"x{j}") for j in plan.parents[i]]).cast("array<int>")
    found = lookup(states.withColumn("_config", F.when(touched & (x != UNKNOWN), config)), table, ["_config"], "left")
    flat, cands = F.lit(-math.log(max(card, 1))), F.col("_cands")
    same = F.try_element_at(F.filter(cands, lambda e: e["v"] == x), F.lit(1))["s"]
    mine = F.when(cands.isNull(), flat).otherwise(F.coalesce(same, F.lit(math.log(NEVER_SEEN))))
    one = F.struct(x.alias("v"), F.when(touched & (x >= 0), mine).otherwise(0.0).alias("s"))
    if i in gaps:
        uniform = F.transform(F.sequence(F.lit(0), F.lit(card - 1)), lambda v: F.struct(v.alias("v"), flat.alias("s")))
        found = found.withColumn("_e", F.explode(F.when(missing, F.coalesce(cands, uniform)).otherwise(F.array(one))))
    else:
        found = found.withColumn("_e", one)
    return found.withColumns({f"x{i}": F.col("_e.v"), "s": F.col("s") + F.col("_e.s")}).drop("_config", "_cands", "_e")


def _best(states: DataFrame, open_: list[int], gaps: list[int]) -> DataFrame:
    """The best state of every problem and codes of the open columns; the smaller codes on ties."""
    rest = [c for c in states.columns if c != "pid"]
    codes = F.array(*[-F.col(f"x{j}") for j in gaps]).alias("_order")
    ranked = F.struct(F.round("s", ROUNDING).alias("_rounded"), codes, *rest)
    kept = states.groupBy("pid", *[F.col(f"x{j}").alias(f"_k{j}") for j in open_]).agg(F.max(ranked).alias("_m"))
    return kept.select("pid", *[f"_m.{c}" for c in rest])


def _summed(states: DataFrame, open_: list[int], closed: list[int]) -> DataFrame:
    """Merged states with their summed weight, and ``_shares``: the closed columns' codes with their upper share.

    A group holds the combinations of the closed columns' candidates, never rows.
    """
    rest = [c for c in states.columns if c not in ("pid", "s", *[f"x{j}" for j in [*open_, *closed]])]
    member = F.struct(F.array(*[F.col(f"x{j}") for j in closed]).cast("array<int>").alias("codes"), "s")
    merged = states.groupBy("pid", *[f"x{j}" for j in open_]).agg(
        F.sort_array(F.collect_list(member)).alias("_all"), *[F.first(c).alias(c) for c in rest]
    )
    merged = merged.withColumn("_top", F.array_max(F.transform("_all", lambda e: e["s"])))
    shares = F.aggregate(
        "_all",
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<codes:array<int>,hi:double>>").alias("run")),
        lambda acc, e: F.struct(
            (acc["sum"] + F.exp(e["s"] - F.col("_top"))).alias("sum"),
            F.concat(acc["run"], F.array(F.struct(
                e["codes"].alias("codes"), (acc["sum"] + F.exp(e["s"] - F.col("_top"))).alias("hi")))).alias("run"),
        ),
    )
    merged = merged.withColumn("_acc", shares).withColumn("s", F.col("_top") + F.log(F.col("_acc.sum")))
    return merged.withColumn("_shares", F.transform(F.col("_acc.run"), lambda e: F.struct(
        e["codes"].alias("codes"), (e["hi"] / F.col("_acc.sum")).alias("hi")))).drop("_all", "_top", "_acc")


def _solve(model, plan: Plan, problems: DataFrame, gaps: list[int], draw: bool) -> tuple[DataFrame, list]:
    """One state a problem, and for draws the stored merges: ``(open, closed, shares)`` in order."""
    tables = _candidates(model, plan)
    n = len(plan.names)
    marks = {f"x{i}": F.element_at("_problem", i + 1) for i in range(n)}
    flags = {f"g{i}": F.element_at("_problem", i + 1) == MISSING for i in gaps}
    states = problems.repartition("pid").select(
        "pid", *[c.alias(k) for k, c in {**marks, **flags}.items()], F.lit(0.0).alias("s")
    )
    merges, open_, since = [], [], 0
    for i in range(n):
        if i not in gaps and not set(plan.parents[i]) & set(gaps):
            continue
        states = _extend(states, plan, i, tables[i], set(gaps))
        if i in gaps:
            open_.append(i)
        closed = [j for j in open_ if plan.last_use(j) <= i]
        since += 1
        if closed:
            open_ = [j for j in open_ if j not in closed]
            if draw:
                merged = checkpointed(_summed(states, open_, closed))
                shares = merged.select("pid", *[f"x{j}" for j in open_], "_shares")
                size = merged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_shares")).alias("e")).first()
                bytes_ = size["n"] * 16 * (len(open_) + 2) + (size["e"] or 0) * (24 + 4 * len(closed))
                merges.append((list(open_), closed, FitTable(shares, size["n"], bytes_)))
                states, since = merged.drop("_shares").withColumns({f"x{j}": F.lit(MISSING) for j in closed}), 0
            else:
                states = _best(states, open_, [j for j in gaps if j <= i])
        if since >= STEPS_PER_CUT:
            states, since = checkpointed(states), 0
    return states, merges


def complete_codes(model, coded: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """Fill null codes of ``key``, the model's columns and ``_given_<i>`` columns (the raw values, if there).

    Without a seed every row gets its likeliest completion (by the log weight at nine decimals; on ties the smallest codes, the
    label first, then in topological order); with a seed a draw from the joint distribution of its
    missing cells.  A given value the model does not know is no gap.  Rows without gaps stay.
    """
    columns = [*model.features, model.target]
    given = {c: f"_given_{i}" for i, c in enumerate(columns) if f"_given_{i}" in coded.columns}
    carried = [key, *columns, *given.values()]
    rows, plan = problems_of(model, coded.select(*carried), given)
    rows = checkpointed(rows)
    asked = rows.where(F.array_contains("_problem", MISSING))
    problems = checkpointed(asked.select("_problem").distinct().withColumn("pid", F.monotonically_increasing_id()))
    seen = problems.agg(*[F.max(F.element_at("_problem", i + 1) == MISSING).alias(f"g{i}") for i in range(len(plan.names))]).first()
    gaps = [i for i in range(len(plan.names)) if seen[f"g{i}"]]
    if not gaps:
        return rows.drop("_problem")
    solved, merges = _solve(model, plan, problems, gaps, seed is not None)
    place = {c: i for i, c in enumerate(plan.names)}
    if seed is None:
        mark = [F.when(F.col(f"g{i}"), F.lit(MISSING)).otherwise(F.col(f"x{i}")) if i in gaps else F.col(f"x{i}") for i in range(len(plan.names))]
        answers = fit_table(solved.select(F.array(*mark).alias("_problem"), F.array(*[F.col(f"x{i}") for i in gaps]).alias("_codes")))
        rows = lookup(rows, answers, ["_problem"], "left")
        code = {i: F.element_at("_codes", n + 1) for n, i in enumerate(gaps)}
    else:
        rows = lookup(rows, fit_table(problems), ["_problem"], "left")
        for step, (open_, closed, shares) in reversed(list(enumerate(merges))):
            # drawn before the join, or the number would be computed for every share it is compared with
            rows = lookup(rows.withColumn("_u", uniform01(seed, key, f"completion {step}")), shares, ["pid", *[f"x{j}" for j in open_]], "left")
            run = F.col("_shares")
            drawn = F.coalesce(F.try_element_at(F.filter(run, lambda e: e["hi"] > F.col("_u")), F.lit(1)), F.element_at(run, -1))["codes"]
            rows = rows.withColumn("_drawn", drawn).withColumns({f"x{j}": F.element_at("_drawn", n + 1) for n, j in enumerate(closed)})
            rows = rows.drop("_shares", "_drawn", "_u")
            if not shares.broadcastable:
                rows = checkpointed(rows)
        code = {i: F.col(f"x{i}") for i in gaps}
    missing = lambda i: F.element_at("_problem", i + 1) == MISSING
    filled = {c: F.when(missing(place[c]), code[place[c]]).otherwise(F.col(f"`{c}`")) for c in columns if place[c] in gaps}
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in carried])
