"""Fill missing cells from a fitted network, and complete partial rows given as text."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import uniform01
from mirrortab.operators.clean import PLACEHOLDER
from mirrortab.operators.core import FitTable, checkpointed, fit_table, heavy_keys, lookup, within_budget
from mirrortab.operators.encode import argmax_code, encode
from mirrortab.operators.rowtext import text_to_row
from mirrortab.plans.completion import complete_codes
from mirrortab.plans.kdb import NEVER_SEEN, KdbModel, decode_rows


def _scores_by(cells: DataFrame, key: Column, candidate: Column, card: int) -> DataFrame:
    """``(_key, _scores)``: log-probabilities of all candidate codes under each key."""
    packed = cells.select(key.alias("_key"), F.struct(candidate.alias("c"), F.log("p").alias("s")).alias("e"))
    by_code = F.map_from_entries(F.collect_list("e"))  # at most one entry per candidate
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(card - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(math.log(NEVER_SEEN))),
    )
    return packed.groupBy("_key").agg(by_code.alias("_m")).select("_key", dense.alias("_scores"))


def _term(model: KdbModel, column: str, child: str, i: int) -> tuple[FitTable, Column]:
    """``child``'s table as a term of the candidate scores of ``column``, and the key of a row in it.

    The table is regrouped so that one row holds the scores of all candidates: the lookup is
    one to one, rows are neither multiplied nor shuffled, and a row whose other cells are
    not all known finds nothing and adds nothing.
    """
    card = model.cards[column]
    cells = model.cpt.df.where(F.col("feature") == child)
    if child == column:
        table = _scores_by(cells, F.col("config"), F.col("value"), card)
        key = model.config(column)
    else:
        names = [model.target, *model.parents[child]]
        at = names.index(column)
        others = [c for i, c in enumerate(names) if i != at]
        kept = F.array(*[F.element_at("config", i + 1) for i in range(len(names)) if i != at], F.col("value"))
        table = _scores_by(cells, kept, F.element_at("config", at + 1), card)
        key = F.array(*[F.col(f"`{c}`").cast("int") for c in [*others, child]])
    bound = model.groups.get(child, (0, 0))[0]
    sized = FitTable(table, bound, bound * card * 8)
    if not sized.broadcastable:
        sized = fit_table(table)
        sized = FitTable(sized.df, sized.rows, sized.rows * card * 8)
    named = sized.df.withColumnsRenamed({"_key": f"_key_{i}", "_scores": f"_scores_{i}"})
    return FitTable(named, sized.rows, sized.bytes), F.when(F.col("_total").isNotNull(), key)


def _add_terms(rows: DataFrame, terms: list[tuple[FitTable, Column]]) -> tuple[DataFrame, bool]:
    """``_total`` with all terms; heavy keys of all are counted in one pass.  Tells if rows were shuffled."""
    tables = [table for table, _ in terms]
    rows = rows.withColumns({f"_key_{i}": key for i, (_, key) in enumerate(terms)})
    small = within_budget(tables)
    large = [i for i in range(len(terms)) if not small[i]]
    heavy = {}
    if large:
        rows = checkpointed(rows)  # counted, then joined
        heavy = dict(zip(large, heavy_keys(rows, [[f"_key_{i}"] for i in large])))
    for i, table in enumerate(tables):
        rows = lookup(rows, table, [f"_key_{i}"], "left", heavy.get(i)).drop(f"_key_{i}")
    total = F.col("_total")
    for i in range(len(terms)):
        total = F.coalesce(F.zip_with(total, f"_scores_{i}", lambda a, b: a + b), total)
    return rows.withColumn("_total", total), bool(large)


def impute_codes(
    model: KdbModel, coded: DataFrame, key: str, seed: int | None = None, set_aside: bool = True
) -> DataFrame:
    """Fill null codes, one column at a time in topological order.

    Every candidate value of a missing cell is scored by the log-likelihood of the row's
    known cells: the cell's own table and those of its children.  The best wins (the
    smallest code on ties); with a seed a candidate is drawn in proportion to its likelihood
    instead, by adding Gumbel noise to the score.  Rows with gaps are spread evenly first,
    however few partitions the input has.  Rows without take no part, at the price of a second pass
    over the input; without ``set_aside`` they go along, for inputs in which nearly all rows have gaps.
    """
    columns = [*model.features, model.target]
    given = {c: f"_given_{i}" for i, c in enumerate(columns) if f"_given_{i}" in coded.columns}
    carried = [key, *columns, *given.values()]
    # a given value that the model does not know is no gap
    gaps = {
        c: F.col(c).isNull() & F.col(given[c]).isNull() if c in given else F.col(c).isNull()
        for c in columns if model.cards[c]
    }
    rows = coded.select(*carried)
    if not gaps:
        return rows
    incomplete = reduce(lambda a, b: a | b, gaps.values())
    complete = rows.where(~incomplete)
    rows = (rows.where(incomplete) if set_aside else rows).repartition(key)
    for column in [c for c in [model.target, *model.order] if c in gaps]:
        card = model.cards[column]
        children = [c for c in model.order if column == model.target or column in model.parents[c]]
        # rows that have the cell carry no scores, so nothing is computed for them
        zeros = F.array(*[F.lit(0.0)] * card) if card <= 64 else F.array_repeat(F.lit(0.0), card)
        scored = rows.withColumn("_total", F.when(gaps[column], zeros))
        scored, shuffled = _add_terms(scored, [_term(model, column, c, i) for i, c in enumerate([column, *children])])
        if seed is None:
            final = F.transform("_total", lambda s: F.round(s, 9))
        else:
            noise = lambda i: -F.log(-F.log(uniform01(seed, F.concat_ws("#", F.col(key).cast("string"), i.cast("string")), column) + F.lit(2.0**-53)))
            final = F.transform("_total", lambda s, i: s + noise(i))
        rows = scored.withColumn("_total", final).select(
            *[
                F.coalesce(F.col(c), argmax_code(F.col("_total"))).alias(c) if c == column else F.col(c)
                for c in carried
            ]
        )
        if shuffled:
            rows = checkpointed(rows)
    return rows.unionByName(complete) if set_aside else rows


def impute(
    model: KdbModel, df: DataFrame, key: str, seed: int | None = None, set_aside: bool = True, joint: bool = False
) -> DataFrame:
    """Fill every missing cell of a raw table with the model's columns.

    Given cells stay as they are.  A given value that the model does not know says nothing about
    the other cells.  Cells are filled one column after the other, or with ``joint`` all cells of a row
    together (:mod:`mirrortab.plans.completion`).
    """
    columns = [*model.features, model.target]
    if set(df.columns) - {key} != set(columns):
        raise ValueError("the table's columns differ from the model's")
    known = df.select(key, *columns, *[F.col(f"`{c}`").alias(f"_given_{i}") for i, c in enumerate(columns)])
    codes = encode_known(model, known)
    codes = complete_codes(model, codes, key, seed) if joint else impute_codes(model, codes, key, seed, set_aside)
    filled = decode_rows(model, codes)
    return filled.select(key, *[F.coalesce(F.col(f"_given_{i}"), F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)])


def encode_known(model: KdbModel, df: DataFrame) -> DataFrame:
    """Codes where the cell is present and known, null otherwise."""
    columns = [*model.features, model.target]
    present = df.withColumns({f"_has_{i}": F.col(f"`{c}`").isNotNull() for i, c in enumerate(columns)})
    coded = encode(present, model.dictionary, columns)
    return coded.select(
        *[c for c in df.columns if c not in columns],
        *[F.when(F.col(f"_has_{i}"), F.col(c)).alias(c) for i, c in enumerate(columns)],
    )


def complete_partial_rows(model: KdbModel, prompts: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """Rows from prompts such as ``a is 1, b is x``: given cells stay, the others are drawn together."""
    columns = [*model.features, model.target]
    parsed = text_to_row(prompts.select(key, text), text, columns).drop(text)
    cells = parsed.withColumns({c: F.when(F.col(c) != PLACEHOLDER, F.col(c)) for c in columns})
    typed = cells.withColumns(
        {c: F.col(c).try_cast(model.dictionary.types[c]) for c in columns}
    )
    return impute(model, typed, key, seed, joint=True)
