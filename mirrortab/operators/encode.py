"""Value dictionaries, label / ordinal / one-hot / mixed-radix codes, and their inverses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mirrortab.operators.clean import MISSING, is_numeric, missing_text, unified_missing
from mirrortab.operators.core import (
    FitTable, checkpointed, heavy_keys, lookup, row_count, running_total, unpivot, within_budget,
)


@dataclass(frozen=True)
class Dictionary:
    """Sorted values of each column with dense codes: ``(column, value, code, n)``.

    ``sizes`` holds rows and text bytes per column, which decide how each is joined.
    """

    df: DataFrame
    sizes: Mapping[str, tuple[int, int]]
    types: Mapping[str, str]
    missing_first: bool = False

    def cardinality(self, column: str) -> int:
        return self.sizes.get(column, (0, 0))[0]

    def column(self, column: str, value: str, code: str) -> FitTable:
        rows, size = self.sizes.get(column, (0, 0))
        part = self.df.where(F.col("column") == column).select(
            F.col("value").alias(value), F.col("code").alias(code)
        )
        return FitTable(part, rows, rows * 48 + size)

    def text(self, column: str) -> Column:
        c = F.col(f"`{column}`")
        return unified_missing(c) if self.missing_first else missing_text(c)


def column_sizes(table: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows and text bytes per column of a long ``(column, value, ...)`` table."""
    sized = table.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes")
    )
    return {r["column"]: (r["rows"], r["bytes"]) for r in sized.collect()}


def fit_dictionary(
    df: DataFrame, cols: Sequence[str], missing_first: bool = False, weight: str | None = None,
    types: Mapping[str, DataType] | None = None,
) -> Dictionary:
    """Codes of all columns in one pass: combined counts, then a running count per column.

    Nulls become ``Missing``.  Text sorts by its bytes, numbers by value; with
    ``missing_first`` values are trimmed and ``Missing`` gets code 0.  ``weight`` names a column that says how
    often a row stands; ``types`` are those of the values where ``df`` holds their text.
    """
    cols = list(cols)
    types = {c: df.schema[c].dataType for c in cols} if types is None else types
    numeric = [c for c in cols if is_numeric(types[c])]
    text = lambda c: unified_missing(F.col(f"`{c}`")) if missing_first else missing_text(F.col(f"`{c}`"))
    weights = [weight] if weight else []
    counts = (
        unpivot(df.select(*weights, *[text(c).alias(c) for c in cols]), cols, weights)
        .groupBy("column", "value")
        .agg(row_count(weight).alias("n"))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    first = (F.col("value") != MISSING).cast("int") if missing_first else F.lit(0)
    number = F.lit(0.0)
    if numeric:
        as_number = F.coalesce(F.col("value").try_cast("double"), F.lit(float("inf")))  # Missing last
        number = F.when(F.col("column").isin(numeric), as_number).otherwise(number)
    keyed = counts.select("*", first.alias("_first"), number.alias("_number"))
    keyed = checkpointed(keyed)
    sizes = column_sizes(keyed)
    whole = FitTable(keyed, sum(r for r, _ in sizes.values()), 0)
    coded = running_total(whole, ["column"], ["_first", "_number", "value"], "_one", "_code")
    table = checkpointed(
        coded.select("column", "value", (F.col("_code") - 1).cast("int").alias("code"), "n")
    )
    return Dictionary(table, sizes, {c: types[c].simpleString() for c in cols}, missing_first)


def _chain(rows: DataFrame, tables: Sequence[FitTable], keys: Sequence[str]) -> DataFrame:
    """One lookup a key column, each key column dropped; heavy keys of all are counted in one pass."""
    small = within_budget(tables)
    large = [i for i in range(len(keys)) if not small[i]]
    heavy = dict(zip(large, heavy_keys(rows, [[keys[i]] for i in large]))) if large else {}
    for i, key in enumerate(keys):
        rows = lookup(rows, tables[i], [key], heavy=heavy.get(i)).drop(key)
    return rows


def encode(df: DataFrame, dictionary: Dictionary, cols: Sequence[str], unknown: int | None = None) -> DataFrame:
    """Replace values by codes; an unknown value becomes ``unknown`` (null by default)."""
    order = df.columns
    keyed = df.withColumns({f"_v{i}": dictionary.text(c) for i, c in enumerate(cols)})
    tables = [dictionary.column(c, f"_v{i}", f"_c{i}") for i, c in enumerate(cols)]
    rows = _chain(keyed, tables, [f"_v{i}" for i in range(len(cols))])
    codes = {c: F.col(f"_c{i}") for i, c in enumerate(cols)}
    if unknown is not None:
        codes = {c: F.coalesce(e, F.lit(unknown)) for c, e in codes.items()}
    return rows.select(*[codes[c].alias(c) if c in codes else F.col(f"`{c}`") for c in order])


def decode(df: DataFrame, dictionary: Dictionary, cols: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """Codes back to values of the original type; codes are rounded and clipped first, no code gives no value.

    ``Missing`` turns back into null unless ``keep_missing``.
    """
    order = df.columns
    keys = {}
    for i, c in enumerate(cols):
        top = max(dictionary.cardinality(c) - 1, 0)
        number = F.col(f"`{c}`").cast("double")
        inside = F.greatest(F.lit(0), F.least(F.rint(number), F.lit(top))).cast("int")
        keys[f"_c{i}"] = F.when(number.isNotNull() & ~F.isnan(number), inside)
    tables = [dictionary.column(c, f"_v{i}", f"_c{i}") for i, c in enumerate(cols)]
    rows = _chain(df.withColumns(keys), tables, list(keys))
    values = {}
    for i, c in enumerate(cols):
        v = F.col(f"_v{i}")
        if not keep_missing:
            v = F.when(v != MISSING, v)
        values[c] = v.cast(dictionary.types[c])
    return rows.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in order])


def one_hot(code: Column, cardinality: int) -> Column:
    """0/1 array; a code outside the range (unknown) gives all zeros."""
    if cardinality == 0:
        return F.array().cast("array<int>")
    return F.transform(
        F.sequence(F.lit(0), F.lit(cardinality - 1)), lambda i: F.coalesce((i == code).cast("int"), F.lit(0))
    )


def argmax_code(scores: Column) -> Column:
    """Position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def condition_matrix(df: DataFrame, dictionary: Dictionary, cols: Sequence[str], out: str = "cond") -> DataFrame:
    """One array per row: the one-hot blocks of all categorical columns side by side."""
    coded = encode(df, dictionary, cols, unknown=-1)
    blocks = [one_hot(F.col(f"`{c}`"), dictionary.cardinality(c)) for c in cols]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return coded.select(*rest, F.concat(*blocks).alias(out))


def high_order_id(column: str, parents: Sequence[str], cards: Mapping[str, int]) -> Column:
    """Mixed-radix number of ``(parents..., column)``; the column is the last digit."""
    digits = [*parents, column]
    total = F.lit(0).cast("bigint")
    for d in digits:
        total = total * F.lit(cards[d]) + F.col(f"`{d}`")
    return total


def high_order_encode(
    coded: DataFrame, parents: Mapping[str, Sequence[str]], cards: Mapping[str, int], keep: Sequence[str] = ()
) -> tuple[DataFrame, Dictionary]:
    """Dense codes of every feature's combination with its parents.

    Returns the coded rows and the dictionary, from which one-hot blocks follow.
    """
    ids = coded.select(*keep, *[high_order_id(c, ps, cards).alias(c) for c, ps in parents.items()])
    dictionary = fit_dictionary(ids, list(parents))
    return encode(ids, dictionary, list(parents)), dictionary
