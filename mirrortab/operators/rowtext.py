"""Rows as text and back: ``column is value, column is value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import first_number, format_cell, row_hash
from mirrortab.operators.clean import PLACEHOLDER
from mirrortab.operators.core import fit_table, lookup


def _sentences(df: DataFrame, cols: Sequence[str], key: str, seed: int | None, float_precision: int | None) -> Column:
    parts = []
    for i, c in enumerate(cols):
        cell = format_cell(F.col(f"`{c}`"), df.schema[c].dataType, float_precision)
        order = row_hash(seed, key, F.lit(c)) if seed is not None else F.lit(f"{i:06d}")
        parts.append(F.struct(order.alias("o"), F.concat(F.lit(f"{c} is "), cell).alias("t")))
    said = F.filter(F.sort_array(F.array(*parts)), lambda s: s["t"].isNotNull())
    return F.array_join(F.transform(said, lambda s: s["t"]), ", ")


def row_to_text(
    df: DataFrame, cols: Sequence[str], key: str, seed: int | None = 42,
    float_precision: int | None = None, out: str = "text",
) -> DataFrame:
    """Known cells of a row in an order given by seed and key (column order without seed)."""
    return df.withColumn(out, _sentences(df, cols, key, seed, float_precision))


def text_to_row(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Parse sentences: the first value of a column wins, others are ignored, a column that
    is not mentioned is ``placeholder`` and the text ``None`` is null."""
    pieces = F.transform(F.split(F.col(text), ","), lambda f: F.split(stripped(f), " is "))
    work = df.withColumn("_pieces", pieces)

    def says(column: str):
        return lambda p: (p[0] == column) & (F.size(p) > 1)

    for c in columns:
        hit = F.filter(F.col("_pieces"), says(c))
        value = F.coalesce(F.get(F.get(hit, F.lit(0)), F.lit(1)), F.lit(PLACEHOLDER))
        work = work.withColumn(c, F.when(value != "None", value))
    return work.drop("_pieces")


def partial_row_prompt(
    df: DataFrame, cols: Sequence[str], key: str, seed: int = 42,
    float_precision: int | None = None, out: str = "prompt",
) -> DataFrame:
    """Known cells, then the name of one missing column: ``a is 1, b is``."""
    known = _sentences(df, cols, key, seed, float_precision)
    gaps = F.array(
        *[
            F.when(F.col(f"`{c}`").isNull(), F.struct(row_hash(seed, key, F.lit(c), F.lit("missing")).alias("o"), F.lit(c).alias("c")))
            for c in cols
        ]
    )
    gap = F.array_min(gaps)["c"]  # nulls are skipped
    head = F.when(known != "", F.concat(known, F.lit(", "))).otherwise(F.lit(""))
    tail = F.when(gap.isNotNull(), F.concat(gap, F.lit(" is"))).otherwise(F.lit(""))
    return df.withColumn(out, F.concat(head, tail))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cut_generated_value(raw: Column, longest: int | None = None) -> Column:
    """First token of a generated value, without trailing punctuation.

    Cuts at ``;``, else at the first of comma, dot, line feed, blank that occurs (fixed
    delimiters).  ``longest`` limits a value without any delimiter; by default it stays whole.
    """
    text = stripped(raw)
    cut = F.when(F.contains(text, F.lit(";")), F.split_part(text, F.lit(";"), F.lit(1)))
    for mark in (",", ".", "\n", " "):
        cut = cut.when(F.contains(text, F.lit(mark)), F.split_part(text, F.lit(mark), F.lit(1)))
    token = stripped(cut.otherwise(text if longest is None else F.substring(text, 1, longest)))
    return F.regexp_replace(token, r"[^\p{L}\p{N}.\-]+$", "")


def clean_generated_number(raw: Column) -> Column:
    """First number of the value, or the value itself when it has none."""
    token = cut_generated_value(raw)
    return F.coalesce(first_number(token), token)


def clean_generated_category(df: DataFrame, raw: str, categories: DataFrame, out: str = "value") -> DataFrame:
    """Generated text matched to a known category without regard to case.

    An equal category wins, else the first (in sorted order) that the value contains, else
    the value itself.  Distinct values are matched once, then looked up.  Containment is an
    equi-join too: a category is contained exactly when it equals one of the value's
    substrings of a length that some category has.
    """
    known = fit_table(
        categories.select(F.col(categories.columns[0]).cast("string").alias("_cat"))
        .where(F.length("_cat") > 0).groupBy(F.lower("_cat").alias("_low")).agg(F.min("_cat").alias("_cat"))
    )
    lengths = [r[0] for r in known.df.select(F.length("_low")).distinct().collect()]
    rows = df.withColumn("_token", cut_generated_value(F.col(raw)))
    if not lengths:
        return rows.withColumn(out, F.col("_token")).drop("_token")
    low = F.lower("_token")

    def substrings(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
        found = F.transform(starts, lambda i: F.substr(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, found).otherwise(F.array().cast("array<string>"))

    tokens = rows.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    every = F.flatten(F.array(*[substrings(n) for n in sorted(lengths)]))
    pieces = tokens.select("_token", F.explode(F.array_distinct(every)).alias("_low"))
    hits = lookup(pieces, known, ["_low"], "inner").groupBy("_token").agg(
        F.min(F.when(F.col("_low") == low, F.col("_cat"))).alias("_equal"), F.min("_cat").alias("_inside")
    )
    matched = fit_table(hits.select("_token", F.coalesce("_equal", "_inside").alias("_match")))
    return lookup(rows, matched, ["_token"]).withColumn(out, F.coalesce("_match", "_token")).drop("_token", "_match")
