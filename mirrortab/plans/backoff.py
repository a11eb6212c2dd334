"""Contexts of a Bayes network: a configuration never seen follows the longest part of it that was.

The tables of all prefixes of all configurations form a trie.  They are sums of the fitted
counts, so the data is not read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import uniform01
from mirrortab.operators.core import FitTable, fit_table, lookup
from mirrortab.operators.sampling import interval_lookup, intervals


@dataclass(frozen=True)
class Contexts:
    """Shares of values under every prefix of every configuration."""

    table: FitTable  # feature, config, value, n, lo, hi
    sizes: Mapping[tuple[str, int], tuple[int, int]]  # rows and contexts by feature and length

    def of(self, feature: str) -> tuple[FitTable, int]:
        """Table of a feature, and its number of contexts."""
        sizes = [s for (name, _), s in self.sizes.items() if name == feature]
        rows = sum(r for r, _ in sizes)
        return self._part(self.table.df.where(F.col("feature") == feature).drop("feature"), rows), sum(c for _, c in sizes)

    def seen(self, feature: str, length: int) -> FitTable:
        """Distinct contexts of a length."""
        here = (F.col("feature") == feature) & (F.size("config") == length)
        return self._part(self.table.df.where(here).select("config").distinct(), self.sizes.get((feature, length), (0, 0))[1])

    def _part(self, df: DataFrame, rows: int) -> FitTable:
        return FitTable(df, rows, round(self.table.bytes * rows / max(self.table.rows, 1)))


def fit_contexts(cpt: DataFrame) -> Contexts:
    """From ``(feature, config, value, n)`` of the observed configurations."""
    prefixes = cpt.select("feature", "config", "value", "n", F.explode(F.sequence(F.lit(0), F.size("config"))).alias("_length"))
    counts = prefixes.groupBy("feature", F.slice("config", F.lit(1), F.col("_length")).alias("config"), "value").agg(F.sum("n").alias("n"))
    table = fit_table(intervals(fit_table(counts), ["feature", "config"], ["value"], "n"))
    per_context = table.df.groupBy("feature", "config").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_context.groupBy("feature", F.size("config").alias("length")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contexts")
    ).collect()  # one row a feature and length
    return Contexts(table, {(r["feature"], r["length"]): (r["rows"], r["contexts"]) for r in sizes})


def longest_seen(rows: DataFrame, contexts: Contexts, feature: str, config: str, cards: Sequence[int]) -> DataFrame:
    """Cut the array column ``config`` to its longest prefix that has a table.

    ``cards`` are the cardinalities along the configuration.  From a length whose contexts are
    all there no lookup is needed, so a configuration without gaps costs nothing.
    """
    found = F.lit(None).cast("array<int>")
    out = rows.withColumn("_context", found)
    for length in range(len(cards), -1, -1):
        prefix = F.slice(config, F.lit(1), F.lit(length))
        if length == 0 or contexts.sizes.get((feature, length), (0, 0))[1] == prod(cards[:length]):
            out = out.withColumn("_context", F.coalesce("_context", prefix))
            break
        seen = contexts.seen(feature, length)
        known = FitTable(seen.df.select(F.col("config").alias("_prefix"), F.lit(True).alias("_seen")), seen.rows, seen.bytes)
        # rows that are settled have no key
        keyed = out.withColumn("_prefix", F.when(F.col("_context").isNull(), prefix))
        out = lookup(keyed, known, ["_prefix"], "left").withColumn(
            "_context", F.coalesce("_context", F.when(F.col("_seen"), F.col("_prefix")))
        ).drop("_prefix", "_seen")
    return out.withColumn(config, F.col("_context")).drop("_context")


def draw_backoff(rows: DataFrame, contexts: Contexts, column: str, config: str, key: str, cards: Sequence[int], seed: int) -> DataFrame:
    """Add a code of ``column`` from the table of the longest seen part of ``config``."""
    table, groups = contexts.of(column)
    placed = longest_seen(rows, contexts, column, config, cards).withColumn("_u", uniform01(seed, key, column))
    cells = table.df.select(F.col("config").alias(config), F.col("value").alias("_value"), "lo", "hi")
    drawn = interval_lookup(placed, FitTable(cells, table.rows, table.bytes), [config], "_u", groups=max(groups, 1))
    return drawn.withColumn(column, F.col("_value")).drop(config, "_u", "_value")
