"""k-dependence Bayes network: fit, sample, conditional sample, save and load.

Fitting is: compact to distinct rows in one pass, encode these, and read every statistic from that
compacted table.  Sampling is ``spark.range(n)`` and one interval lookup per feature in
topological order; while the probability tables are broadcastable there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, StringType

from mirrortab.functions import uniform01
from mirrortab.functions.random import number_of, uniform_digits
from mirrortab.operators.clean import missing_text
from mirrortab.operators.core import FitTable, checkpointed, fit_table, measure
from mirrortab.operators.cpt import conditional_counts
from mirrortab.operators.encode import Dictionary, column_sizes, decode, encode, fit_dictionary
from mirrortab.operators.information import (
    compact, conditional_mutual_information, entropy_sums, feature_parents, kdb_edges, mi_ranking, mutual_information,
)
from mirrortab.operators.sampling import digits_depth, digits_lookup, interval_lookup, intervals
from mirrortab.operators.wide import WIDE, coded_rows, top_parents
from mirrortab.plans.backoff import Contexts, draw_backoff, fit_contexts
from mirrortab.plans.condition import NEVER_SEEN, Conditional, conditionals, config_of  # noqa: F401

CHECKPOINT_EVERY = 50  # features sampled between lineage cuts


@dataclass(frozen=True)
class KdbModel:
    """Fitted network: everything is a table except the short lists of names."""

    dictionary: Dictionary
    target: str
    features: tuple[str, ...]  # column order of the training table
    order: tuple[str, ...]  # topological: by mutual information with the label
    parents: Mapping[str, list[str]]  # without the label
    cpt: FitTable  # feature, config, value, n, p, lo, hi
    groups: Mapping[str, tuple[int, int]]  # rows and configurations per feature
    rows: int

    @property
    def cards(self) -> dict[str, int]:
        return {c: self.dictionary.cardinality(c) for c in [*self.features, self.target]}

    @property
    def row_key(self) -> str:
        """Name of the sample's row number: ``id``, or a longer name if a column is called so."""
        name = "id"
        while name in (*self.features, self.target):
            name = f"row_{name}"
        return name

    def table(self, feature: str) -> FitTable:
        rows, _ = self.groups.get(feature, (0, 0))
        part = self.cpt.df.where(F.col("feature") == feature).drop("feature")
        return FitTable(part, rows, rows * 96)

    def config(self, feature: str) -> Column:
        """Parents' codes of a feature as the key of its probability table."""
        names = [] if feature == self.target else [self.target, *self.parents[feature]]
        return F.array(*[F.col(f"`{c}`").cast("int") for c in names]).cast("array<int>")

    def save(self, path: str) -> None:
        spark = self.cpt.df.sparkSession
        self.dictionary.df.write.mode("errorifexists").parquet(f"{path}/dictionary")
        self.cpt.df.write.mode("errorifexists").parquet(f"{path}/cpt")
        names = [
            (c, i, self.order.index(c) if c in self.order else -1, self.parents.get(c, []), self.dictionary.types[c], self.rows)
            for i, c in enumerate([*self.features, self.target])
        ]
        schema = "column string, pos int, rank int, parents array<string>, type string, n_rows bigint"
        spark.createDataFrame(names, schema).write.mode("errorifexists").parquet(f"{path}/columns")


def _group_sizes(cpt: DataFrame) -> dict[str, tuple[int, int]]:
    per_config = cpt.groupBy("feature", "config").agg(F.count(F.lit(1)).alias("n"))
    rows = per_config.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("configs")).collect()
    return {r["feature"]: (r["rows"], r["configs"]) for r in rows}


def load_kdb(spark: SparkSession, path: str) -> KdbModel:
    names = spark.read.parquet(f"{path}/columns").orderBy("pos").collect()
    table = spark.read.parquet(f"{path}/dictionary")
    sizes = column_sizes(table)
    features, target = [r["column"] for r in names[:-1]], names[-1]["column"]
    cpt = measure(spark.read.parquet(f"{path}/cpt"))
    return KdbModel(
        dictionary=Dictionary(table, sizes, {r["column"]: r["type"] for r in names}),
        target=target,
        features=tuple(features),
        order=tuple(r["column"] for r in sorted(names[:-1], key=lambda r: r["rank"])),
        parents={r["column"]: list(r["parents"]) for r in names[:-1]},
        cpt=cpt,
        groups=_group_sizes(cpt.df),
        rows=names[-1]["n_rows"],
    )


def _as_grouped(column: str, kind: DataType) -> Column:
    """A column by which rows are grouped: values that can be equal but have different texts go by their text."""
    c = F.col(f"`{column}`")
    return c if isinstance(kind, (IntegralType, StringType, BooleanType, DateType)) else missing_text(c)


def fit_kdb(df: DataFrame, target: str | None = None, k: int = 2, edges: Sequence[tuple[str, str]] | None = None) -> KdbModel:
    """Fit on a table of discrete columns; ``edges`` replaces the learned structure."""
    target = target or df.columns[-1]
    features = [c for c in df.columns if c != target]
    columns = [*features, target]
    if len(columns) > WIDE:
        dictionary = fit_dictionary(df, columns)
        counted = coded_rows(encode(df.select(*columns), dictionary, columns), columns)
    else:
        types = {c: df.schema[c].dataType for c in columns}
        distinct = compact(df.select(*[_as_grouped(c, t).alias(c) for c, t in types.items()]), columns)
        dictionary = fit_dictionary(distinct, columns, weight="_n", types=types)
        counted = checkpointed(encode(distinct, dictionary, columns))
    rows = int(counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    sums = entropy_sums(counted, features, target)
    ranking = mi_ranking(mutual_information(counted, features, target, sums))
    order = [r["column"] for r in ranking.orderBy("rank").collect()]
    if edges is None:
        if len(columns) > WIDE:
            edges = [(parent, child) for parent, child, _ in top_parents(counted, order, target, k, sums)[0]]
        elif k > 0:
            cmi = conditional_mutual_information(counted, features, target, sums)
            edges = [(r["parent"], r["child"]) for r in kdb_edges(ranking, cmi, target, k).collect()]
        else:
            edges = [(target, c) for c in features]
    else:
        order = _topological(edges, features, order, target)
    parents = feature_parents(edges, target, features)
    counts = conditional_counts(counted, parents, target).unionByName(
        conditional_counts(counted, {target: []}, None)
    )
    shares = intervals(fit_table(counts), ["feature", "config"], ["value"], "n")
    table = fit_table(shares.withColumn("p", F.col("hi") - F.col("lo")))
    return KdbModel(
        dictionary, target, tuple(features), tuple(order), parents, table, _group_sizes(table.df), rows
    )


def _topological(edges, features, order, target) -> list[str]:
    placed: list[str] = []
    waiting = list(order)
    while waiting:
        ready = [c for c in waiting if all(p in placed or p == target for p, child in edges if child == c)]
        if not ready:
            raise ValueError("the given edges have a cycle")
        placed.append(ready[0])
        waiting.remove(ready[0])
    return placed


#: Configurations are numbered in a signed 64-bit number.
NUMBERED = 2**62


def _draw(rows: DataFrame, model: KdbModel, column: str, seed: int, known: bool = True) -> DataFrame:
    """Add a sampled code of ``column`` given its parents' codes on the row.

    A configuration never seen in training draws uniformly from the column's codes.  ``known`` says that
    the parents' codes are the dictionary's, so that a configuration can go by one number.
    """
    n_rows, configs = model.groups.get(column, (0, 1))
    card = max(model.cards[column], 1)
    names = [] if column == model.target else [model.target, *model.parents[column]]
    depth = digits_depth(FitTable(model.cpt.df, n_rows, n_rows * 96), configs)
    if known and depth is not None and prod(max(model.cards[c], 1) for c in names) < NUMBERED:
        number = lambda code: reduce(
            lambda total, c: total * F.lit(max(model.cards[c], 1)) + code(c), names, F.lit(0).cast("bigint")
        )
        cells = model.table(column).df.select(
            number(lambda c: F.element_at("config", names.index(c) + 1)).alias("_config"), F.col("value").alias("_value"), "lo", "hi"
        )
        keyed = rows.withColumns({
            "_config": number(lambda c: F.col(f"`{c}`")), "_digits": uniform_digits(seed, model.row_key, column)
        })
        # without parents the digits are all there is to join on
        drawn = digits_lookup(keyed, FitTable(cells, n_rows, n_rows * 96), "_config", "_digits", depth if names else max(depth, 1))
        uniform = F.floor(number_of(F.col("_digits")) * card).cast("int")
        return drawn.withColumn(column, F.coalesce(F.col("_value"), uniform)).drop("_config", "_digits", "_value")
    keyed = rows.withColumn("_config", model.config(column)).withColumn("_u", uniform01(seed, model.row_key, column))
    cells = model.table(column).df.select(F.col("config").alias("_config"), F.col("value").alias("_value"), "lo", "hi")
    drawn = interval_lookup(keyed, FitTable(cells, n_rows, n_rows * 96), ["_config"], "_u", groups=configs)
    uniform = F.floor(F.col("_u") * card).cast("int")
    return drawn.withColumn(column, F.coalesce(F.col("_value"), uniform)).drop("_config", "_u", "_value")


def _draw_given(rows: DataFrame, model: KdbModel, column: str, given: Conditional, seed: int) -> DataFrame:
    """Add a code of ``column`` drawn from its table under the fixed values."""
    keyed = rows.withColumn("_config", config_of(given)).withColumn("_u", uniform01(seed, model.row_key, column))
    drawn = interval_lookup(keyed, given.table, ["_config"], "_u", groups=given.configs)
    return drawn.withColumn(column, F.col("_value")).drop("_config", "_u", "_value")


def sample_codes(
    model: KdbModel, spark: SparkSession, n: int | None = None, seed: int = 42, fixed: Mapping[str, int] | None = None,
    contexts: Contexts | None = None,
) -> DataFrame:
    """The row key (``id`` unless a column is called so) and one code column per table column;
    ``fixed`` columns are not drawn, the others are drawn given them.

    With ``contexts`` a configuration never seen draws from its longest part that was seen, the last
    parent dropped first and the label last; without, uniformly from the column's codes.
    """
    fixed = dict(fixed or {})
    if contexts is not None and set(fixed) - {model.target}:
        raise ValueError("the exact conditional tables have no back-off: fix the label only")
    given = conditionals(model, fixed) if set(fixed) - {model.target} else {}
    known = all(0 <= int(v) < model.cards[c] for c, v in fixed.items())
    rows = spark.range(model.rows if n is None else n).withColumnRenamed("id", model.row_key)
    for i, column in enumerate([model.target, *model.order]):
        if column in fixed:
            rows = rows.withColumn(column, F.lit(int(fixed[column])))
        elif column in given:
            rows = _draw_given(rows, model, column, given[column], seed)
        elif contexts is not None:
            cards = [] if column == model.target else [model.cards[c] for c in [model.target, *model.parents[column]]]
            keyed = rows.withColumn("_config", model.config(column))
            rows = draw_backoff(keyed, contexts, column, "_config", model.row_key, cards, seed)
        else:
            rows = _draw(rows, model, column, seed, known)
        if i and i % CHECKPOINT_EVERY == 0:
            rows = checkpointed(rows)
    return rows.select(model.row_key, *model.features, model.target)


def decode_rows(model: KdbModel, coded: DataFrame) -> DataFrame:
    return decode(coded, model.dictionary, [*model.features, model.target])


def sample_kdb(model: KdbModel, spark: SparkSession, n: int | None = None, seed: int = 42, backoff: bool = False) -> DataFrame:
    """Synthetic rows with original values, and their ``id``."""
    contexts = fit_contexts(model.cpt.df) if backoff else None
    return decode_rows(model, sample_codes(model, spark, n, seed, contexts=contexts))


def code_of(model: KdbModel, column: str, value: object) -> int:
    row = (
        model.dictionary.df.where((F.col("column") == column) & (F.col("value") == F.lit(value).cast("string")))
        .select("code").first()
    )
    if row is None:
        raise ValueError(f"{value!r} is not a known value of {column!r}")
    return int(row["code"])


def sample_conditional(
    model: KdbModel, spark: SparkSession, n: int, conditional: Mapping[str, object], seed: int = 42
) -> DataFrame:
    """Rows given fixed column values, drawn from the network's exact conditional distribution."""
    fixed = {c: code_of(model, c, v) for c, v in conditional.items()}
    return decode_rows(model, sample_codes(model, spark, n, seed, fixed))
