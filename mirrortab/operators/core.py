"""Building blocks every operator shares.

* ``fit_table``      - fitted state as a checkpointed table with a measured size
* ``lookup``         - join to a fitted table: broadcast below a checked size, otherwise
                       shuffled with heavy keys salted
* ``running_total``  - cumulative sums over sorted distinct keys without a one-task window
* ``rank_cutoffs``   - hash values at given ranks per group, so that splits and samples are
                       a map-side comparison and never shuffle or sort the wide rows
* ``value_counts``   - all columns' value frequencies in one pass
* ``exact_quantiles``- exact interpolated quantiles of many columns in one pass
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from mirrortab.functions import hash_bucket
from mirrortab.functions.random import HASH_BUCKET_HEX_DIGITS, HASH_HEX_DIGITS

#: A fitted table is broadcast only below both limits (measured, not estimated).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

#: Largest sorted run one window task may hold.
WINDOW_ROWS = 1_000_000

#: Most range partitions of a running total; beyond ``PARTS * WINDOW_ROWS`` rows its tasks grow and spill.
PARTS = 20_000

#: Tables broadcast by one chain of lookups hold at most this much together.
CHAIN_BYTES = 4 * BROADCAST_BYTES

#: Rows of one key that a shuffled lookup leaves together.  Where more than ``HOT_KEYS`` keys
#: can be larger, a ``HOT_KEYS``-th of their rows instead.
HOT_ROWS = 1_000_000
HOT_KEYS = 100_000

#: Rows of one file of a stored table, so that few input files do not make few tasks.
STORED_FILE_ROWS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of this application in reliable storage.

    That is the cluster's ``spark.checkpoint.dir``.  Only a local session without
    one gets a temporary directory; on a cluster a machine-local folder would be lost with
    its machine, so there the setting is required.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        directory = spark.conf.get("spark.checkpoint.dir", None)
        if not directory:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            directory = tempfile.mkdtemp(prefix="mirrortab-checkpoint-")
        context.setCheckpointDir(directory)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, column by column: later passes read the columns they need.

    Types that such files cannot hold are checkpointed as rows.
    """
    if any(t in df.schema.simpleString() for t in ("void", "interval")):
        return checkpointed(df)
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(df.columns))]  # columns may have any name
    named = df.toDF(*names)
    named.write.option("maxRecordsPerFile", STORED_FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(named.schema).parquet(path).toDF(*df.columns)


def free_name(name: str, columns: Sequence[str]) -> str:
    """``name``, longer if a column is called so."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


@dataclass(frozen=True)
class FitTable:
    """Fitted state: a checkpointed DataFrame and its measured size."""

    df: DataFrame
    rows: int
    bytes: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def _size(df: DataFrame) -> list[Column]:
    parts = [F.lit(16 * len(df.columns)).cast("bigint")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, ArrayType):
            parts.append(F.greatest(F.size(c), F.lit(0)) * 40)
    return [F.count(F.lit(1)).alias("rows"), F.sum(reduce(lambda a, b: a + b, parts)).alias("bytes")]


def measure(df: DataFrame) -> FitTable:
    """Measure a table that is already stored."""
    row = df.agg(*_size(df)).first()
    return FitTable(df, int(row["rows"]), int(row["bytes"] or 0))


def fit_table(df: DataFrame) -> FitTable:
    """Store a table, then measure it.

    Not in the same pass: a session that has observed a query can no longer send MLlib's logistic
    models to tasks.
    """
    return measure(checkpointed(df))


def sized_broadcast(df: DataFrame, table: FitTable) -> DataFrame:
    """``df`` with a broadcast hint when ``table``, which bounds it, is small enough."""
    return F.broadcast(df) if table.broadcastable else df


def _known(on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in on])


def heavy_keys(fact: DataFrame, keys: Sequence[Sequence[str]]) -> list[DataFrame]:
    """``(_key_hash, _salts)`` of the heavy keys of each key column list, from one pass over ``fact``.

    Counted and named by hash, so a table holds at most ``HOT_KEYS`` rows of two numbers
    however long the keys are.  Keys that share a hash share their salts, which is harmless.
    The number of salts follows the key's count: no salted part has over ``HOT_ROWS`` rows, or
    over a ``HOT_KEYS``-th of all heavy rows where that is more.
    """
    hashed = [
        F.struct(F.lit(i).alias("_key"), F.when(_known(on), F.xxhash64(*[F.col(f"`{c}`") for c in on])).alias("_key_hash"))
        for i, on in enumerate(keys)
    ]
    counts = (
        fact.select(F.inline(F.array(*hashed))).where(F.col("_key_hash").isNotNull())
        .groupBy("_key", "_key_hash").agg(F.count(F.lit(1)).alias("_n"))
    )
    heavy = checkpointed(counts.where(F.col("_n") > HOT_ROWS))
    sums = {r["_key"]: r["n"] for r in heavy.groupBy("_key").agg(F.sum("_n").alias("n")).collect()}
    tables = []
    for i in range(len(keys)):
        step = max(HOT_ROWS, sums.get(i, 0) // HOT_KEYS)
        mine = heavy.where((F.col("_key") == i) & (F.col("_n") > step))
        tables.append(mine.select("_key_hash", F.ceil(F.col("_n") / step).cast("bigint").alias("_salts")))
    return tables


def within_budget(tables: Sequence[FitTable]) -> list[bool]:
    """Which tables of a chain of lookups to broadcast: the smallest first, up to ``CHAIN_BYTES``."""
    chosen, left = [False] * len(tables), CHAIN_BYTES
    for i in sorted(range(len(tables)), key=lambda i: tables[i].bytes):
        if tables[i].broadcastable and tables[i].bytes <= left:
            chosen[i], left = True, left - tables[i].bytes
    return chosen


def lookup(
    fact: DataFrame, table: FitTable, on: Sequence[str], how: str = "left", heavy: DataFrame | None = None
) -> DataFrame:
    """Join rows to a fitted table on equal keys.

    Small tables are broadcast, unless ``heavy`` is given.  Otherwise rows are shuffled and those
    of heavy keys spread: they get a salt, and their table rows one copy per salt.  The salt comes
    from the row and its input partition, so a retried task repeats it.  ``heavy`` is a table of
    :func:`heavy_keys`; a caller with several lookups counts them together beforehand.
    """
    on = list(on)
    if heavy is None:
        if table.broadcastable:
            return fact.join(F.broadcast(table.df), on, how)
        heavy = heavy_keys(fact, [on])[0]
    known, heavy = _known(on), F.broadcast(heavy)
    spread = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint"))
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns], F.spark_partition_id())
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    # of the same types, as the hash depends on them
    table_key = F.xxhash64(*[F.col(f"`{c}`").try_cast(fact.schema[c].dataType) for c in on])
    salted_fact = fact.withColumns({"_mix": mixed, "_key_hash": key}).join(heavy, "_key_hash", "left").withColumn(
        # rows without a key find nothing wherever they go, so they go everywhere
        "_salt", F.when(known, F.pmod("_mix", spread)).otherwise(F.col("_mix")).cast("bigint")
    ).drop("_mix", "_salts", "_key_hash")
    salted_table = table.df.withColumn("_key_hash", table_key).join(heavy, "_key_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), spread - 1))
    ).drop("_salts", "_key_hash")
    return salted_fact.join(salted_table, [*on, "_salt"], how).drop("_salt")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table that has one row by construction (a total, a template)."""
    key = "_scalar_key"
    return df.withColumn(key, F.lit(0)).join(F.broadcast(one_row.withColumn(key, F.lit(0))), key).drop(key)


def running_total(
    table: FitTable | DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    cum: str = "cum",
    total: str = "total",
) -> DataFrame:
    """Add the inclusive running sum of ``value`` per group, and the group's sum.

    ``(group, order)`` must be distinct: callers aggregate first, so that no key is heavy.
    Up to ``WINDOW_ROWS`` rows a plain window does it.  Beyond that rows are range
    partitioned by ``(group, order)``, summed per partition, and each partition adds the sum
    of the ones before it: one group can be as large as the whole table.
    """
    if isinstance(table, DataFrame):
        table = fit_table(table)
    df, group = table.df, list(group)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    whole = Window.partitionBy(*group)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if table.rows <= WINDOW_ROWS:
        run = whole.orderBy(*order_cols).rowsBetween(*upto)
        return df.withColumn(cum, F.sum(value).over(run)).withColumn(total, F.sum(value).over(whole))

    parts = min(math.ceil(table.rows / WINDOW_ROWS) * 2, PARTS)
    ranged = checkpointed(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *order_cols).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    sums = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.sum("_sum").over(whole) * 0).alias("_before"),
        F.sum("_sum").over(whole).alias(total),
    )
    run = Window.partitionBy(*group, "_part").orderBy(*order_cols).rowsBetween(*upto)
    local = ranged.withColumn(cum, F.sum(value).over(run))
    return (
        local.join(offsets, [*group, "_part"], "inner")
        .withColumn(cum, F.col(cum) + F.col("_before"))
        .drop("_part", "_before")
    )


def hash_histogram(rows: DataFrame, group: Sequence[str], hashed: str) -> DataFrame:
    """``(group..., _bucket, _n)``: rows per leading digits of the hash, combined map-side.

    Also the cheapest source of the group sizes: their counts are sums over its rows.
    """
    bucketed = rows.withColumn("_bucket", hash_bucket(hashed, HASH_BUCKET_HEX_DIGITS))
    return checkpointed(bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")))


def rank_cutoffs(
    rows: DataFrame, group: Sequence[str], hashed: str, targets: DataFrame, histogram: DataFrame | None = None
) -> DataFrame:
    """Hash value at each wanted 1-based rank of the hash order within a group.

    ``rows`` holds the group columns and the unique row hash; ``targets`` holds the group
    columns, ``cut`` (an id) and ``rank``.  Returns ``group..., cut, cut_hash``.

    The hash order is uniform, so the histogram on its leading digits tells which bucket
    holds each rank.  A bucket of more than ``WINDOW_ROWS`` rows is opened by further digits;
    only rows of the last buckets are ranked exactly.  A group with a third of all rows is
    therefore spread over its buckets and only one of them per wanted rank is sorted.
    """
    group = list(group)
    hist = hash_histogram(rows, group, hashed) if histogram is None else histogram
    wanted = targets.where(F.col("rank") >= 1)

    def located(counts: DataFrame, parent: list[str]) -> FitTable:
        # at most HASH_BUCKETS rows per group and parent, so the window is bounded
        run = Window.partitionBy(*group, *parent).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        upto = counts.withColumn("_cum", F.col("_from") + F.sum("_n").over(run))
        before = upto.withColumn("_before", F.col("_cum") - F.col("_n"))
        hits = before.join(wanted, group, "inner").where(
            (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_cum"))
        )
        return fit_table(hits.select(*group, "cut", "rank", "_bucket", "_before", "_n"))

    def inside(found: FitTable, digits: int) -> DataFrame:
        buckets = found.df.select(*group, "_bucket", "_before").distinct()
        return rows.withColumn("_bucket", hash_bucket(hashed, digits)).join(
            sized_broadcast(buckets, found), [*group, "_bucket"], "inner"
        )

    digits = HASH_BUCKET_HEX_DIGITS
    found = located(hist.withColumn("_from", F.lit(0).cast("bigint")), [])
    while digits < HASH_HEX_DIGITS and (found.df.agg(F.max("_n")).first()[0] or 0) > WINDOW_ROWS:
        opened = inside(found, digits).withColumnsRenamed({"_bucket": "_parent", "_before": "_from"})
        digits += HASH_BUCKET_HEX_DIGITS
        finer = opened.groupBy(*group, "_parent", "_from", hash_bucket(hashed, digits).alias("_bucket"))
        found = located(finer.agg(F.count(F.lit(1)).alias("_n")), ["_parent"])
    order = Window.partitionBy(*group, "_bucket").orderBy(hashed)
    ranked = inside(found, digits).select(
        *group, F.col(hashed).alias("cut_hash"),
        (F.row_number().over(order) + F.col("_before")).alias("rank"),
    )
    return ranked.join(
        sized_broadcast(found.df.select(*group, "cut", "rank"), found), [*group, "rank"], "inner"
    ).select(*group, "cut", "cut_hash")


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_type: str = "string") -> DataFrame:
    """Long form ``(keep..., column, value)``: one pass over the rows for all columns."""
    cells = [F.col(f"`{c}`").cast(as_type).alias(c) for c in cols]
    narrow = df.select(*keep, *cells)
    return narrow.unpivot(list(keep), [F.col(f"`{c}`") for c in cols], "column", "value")


def row_count(weight: str | None = None) -> Column:
    """Number of rows; with ``weight`` each stands for as many as that column says."""
    return F.count(F.lit(1)) if weight is None else F.sum(f"`{weight}`")


def value_counts(
    df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_type: str = "string", weight: str | None = None
) -> DataFrame:
    """``(keep..., column, value, n)``, combined map-side; nulls are left out."""
    weights = [weight] if weight else []
    long = unpivot(df, cols, [*keep, *weights], as_type).where(F.col("value").isNotNull())
    return long.groupBy(*keep, "column", "value").agg(row_count(weight).alias("n"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], counts: DataFrame | None = None
) -> DataFrame:
    """Exact quantiles by linear interpolation: ``(column, i, p, value)``.

    ``i`` is the position of ``p`` in ``probabilities``.  Works on distinct values with
    their counts and a distributed running total instead of the built-in ``percentile``,
    whose single aggregation buffer holds every distinct value of a column.
    """
    probabilities = [float(p) for p in probabilities]
    if counts is None:
        counts = value_counts(df, cols, as_type="double")
    cumulative = running_total(counts, ["column"], ["value"], "n")
    last = F.col("total") - 1
    first_index, next_index = F.col("cum") - F.col("n"), F.col("cum")
    steps = len(probabilities) - 1
    if steps > 8 and probabilities == [i / steps for i in range(steps + 1)]:
        # evenly spaced: only the neighbouring grid points can fall on this value
        near = lambda at: F.floor(at.cast("double") / F.greatest(last, F.lit(1)) * steps)
        candidates = F.sequence(
            F.greatest(near(first_index - 1) - 1, F.lit(0)).cast("int"),
            F.least(near(next_index) + 1, F.lit(steps)).cast("int"),
        )
        probability = lambda i: i / F.lit(steps)
    else:
        candidates = F.sequence(F.lit(0), F.lit(steps)) if steps else F.array(F.lit(0))
        table = F.array(*[F.lit(p) for p in probabilities])
        probability = lambda i: F.element_at(table, i + 1)
    position = lambda i: probability(i) * last
    covers = lambda index: (index >= first_index) & (index < next_index)
    hits = cumulative.select(
        "column", "value", "total", first_index.alias("_from"), next_index.alias("_to"),
        F.explode(
            F.filter(
                candidates,
                lambda i: covers(F.floor(position(i))) | covers(F.ceil(position(i))),
            )
        ).alias("i"),
    )
    at = probability(F.col("i")) * (F.col("total") - 1)
    inside = lambda index: (index >= F.col("_from")) & (index < F.col("_to"))
    return (
        hits.groupBy("column", "i")
        .agg(
            F.max(F.when(inside(F.floor(at)), F.col("value"))).alias("_a"),
            F.max(F.when(inside(F.ceil(at)), F.col("value"))).alias("_b"),
            F.max(at - F.floor(at)).alias("_w"),
        )
        .select(
            "column", "i", probability(F.col("i")).alias("p"),
            (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("value"),
        )
    )
