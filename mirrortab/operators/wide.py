"""Structure of wide tables: pairs of columns in chunks, and only those that can be a parent.

Grouping by all columns (as :func:`mirrortab.operators.information.compact` does) moves whole rows, and
combines nothing when there are many columns.  Here the coded rows are stored once, column by column,
and every pass reads the columns of its pairs and shuffles nothing but their counts.  Pairs of few
cells are counted in arrays inside the tasks, so that no row is multiplied by the pairs; the others are
combined map-side.

A pass is not made for every pair.  What two features say about each other given the label is at most
what either of them says at all: ``I(X; Z | Y) <= min(H(X | Y), H(Z | Y))``.  So the candidate parents of a
feature are tried in order of that bound, and a feature is done when its ``k``-th best parent beats
the bound of all that are left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric, xlog2
from mirrortab.operators.core import checkpoint_folder

#: Columns from which on a table is wide.
WIDE = 16
#: Pairs of one pass over the rows; candidates that a feature tries in the first round, doubled in each further one.
PAIRS, ROUND = 1024, 8
#: Results are rounded; a bound rules out only what is smaller by more than that.
MARGIN = 1e-6
NOTHING = 1e-12
FILE_ROWS = 100_000
#: A task counts pairs in arrays of at most so many cells each, and so many together; the others are counted as rows.
PAIR_CELLS, TASK_CELLS = 16_384, 4_000_000


def coded_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns of whole numbers (the label may be any) and a count ``_n`` of 1, stored so that a pass can read some only."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/coded-{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(cols))]  # columns may have any name
    df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names)]).write.option(
        "maxRecordsPerFile", FILE_ROWS).parquet(path)  # so that few input files do not make few tasks
    return spark.read.parquet(path).select(*[F.col(n).alias(c) for c, n in zip(cols, names)], F.lit(1).cast("bigint").alias("_n"))


def _spans(counted: DataFrame, cols: Sequence[str], label: str) -> dict:
    """Least code and number of cells of each column (one for null), and the label's values unless they are many."""
    code = lambda c: F.col(f"`{c}`").cast("bigint")
    row = counted.agg(*[F.struct(F.min(code(c)), F.max(code(c))) for c in cols]).first()
    spans = {c: (low or 0, (high - low if low is not None else -1) + 2) for c, (low, high) in zip(cols, row)}
    values = [r[0] for r in counted.select(F.col(f"`{label}`").cast("string")).distinct().limit(PAIR_CELLS + 1).collect()]
    return {**spans, label: values} if len(values) <= PAIR_CELLS else spans


def _counted_as_rows(counted: DataFrame, pairs: Sequence[tuple[str, str]], some: Sequence[int], label: str) -> DataFrame:
    """``(i, n)``: the count of every cell of some pairs."""
    code = lambda c: F.col(f"`{c}`").cast("bigint")
    used = sorted({c for i in some for c in pairs[i]})
    at = {c: i for i, c in enumerate(used)}
    # one constant lists all pairs: the plan does not grow with them, and no exploded row holds a whole one
    places = ", ".join(f"named_struct('i', {i}, 'a', {at[pairs[i][0]]}, 'b', {at[pairs[i][1]]})" for i in some)
    rows = counted.select(F.col(f"`{label}`").alias("_y"), F.col("_n").alias("n"), F.array(*map(code, used)).alias("_v"))
    cells = F.transform(F.expr(f"array({places})"), lambda p: F.struct(
        p["i"].alias("i"), F.get("_v", p["a"]).alias("va"), F.get("_v", p["b"]).alias("vb")
    ))
    return (
        rows.select("_y", "n", F.explode(cells).alias("_p")).groupBy("_p.i", "_p.va", "_p.vb", "_y")
        .agg(F.sum("n").alias("n")).select("i", "n")
    )


def _counted_in_arrays(
    counted: DataFrame, pairs: Sequence[tuple[str, str]], some: Sequence[int], label: str, spans: dict
) -> DataFrame:
    """The same from an array of counts a pair and task; only cells that occur are shuffled."""
    used = sorted({c for i in some for c in pairs[i]})
    values = spans[label]
    # null is cell 0 of a column
    place = lambda c: F.coalesce(F.col(f"`{c}`").cast("bigint") - F.lit(spans[c][0]) + 1, F.lit(0)).cast("int")
    known = F.array(*[F.lit(v) for v in values if v is not None]).cast("array<string>")
    y = F.coalesce(F.array_position(known, F.col(f"`{label}`").cast("string")), F.lit(0))  # null is 0 here too
    classes = len(values) + 1
    rows = counted.select(*[place(c).alias(f"c{i}") for i, c in enumerate(used)], y.cast("int").alias("y"), F.col("_n").cast("double").alias("n"))
    at = {c: i for i, c in enumerate(used)}
    shapes = [(i, at[pairs[i][0]], at[pairs[i][1]], spans[pairs[i][0]][1], spans[pairs[i][1]][1]) for i in some]

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {i: np.zeros(wa * wb * classes, dtype=np.int64) for i, _, _, wa, wb in shapes}
        for pdf in batches:
            codes = [pdf[f"c{j}"].to_numpy(np.int64) for j in range(len(used))]
            last, n = pdf["y"].to_numpy(np.int64), pdf["n"].to_numpy()
            alone = (n == 1).all()
            with_label = {}
            for i, a, b, wa, wb in shapes:
                if b not in with_label:
                    with_label[b] = codes[b] * classes + last
                cell = codes[a] * (wb * classes) + with_label[b]
                found = np.bincount(cell, minlength=wa * wb * classes) if alone else np.bincount(cell, n, wa * wb * classes)
                totals[i] += found.astype(np.int64)
        for i, total in totals.items():
            cell = np.flatnonzero(total)
            yield pd.DataFrame({"i": np.full(len(cell), i, np.int32), "cell": cell.astype(np.int32), "n": total[cell]})

    return rows.mapInPandas(counts, "i int, cell int, n bigint").groupBy("i", "cell").agg(F.sum("n").alias("n")).select("i", "n")


def pair_information(
    counted: DataFrame, pairs: Sequence[tuple[str, str]], label: str, sums: dict[str, tuple[float, float, float]]
) -> dict[tuple[str, str], float]:
    """Conditional mutual information of some pairs given the label; one pass, a number for each pair comes back.

    ``sums`` has ``(s_xy, s_y, total)`` of every column, as :func:`information.entropy_sums` gives them.
    """
    spans = _spans(counted, sorted({c for pair in pairs for c in pair}), label)
    cells = lambda pair: spans[pair[0]][1] * spans[pair[1]][1] * (len(spans[label]) + 1)
    dense = [i for i, pair in enumerate(pairs) if label in spans and cells(pair) <= PAIR_CELLS]
    long = [i for i in range(len(pairs)) if i not in set(dense)]
    parts, held = [_counted_as_rows(counted, pairs, long, label)] if long else [], []
    for i in dense:
        if held and sum(cells(pairs[j]) for j in held) + cells(pairs[i]) > TASK_CELLS:
            parts.append(_counted_in_arrays(counted, pairs, held, label, spans))
            held = []
        held.append(i)
    if held:
        parts.append(_counted_in_arrays(counted, pairs, held, label, spans))
    triple = reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum(xlog2(F.col("n"))).alias("s"))
    known = [(i, *sums[a], sums[b][0]) for i, (a, b) in enumerate(pairs)]
    spark = counted.sparkSession
    of = F.broadcast(spark.createDataFrame(known, "i int, s_ay double, s_y double, total double, s_by double"))  # PAIRS rows
    cmi = (F.col("s") - F.col("s_ay") - F.col("s_by") + F.col("s_y")) / F.col("total")
    return {pairs[r["i"]]: r["cmi"] for r in triple.join(of, "i").select("i", metric(cmi).alias("cmi")).collect()}


def top_parents(
    counted: DataFrame, order: Sequence[str], label: str, k: int, sums: DataFrame
) -> tuple[list[tuple[str, str, int]], int]:
    """Edges ``(parent, child, rank)`` of the k-dependence network, and the number of pairs that were counted.

    ``order`` lists the features by mutual information with the label; the label is everyone's first
    parent, the others are the ``k`` earlier features with the largest conditional mutual information.
    """
    known = {r["column"]: (r["s_xy"], r["s_y"], float(r["total"])) for r in sums.collect()}  # a row for each column
    entropy = {c: (s_y - s_xy) / total for c, (s_xy, s_y, total) in known.items()}  # H(column | label)
    waiting = {c: sorted(order[:i], key=lambda p: (-entropy[p], p)) for i, c in enumerate(order)}
    found: dict[str, list[tuple[float, str]]] = {c: [] for c in order}
    counted_pairs, tries = 0, ROUND
    for i, c in enumerate(order):
        if entropy[c] < NOTHING:  # it says nothing, whatever the parent
            found[c], waiting[c] = [(0.0, p) for p in order[:i]], []

    def next_of(child: str) -> list[str]:
        left, best = waiting[child], sorted(found[child])
        least = -best[k - 1][0] if len(best) >= k else float("-inf")
        return [p for p in left[:tries] if min(entropy[p], entropy[child]) >= least - MARGIN]

    while True:
        # neighbours in this order share columns, so that a pass reads few
        pairs = sorted((p, c) for c in order for p in next_of(c)) if k > 0 else []
        if not pairs:
            break
        for at in range(0, len(pairs), PAIRS):
            some = pairs[at : at + PAIRS]
            for (parent, child), value in pair_information(counted, some, label, known).items():
                found[child].append((-value, parent))
        counted_pairs += len(pairs)
        for parent, child in pairs:
            waiting[child].remove(parent)
        tries *= 2
    edges = [(label, c, 0) for c in order]
    for child in order:
        edges += [(parent, child, i + 1) for i, (_, parent) in enumerate(sorted(found[child])[:k])]
    return edges, counted_pairs
