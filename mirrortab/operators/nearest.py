"""Distance to the closest real record, exact, without comparing all pairs.

The mixed space is Euclidean: standardised numbers, and categories as one-hot blocks, where
two different values of a column are sqrt(2) apart.  So the triangle inequality holds and
whole groups of real rows can be ruled out:

1. equal rows are combined with their multiplicity, and a synthetic row that equals a real
   one is settled by an equi-join;
2. a bounded sample of real rows is made into a tree of pivots: a node deals its points to
   the nearest of ``FANOUT`` pivots, down to leaves.  Every real row descends to its leaf, and
   each node knows the least and largest distance of its rows from its pivot;
3. each open synthetic row visits its own leaf, which gives an upper bound, and then its other
   leaves best first, in rounds: those with the smallest lower bounds, 4 at first and 4 times
   more in each round, until no bound is below the best distance.

The tree is broadcast (``MAX_PIVOTS`` points at most); whole branches are ruled out at their
root, so that a row looks at a few pivots of each level instead of all.  A visit is a co-grouped
block of at most ``BLOCK_ROWS`` x ``BLOCK_ROWS`` rows: large leaves and popular leaves are cut into
blocks, and the minimum over blocks is the answer.  Only one number per row and block is emitted.
In few dimensions the distances per row grow with the logarithm of the rows; in many, bounds rule
out less and a row visits many leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric, try_double
from mirrortab.operators.clean import is_numeric, medians
from mirrortab.operators.core import checkpointed, exact_quantiles, free_name, row_count
from mirrortab.operators.divergence import sides
from mirrortab.operators.encode import encode, fit_dictionary
from mirrortab.operators.scalers import fit_moments, standardize

MAX_PIVOTS = 65_536
FANOUT = 16
#: Real rows for each point of the sample, and points of the sample that a leaf holds at most.
ROWS_PER_POINT, LEAF_POINTS = 64, 4
#: Leaves that a row visits in the first round after its own; each further round has as many times more.
FIRST_VISITS = 4
BLOCK_ROWS = 4096
_CELLS = 4_000_000  # distances a task holds at a time
_SLACK = 1e-9


def mixed_points(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Distinct points ``(nums, cats, n)`` of both tables in the space fitted on the real one.

    Rows are read once: equal ones are combined before anything is fitted.
    """
    cols = list(cols)
    numeric = [c for c in cols if is_numeric(real.schema[c].dataType)]
    categorical = [c for c in cols if c not in numeric]
    n = free_name("_n", cols)
    both = sides(real, synth, [*cols, *([weight] if weight else [])], ("real", "synth"))
    both = checkpointed(both.groupBy("side", *[F.col(f"`{c}`") for c in cols]).agg(row_count(weight).alias(n)))
    real_rows = both.where(F.col("side") == "real")
    if categorical:
        both = encode(both, fit_dictionary(both, categorical), categorical)
    if numeric:
        both = both.withColumns({c: try_double(f"`{c}`") for c in numeric})
        gaps = both.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in numeric]).first()
        fills = medians(real_rows, [c for c in numeric if gaps[c]], n)
        # a column without any real number has no scale and no fill: it says nothing about distance
        numeric = [c for c in numeric if not gaps[c] or fills.get(c) is not None]
        both = both.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fills.items() if v is not None})
        moments = fit_moments(both.where(F.col("side") == "real"), numeric, n) if numeric else {}
        both = both.withColumns({c: standardize(F.col(f"`{c}`"), moments[c]) for c in numeric})
    nums = F.array(*[F.col(f"`{c}`") for c in numeric]).cast("array<double>")
    cats = F.array(*[F.col(f"`{c}`") for c in categorical]).cast("array<int>")
    points = checkpointed(
        both.select("side", nums.alias("nums"), cats.alias("cats"), F.col(f"`{n}`").alias("n"))
        .groupBy("side", "nums", "cats").agg(F.sum("n").alias("n"))
    )
    side = lambda s: points.where(F.col("side") == s).drop("side")
    return side("real"), side("synth")


def _matrix(column: pd.Series, dtype) -> np.ndarray:
    rows = column.tolist()
    width = len(rows[0]) if rows else 0
    return np.array(rows, dtype=dtype).reshape(len(rows), width)


def _step(width: int) -> int:
    return max(1, _CELLS // max(width, 1))


def _distances(a_num, a_cat, b_num, b_cat) -> np.ndarray:
    """Distance matrix, from differences so that near rows keep their precision."""
    square = np.zeros((len(a_num), len(b_num)))
    for k in range(a_num.shape[1]):
        square += (a_num[:, k, None] - b_num[None, :, k]) ** 2
    for k in range(a_cat.shape[1]):
        square += 2.0 * (a_cat[:, k, None] != b_cat[None, :, k])
    return np.sqrt(square)


@dataclass
class PivotTree:
    """Nodes in order of their numbers; children of a node are consecutive.  Node 0 is the root."""

    num: np.ndarray  # the nodes' pivots (the root's is not used)
    cat: np.ndarray
    first: np.ndarray  # first child, 0 for a leaf
    count: np.ndarray  # children
    between: list[np.ndarray]  # distances between the children's pivots, by node
    low: np.ndarray | None = None  # distances of a node's real rows from its pivot
    high: np.ndarray | None = None

    def descend(self, num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The leaf of every point, and ``(rows, nodes, distances)`` of each level on the way."""
        at, path = np.zeros(len(num), np.int64), []
        rows = np.arange(len(num)) if self.count[0] else np.empty(0, np.int64)
        while len(rows):
            near = np.empty(len(rows))
            for node in np.unique(at[rows]):
                of = np.flatnonzero(at[rows] == node)
                kids = slice(self.first[node], self.first[node] + self.count[node])
                step = _step(self.count[node])
                for s in range(0, len(of), step):
                    some = of[s : s + step]
                    d = _distances(num[rows[some]], cat[rows[some]], self.num[kids], self.cat[kids])
                    best = d.argmin(axis=1)
                    near[some] = d[np.arange(len(some)), best]
                    at[rows[some]] = self.first[node] + best
            path.append((rows, at[rows].copy(), near))
            rows = rows[self.count[at[rows]] > 0]
        return at, path

    def within(self, num: np.ndarray, cat: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, bound)`` of all leaves that could hold something nearer than ``best``."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        rows, nodes, bounds = np.arange(len(num)), np.zeros(len(num), np.int64), np.zeros(len(num))
        while len(rows):
            nexts = []
            for node in np.unique(nodes):
                of = np.flatnonzero(nodes == node)
                if not self.count[node]:
                    out.append((rows[of], nodes[of], bounds[of]))
                    continue
                kids = slice(self.first[node], self.first[node] + self.count[node])
                step = _step(self.count[node])
                for s in range(0, len(of), step):
                    some = of[s : s + step]
                    r = rows[some]
                    d = _distances(num[r], cat[r], self.num[kids], self.cat[kids])
                    nearest = d.argmin(axis=1)
                    apart = self.between[node][nearest]
                    near = d[np.arange(len(d)), nearest][:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart > 0, (d**2 - near**2) / (2 * apart), 0.0)
                    bound = np.maximum(np.maximum(d - self.high[kids], self.low[kids] - d), np.maximum(plane, bounds[some][:, None]))
                    i, c = np.nonzero(bound * (1 - _SLACK) - _SLACK <= best[r][:, None])
                    nexts.append((r[i], self.first[node] + c, bound[i, c]))
            rows, nodes, bounds = (np.concatenate(c) for c in zip(*nexts)) if nexts else (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out))


def pivot_tree(num: np.ndarray, cat: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF_POINTS) -> PivotTree:
    """A tree over sample points, in order of a hash, whose first points are the pivots of the root's children."""
    pivots, first, count, between, waiting = [-1], [0], [0], [np.empty((0, 0))], [(0, np.arange(len(num)))]
    while waiting:
        node, of = waiting.pop(0)
        if len(of) <= leaf and node or not len(of):
            continue
        chosen = of[:fanout]
        d = _distances(num[of], cat[of], num[chosen], cat[chosen])
        to = d.argmin(axis=1)
        if node and (to == to[0]).all():
            continue  # all in one place
        first[node], count[node] = len(pivots), len(chosen)
        between[node] = d[: len(chosen)]
        for c, p in enumerate(chosen):
            waiting.append((len(pivots), of[to == c]))
            pivots.append(p)
            first.append(0)
            count.append(0)
            between.append(np.empty((0, 0)))
    at = np.array(pivots)
    return PivotTree(num[at], cat[at], np.array(first), np.array(count), between)


def _to_leaves(points: DataFrame, tree: PivotTree, schema: str) -> DataFrame:
    """Add the leaf ``cell``, the distance ``near`` from its pivot, and ``path``: all nodes and distances on the way."""
    names = points.columns
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            cell, path = shared.value.descend(_matrix(pdf["nums"], float), _matrix(pdf["cats"], np.int32))
            near, way = np.zeros(len(pdf)), [[] for _ in range(len(pdf))]
            for rows, nodes, distances in path:
                near[rows] = distances
                for r, node, d in zip(rows.tolist(), nodes.tolist(), distances.tolist()):
                    way[r].append({"node": node, "d": d})
            yield pdf.assign(cell=cell.astype(np.int32), near=near, path=way)[names + ["cell", "near", "path"]]

    return points.mapInPandas(assign, f"{schema}, cell int, near double, path array<struct<node:int,d:double>>")


def _next_visits(open_rows: DataFrame, shared, limit: int, schema: str) -> DataFrame:
    """The ``limit`` leaves of each row with the smallest bounds among those not visited yet.

    Visited are a row's own leaf and all up to ``(seen, seen_cell)`` in order of bound and number.  ``last`` tells
    that no other leaf is left.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            num, cat = _matrix(pdf["nums"], float), _matrix(pdf["cats"], np.int32)
            row, leaf, bound = shared.value.within(num, cat, pdf["best"].to_numpy())
            seen, cell = pdf["seen"].to_numpy()[row], pdf["seen_cell"].to_numpy()[row]
            new = (leaf != pdf["cell"].to_numpy()[row]) & ((bound > seen) | ((bound == seen) & (leaf > cell)))
            row, leaf, bound = row[new], leaf[new], bound[new]
            order = np.lexsort((leaf, bound, row))
            row, leaf, bound = row[order], leaf[order], bound[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            left = np.bincount(row, minlength=len(pdf))[row]
            now = place < limit
            part = pdf.iloc[row[now]]
            yield part.assign(
                cell=leaf[now].astype(np.int32), bound=bound[now], last=left[now] <= limit
            )[["sid", "nums", "cats", "cell", "bound", "last"]]

    return open_rows.select("sid", "nums", "cats", "cell", "best", "seen", "seen_cell").mapInPandas(expand, schema)


def _block_minimum(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"sid": pd.Series(dtype="object"), "d": pd.Series(dtype="float64")})
    a_num, a_cat = _matrix(left["nums"], float), _matrix(left["cats"], np.int32)
    b_num, b_cat = _matrix(right["nums"], float), _matrix(right["cats"], np.int32)
    step = _step(len(right))
    found = [
        _distances(a_num[at : at + step], a_cat[at : at + step], b_num, b_cat).min(axis=1)
        for at in range(0, len(left), step)
    ]
    return pd.DataFrame({"sid": left["sid"].to_numpy(), "d": np.concatenate(found)})


def _visit_cells(visits: DataFrame, real: DataFrame, real_counts: DataFrame, distances=None) -> DataFrame:
    """``(sid, d)``: nearest real row inside the visited cells."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    plan = checkpointed(  # at most MAX_PIVOTS rows
        visits.groupBy("cell").agg(F.count(F.lit(1)).alias("_nv"))
        .join(F.broadcast(real_counts), "cell", "inner")
        .select("cell", blocks("_nv").alias("_vb"), blocks("n_real").alias("_rb"))
    )
    sized = F.broadcast(plan)
    hashed = F.abs(F.xxhash64("nums", "cats"))
    upto = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    left = visits.join(sized, "cell").withColumn("vb", (F.abs(F.xxhash64("sid")) % F.col("_vb")).cast("int")).withColumn("rb", upto("_rb"))
    right = real.join(sized, "cell").withColumn("rb", (hashed % F.col("_rb")).cast("int")).withColumn("vb", upto("_vb"))
    left = left.select("cell", "vb", "rb", "sid", "nums", "cats")
    right = right.select("cell", "vb", "rb", "nums", "cats")

    def minimum(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if distances is not None:
            distances.add(len(left) * len(right))
        return _block_minimum(left, right)

    nearest = (
        left.groupBy("cell", "vb", "rb").cogroup(right.groupBy("cell", "vb", "rb")).applyInPandas(minimum, "sid string, d double")
    )
    return nearest.groupBy("sid").agg(F.min("d").alias("d"))


def closest_record(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], distances=None, weight: str | None = None
) -> DataFrame:
    """``(d, n)``: distance of each distinct synthetic row to its nearest real row.

    ``distances`` is an accumulator that counts the distances to real rows; ``weight`` names a column
    of both tables that says how often a row stands.
    """
    real_points, synth_points = mixed_points(real, synth, cols, weight)
    same = real_points.select("nums", "cats", F.lit(True).alias("_same"))
    sid = F.md5(F.to_json(F.struct("nums", "cats")))
    matched = checkpointed(
        synth_points.join(same, ["nums", "cats"], "left").withColumn("sid", sid)
    )
    zero = matched.where(F.col("_same")).select(F.lit(0.0).alias("d"), "n")
    open_points = matched.where(F.col("_same").isNull()).select("sid", "nums", "cats", "n")
    n_real = real_points.count()
    if n_real == 0 or open_points.isEmpty():
        return zero

    wanted = min(MAX_PIVOTS, max(1, math.ceil(n_real / ROWS_PER_POINT)))
    order = F.md5(F.to_json(F.struct("nums", "cats")))
    chosen = real_points.orderBy(order).limit(wanted).select("nums", "cats").toPandas()
    tree = pivot_tree(_matrix(chosen["nums"], float), _matrix(chosen["cats"], np.int32))

    point = "nums array<double>, cats array<int>"
    real_cells = checkpointed(_to_leaves(real_points.select("nums", "cats"), tree, point))
    radii = (
        real_cells.select(F.explode("path").alias("p")).groupBy("p.node")
        .agg(F.min("p.d").alias("low"), F.max("p.d").alias("high")).collect()  # a row for each node of the tree
    )
    nodes = len(tree.first)
    tree.low, tree.high = np.full(nodes, np.inf), np.full(nodes, -np.inf)  # a node without rows is ruled out
    for r in radii:
        tree.low[r["node"]], tree.high[r["node"]] = r["low"], r["high"]
    shared = real.sparkSession.sparkContext.broadcast(tree)
    real_cells = real_cells.select("nums", "cats", "cell")
    counts = checkpointed(real_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_real")))
    located = checkpointed(_to_leaves(open_points, tree, f"sid string, {point}, n bigint").drop("path"))

    inf = F.lit(float("inf"))
    first = _visit_cells(located.select("sid", "nums", "cats", "cell"), real_cells, counts, distances)
    rows = checkpointed(located.join(first, "sid", "left").select(
        "sid", "nums", "cats", "n", "cell", F.coalesce("d", inf).alias("best"),
        F.lit(-1.0).alias("seen"), F.lit(-1).alias("seen_cell"),
    ))
    settled, limit = [], FIRST_VISITS
    while True:
        visits = checkpointed(_next_visits(rows, shared, limit, f"sid string, {point}, cell int, bound double, last boolean"))
        nearest = _visit_cells(visits.select("sid", "nums", "cats", "cell"), real_cells, counts, distances)
        upto = visits.groupBy("sid").agg(
            F.max(F.struct("bound", "cell")).alias("upto"), F.max("last").alias("last")
        )
        rows = checkpointed(rows.join(upto, "sid", "left").join(nearest, "sid", "left").select(
            "sid", "nums", "cats", "n", "cell", F.least("best", F.coalesce("d", inf)).alias("best"),
            F.coalesce("upto.bound", "seen").alias("seen"), F.coalesce("upto.cell", "seen_cell").alias("seen_cell"),
            F.coalesce("last", F.lit(True)).alias("done"),
        ))
        settled.append(rows.where("done").select(F.col("best").alias("d"), "n"))
        rows = rows.where("not done").drop("done")
        if rows.isEmpty():
            break
        limit *= FIRST_VISITS
    return reduce(DataFrame.unionByName, settled, zero)


def dcr(real: DataFrame, synth: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(metric, value)``: mean and 5th percentile of the distance to the closest record."""
    distances = checkpointed(closest_record(real, synth, cols, weight=weight).groupBy("d").agg(F.sum("n").alias("n")))
    mean = distances.agg(metric(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 6).alias("value"))
    low = exact_quantiles(
        distances, ["d"], [0.05], counts=distances.select(F.lit("d").alias("column"), F.col("d").alias("value"), "n")
    )
    return mean.select(F.lit("dcr_mean").alias("metric"), "value").unionByName(
        low.select(F.lit("dcr_p5").alias("metric"), metric(F.col("value"), 6).alias("value"))
    )
