"""Maximum mean discrepancy between two tables of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.functions.random import gaussian_number, uniform_number
from mirrortab.operators.core import checkpointed

BLOCK_ROWS = 1024
#: Partitions of the blocks (every pair of them is a task), and blocks that one holds at most.
BLOCK_PARTS, PART_BLOCKS = 8, 64
FOURIER_FEATURES = 256


def mmd_linear(x: DataFrame, y: DataFrame, vector: str) -> DataFrame:
    """Linear kernel: the squared distance of the two mean vectors; one pass, no pairs."""
    side = lambda df, s: df.select(F.lit(s).alias("side"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    means = side(x, 0).unionByName(side(y, 1)).groupBy("side").agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("m")
    )
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
    gap = F.zip_with(F.col("a"), F.col("b"), lambda p, q: (p - q) * (p - q))
    return means.agg(pick(0).alias("a"), pick(1).alias("b")).select(
        metric(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g)).alias("mmd")
    )


def _blocks(df: DataFrame, vector: str, name: str) -> tuple[DataFrame, int, int]:
    """Distinct vectors with multiplicity, packed into blocks of about BLOCK_ROWS."""
    points = checkpointed(
        df.select(F.col(vector).cast("array<double>").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    row = points.agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("rows")).first()
    blocks = max(1, math.ceil(row["points"] / BLOCK_ROWS))
    parts = min(blocks, max(BLOCK_PARTS, math.ceil(blocks / PART_BLOCKS)))
    numbered = points.withColumn("b", (F.abs(F.xxhash64("v")) % blocks).cast("int")).repartition(parts, "b")
    packed = numbered.groupBy("b").agg(
        F.collect_list("v").alias("vs"), F.collect_list(F.col("n").cast("double")).alias("ns")
    )
    return checkpointed(packed.select(F.lit(name).alias("side"), "b", "vs", "ns")), blocks, int(row["rows"] or 0)


def _kernel_sums(bandwidth: float):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a, b = np.array(r["vs"].tolist()), np.array(r["ws"].tolist())
                square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T)
                k = np.exp(-np.maximum(square, 0.0) / (2.0 * bandwidth**2))
                out.append(r["f"] * float(np.asarray(r["ns"]) @ k @ np.asarray(r["ms"])))
            yield pd.DataFrame({"term": pdf["term"].to_numpy(), "s": out})

    return sums


def mmd_rbf(x: DataFrame, y: DataFrame, vector: str, bandwidth: float = 1.0) -> DataFrame:
    """Gaussian kernel, exact.

    Every pair of vectors contributes, so the work is quadratic in the distinct vectors by
    definition.  Vectors meet as blocks: a block pair is one row, its kernel matrix is
    summed inside the task and only that sum is emitted.  Symmetric pairs are computed once.
    Stored partitions of blocks meet as they are read again, so that what is shuffled and
    written grows with the vectors, not with their pairs.
    """
    xb, _, rows_x = _blocks(x, vector, "x")
    yb, _, rows_y = _blocks(y, vector, "y")

    def paired(left: DataFrame, right: DataFrame, term: str, symmetric: bool) -> DataFrame:
        # never a broadcast of one side as a whole
        other = right.select(F.col("b").alias("c"), F.col("vs").alias("ws"), F.col("ns").alias("ms")).hint("shuffle_replicate_nl")
        met = left.join(other, F.col("b") <= F.col("c")) if symmetric else left.crossJoin(other)
        twice = F.when(F.col("b") == F.col("c"), 1.0).otherwise(2.0) if symmetric else F.lit(1.0)
        return met.select(F.lit(term).alias("term"), "vs", "ns", "ws", "ms", twice.alias("f"))

    pairs = (
        paired(xb, xb, "xx", True)
        .unionByName(paired(yb, yb, "yy", True))
        .unionByName(paired(xb, yb, "xy", False))
    )
    sums = pairs.mapInPandas(_kernel_sums(bandwidth), "term string, s double")
    part = lambda t: F.coalesce(F.sum(F.when(F.col("term") == t, F.col("s"))), F.lit(0.0))
    m, n = float(max(rows_x, 1)), float(max(rows_y, 1))
    value = part("xx") / (m * m) + part("yy") / (n * n) - 2.0 * part("xy") / (m * n)
    return sums.agg(metric(value).alias("mmd"))


def _waves(dims: int, features: int, bandwidth: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (features x dims) and phases of the random cosines."""
    w = [gaussian_number(seed, i, "frequency") / bandwidth for i in range(features * dims)]
    b = [2.0 * math.pi * uniform_number(seed, j, "phase") for j in range(features)]
    return np.array(w).reshape(features, dims), np.array(b)


def _cosine_sums(w: np.ndarray, b: np.ndarray):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((2, len(b))), np.zeros(2, dtype=np.int64)
        for pdf in batches:
            for side, part in pdf.groupby("side")["v"]:
                total[side] += np.cos(np.stack(part.to_list()) @ w.T + b).sum(0)
                rows[side] += len(part)
        yield pd.DataFrame({"side": [0, 1], "n": rows, "sums": list(total)})

    return sums


def mmd_fourier(
    x: DataFrame, y: DataFrame, vector: str, bandwidth: float = 1.0, features: int = FOURIER_FEATURES, seed: int = 42
) -> DataFrame:
    """Gaussian kernel in linear time: ``(mmd, std_error, bound)``.

    The kernel is the mean product of random cosines, so the discrepancy is the mean over features of
    the squared gap of two averages.  One pass; a task emits two rows of ``features`` sums.  The
    estimate has no bias; it is within ``bound`` of :func:`mmd_rbf` with probability 0.95 (Hoeffding,
    each feature's term lies in [0, 8]), and ``std_error`` is the spread of the terms over the root of
    their number.  Null vectors are left out, an empty side counts as zeros; vectors need one length.
    The waves, 8 bytes a feature and dimension, go to every task.
    """
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col(vector).cast("array<double>").alias("v"))
    both = side(x, 0).unionByName(side(y, 1)).where(F.col("v").isNotNull())
    sizes = both.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors of {sizes['low']} to {sizes['high']} components")
    partial = both.mapInPandas(
        _cosine_sums(*_waves(sizes["low"] or 0, features, bandwidth, seed)), "side int, n bigint, sums array<double>"
    )
    totals = partial.groupBy("side").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("n").alias("n")
    )
    zeros = F.array_repeat(F.lit(0.0), features)
    average = lambda s: F.coalesce(
        F.max(F.when((F.col("side") == s) & (F.col("n") > 0), F.transform("sums", lambda t: t / F.col("n")))), zeros
    )
    averages = totals.agg(average(0).alias("a"), average(1).alias("b"))
    terms = averages.select(F.explode(F.zip_with("a", "b", lambda p, q: F.lit(2.0) * (p - q) * (p - q))).alias("t"))
    return terms.agg(
        metric(F.avg("t")).alias("mmd"), metric(F.stddev_samp("t") / math.sqrt(features)).alias("std_error"),
        F.lit(8.0 * math.sqrt(math.log(2.0 / 0.05) / (2.0 * features))).alias("bound"),
    ).select("mmd", "std_error", metric(F.col("bound")).alias("bound"))
