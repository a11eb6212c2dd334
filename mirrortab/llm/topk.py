"""Exact top-k search by inner product, with bounds from segment statistics.

A vector is cut into segments; of each the mean and the deviation are kept.  By Cauchy and Schwarz, two
segments of ``m`` components have an inner product of ``m (mean mean' + deviation deviation')`` at
most, and the squared distance, which is the two squared norms less twice the product, is at least
what follows from that.  So the best candidates are the nearest after the norms, and both bounds are
one product of short vectors of statistics.

The statistics have several resolutions.  Tiles of queries and candidates are bounded by one segment
first, then by shorter ones; a pair goes on only while its bound reaches the ``k``-th best score that
its query is sure of.  The products of the pairs that are left are computed whole, so that nothing
rests on the bounds.  Segments prune what varies between segments: on vectors without any structure
(components independent of each other) only the shortest segments do.

Candidates are scanned where they lie, against one broadcast block of queries of bounded size after
another.  A first scan of the queries against each other gives the scores that a query is sure of.  So
a task passes on at most ``k`` candidates a query and only those that can be among the ``k`` best.

Vectors are whole numbers, the components of ``floor(scale * x)``; sums are exact up to 2**53.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; pairs need vectors of equal length; rows with a query's own id are no candidates of it;
candidates are rows, so that repeated rows rank one after another; rows that repeat an id and vector
are one query, and different vectors of one id share its ``k`` places; ties go to the smaller id; a
query with fewer than ``k`` candidates returns all, one without any none; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import query, stored, table

#: Components of a block of queries, at most.
BLOCK_VALUES = 1_000_000
#: Queries of a tile.
TILE = 1_024
#: Shorter segments have this many times fewer components.
FINER = 8
#: Relative slack of bounds, for rounding.
SLACK = 1e-9


def segment_lengths(size: int) -> list[int]:
    """Lengths of the segments from coarse to fine, for vectors of ``size`` components."""
    out = [size] if size else []
    while out and out[-1] > 2:
        out.append(max(2, -(-out[-1] // FINER)))
    return out


def statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Per vector the scaled means and deviations of its segments: their products bound the product."""
    at = np.arange(0, vectors.shape[1], length)
    m = np.diff(at, append=vectors.shape[1])
    sums = np.add.reduceat(vectors, at, axis=1)
    squares = np.add.reduceat(vectors * vectors, at, axis=1)
    return np.concatenate((sums / np.sqrt(m), np.sqrt(np.maximum(squares - sums * sums / m, 0))), axis=1)


class Block:
    """Queries with their statistics and the best candidates seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sure: np.ndarray, k: int, tile: int = TILE) -> None:
        self.ids, self.vectors, self.sure, self.k, self.tile = ids, vectors, sure, k, tile
        self.lengths = segment_lengths(vectors.shape[1])
        self.levels = [statistics(vectors, n) for n in self.lengths]
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        levels = [statistics(vectors, n) for n in self.lengths]
        largest = np.sqrt((vectors * vectors).sum(axis=1).max())
        for at in range(0, len(self.ids), self.tile):
            rows = slice(at, at + self.tile)
            least = np.maximum(self.sure[rows], self.scores[rows, -1])
            pairs = ids[None, :] != self.ids[rows, None]
            open_ = least - SLACK * self.norms[rows] * largest
            for mine, theirs in zip(self.levels, levels):
                pairs &= mine[rows] @ theirs.T >= open_[:, None]
                if not pairs.any():
                    break
            else:
                self._settle(at, pairs, least, ids, vectors)

    def _settle(self, at: int, pairs: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Whole products of the pairs that are left, and the best of them."""
        some = np.flatnonzero(pairs.any(axis=1))
        scores = np.where(pairs[some], self.vectors[at + some] @ vectors.T, -np.inf)
        least = least[some]
        if scores.shape[1] > self.k:  # what the tile itself makes sure of
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        value, who, q = scores[q, c], ids[c], at + some[q]
        touched = np.unique(q)
        q = np.concatenate((q, np.repeat(touched, self.k)))
        value = np.concatenate((value, self.scores[touched].ravel()))
        who = np.concatenate((who, self.found[touched].ravel()))
        order = np.lexsort((who, -value, q))
        q, value, who = q[order], value[order], who[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.scores[q[kept], rank[kept]] = value[kept]
        self.found[q[kept], rank[kept]] = who[kept]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, candidates and scores."""
        q, place = np.nonzero(np.isfinite(self.scores))
        return q, self.found[q, place], self.scores[q, place].astype(np.int64)


def whole_numbers(column, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column have ``size`` components, and these as scaled whole numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    right = np.flatnonzero(lengths == size)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(right) < len(lengths):
        values = values[np.repeat(lengths == size, lengths)]
    return right, np.floor(scale * values.reshape(len(right), size))


def _scanned(rows: DataFrame, shared, scale: int) -> DataFrame:
    """``q, query_id, vec_id, score``: the best of each partition of ``rows`` (``id, vector``); ``q`` is a place in the block."""

    def scan(frames):
        ids, vectors, *settings = shared.value
        block = Block(ids, vectors, *settings)
        for batch in frames:
            right, numbers = whole_numbers(batch.column(1), vectors.shape[1], scale)
            if len(right):
                block.see(batch.column(0).to_numpy()[right], numbers)
        q, found, scores = block.best()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q, ids[q], found, scores)], ["q", "query_id", "vec_id", "score"])

    return rows.mapInArrow(scan, "q bigint, query_id bigint, vec_id bigint, score bigint")


def _usable(vector: str) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & whole


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", scale: int = 256, tile: int = TILE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query row.

    ``vectors`` has an integer ``vec_id`` and an array ``vector``; ``is_query`` marks the queries.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(vector)).select(
        F.col("vec_id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    candidates = rows.select("id", "vector")
    queries = stored(rows.where("asks").select("id", "vector").distinct(), "top-k-queries")
    parts = []
    for size, count in sorted(tuple(r) for r in queries.groupBy(F.size("vector")).count().collect()):
        limit = max(tile, BLOCK_VALUES // max(1, size))
        blocks = 1 if count <= limit else -(-2 * count // limit)  # half full, so that few are cut
        of_size = queries.where(F.size("vector") == size)
        for b in range(blocks):
            block = of_size.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
            for at in range(0, block.num_rows, limit):
                part = block.slice(at, limit).combine_chunks()
                ids = part.column("id").to_numpy()
                lists = part.column("vector").combine_chunks()
                asked = whole_numbers(lists, size, scale)[1]
                sure = np.full(len(ids), -np.inf)
                shared = spark.sparkContext.broadcast((ids, asked, sure, k, tile))
                first = _ranked(_scanned(of_size, shared, scale), "q", k).where(F.col("rank") == k).select("q", "score")
                for q, score in first.collect():  # one number a query of the block
                    sure[q] = score
                shared.unpersist()
                shared = spark.sparkContext.broadcast((ids, asked, sure, k, tile))
                best = _scanned(candidates, shared, scale).drop("q")
                parts.append(stored(_ranked(best, "query_id", k), "top-k"))
                shared.unpersist()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # an id may have queries in several blocks
        found = _ranked(found, "query_id", k)
    return found.select("query_id", "rank", "vec_id", "score")


SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op13_top_k", SQL_TOP_K)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
