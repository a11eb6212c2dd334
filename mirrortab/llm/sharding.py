"""Minimax contiguous partition of atomic groups into shards.

Equal texts form an atomic group.  Groups are ordered by the digest of their text; the operator
finds the smallest capacity for which cutting that order greedily needs no more shards than wanted,
and cuts there.  The law is ``bytes``: shard sizes are near equal.

One pass over the texts writes a narrow table (id, size, checksum, digest).  The search then works
on prefixes of the digest: the driver holds the sums of at most ``16 ** FIRST_DIGITS`` prefixes,
which bound the answer, and only prefixes in which a cut can still fall are opened by further
digits.  A few narrow jobs end with single groups at every possible cut, so the capacity found is
the exact optimum over all groups, whatever their number; the driver never holds more than the
opened prefixes.  Every cut is then moved inside its feasible range to the place nearest to an
even share, which keeps the largest shard as small as it can be and evens out the rest.

Slots number the rows of a shard.  Rows are dealt into bins by a hash of the row, counted per shard
and bin, and ranked inside their bin; a hot text is spread over all bins, and no task sorts a shard.

Everything is DataFrame operations.  Defined results: a null text has no bytes (size 16, checksum
0) and shares a group with the empty text; an empty table gives no rows; null ids are numbered like
any other; repeated rows get slots of their own; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrortab.llm.common import query, stored, table, text_or_empty

SHARDS = 40
#: Added to each row's bytes.
ROW_BYTES = 16
#: Digits of the digest in the first round, and more in each further one.
FIRST_DIGITS, MORE_DIGITS = 3, 1
DIGEST_DIGITS = 64
#: Rows of a bin that one window task ranks, on average.
BIN_ROWS = 20_000


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest, spread`` of each row; the only pass over the texts."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"),
    )


def _prefix_sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """``(prefix, bytes, groups, largest group)`` in order of the prefix."""
    rows = (
        groups.groupBy(F.substring("digest", 1, digits).alias("prefix"))
        .agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes"))
        .collect()
    )
    return sorted((r[0], int(r[1]), int(r[2]), int(r[3])) for r in rows)


def _shards_needed(ends: list[int], capacity: int) -> int:
    """Greedy check: shards of at most ``capacity`` over prefix sums; one more than many if a piece is too large."""
    used = start = i = 0
    while i < len(ends):
        j = bisect_right(ends, start + capacity, i)
        if j == i:
            return len(ends) + 1
        start, i, used = ends[j - 1], j, used + 1
    return used


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity with which ``sizes`` need no more than ``shards``."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    low, high = max([*sizes, -(-total // shards)], default=0), total
    while low < high:
        middle = (low + high) // 2
        if _shards_needed(ends, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _chosen_cuts(pieces: list[tuple], shards: int, capacity: int) -> list[str]:
    """First prefix of every shard but the first; cuts as near to even shares as ``capacity`` allows."""
    ends, total = [0], 0
    for p in pieces:
        total += p[1]
        ends.append(total)
    earliest, at = [0] * shards, total  # earliest[j]: where cut j may stand so that the rest still fits
    for j in range(shards - 1, 0, -1):
        i = bisect_right(ends, at - capacity - 1)
        at = ends[min(i, len(ends) - 1)] if at > capacity else 0
        earliest[j] = at
    cuts, last = [], 0
    for j in range(1, shards):
        low, high = max(last, earliest[j]), last + capacity
        i = bisect_right(ends, total * j // shards)
        near = [ends[k] for k in (i - 1, i) if k < len(ends) and low <= ends[k] <= high]
        if near:
            last = min(near, key=lambda e: abs(e * shards - total * j))
        else:
            last = ends[bisect_right(ends, high) - 1] if total * j // shards > high else low
        k = bisect_right(ends, last) - 1
        cuts.append(pieces[k][0] if k < len(pieces) else "g")  # after every digit: the rest stays empty
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """``(digest prefixes at which shards 1, 2, ... begin, capacity)`` for groups of ``digest, bytes``."""
    pieces = _prefix_sums(groups, FIRST_DIGITS)
    while True:
        total = sum(p[1] for p in pieces)
        low = max([-(-total // shards), *(p[3] for p in pieces)], default=0)
        high = smallest_capacity([p[1] for p in pieces], shards)
        opened: dict[int, list[str]] = {}
        start = 0
        for prefix, size, n, _ in pieces:
            end = start + size
            if n > 1 and len(prefix) < DIGEST_DIGITS:
                even = total * (start * shards // total + 1) < shards * end  # an even share ends inside
                if even or size > low or high > low and _may_hold_cut(start, end, total, shards, high):
                    opened.setdefault(len(prefix), []).append(prefix)
            start = end
        if not opened:
            return _chosen_cuts(pieces, shards, high), high
        gone = {p for chosen in opened.values() for p in chosen}
        pieces = [p for p in pieces if p[0] not in gone]
        for length, chosen in opened.items():
            inside = groups.where(F.substring("digest", 1, length).isin(chosen))
            pieces += _prefix_sums(inside, min(DIGEST_DIGITS, length + MORE_DIGITS))
        pieces.sort()


def _may_hold_cut(start: int, end: int, total: int, shards: int, high: int) -> bool:
    """Whether a cut of the best partition can fall inside a piece.

    With a capacity of ``high`` or less, cut ``j`` stands at ``j * high`` at most, and at
    ``total - (shards - j) * high`` at least, or the rest would not fit.
    """
    j = start // high + 1  # the first cut that can stand after the start
    return j < shards and total - (shards - j) * high < end


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """Number of cuts at or before a digest."""
    if not cuts:
        return F.lit(0)
    starts = F.array(*[F.lit(c) for c in cuts])
    return F.size(F.filter(starts, lambda c: c <= digest))


def shards(docs: DataFrame, number: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot`` of every row of ``docs``."""
    rows = stored(measured(docs), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "shard-groups")
    cuts, _ = minimax_cuts(groups, number)
    count = groups.agg(F.sum("n")).first()[0] or 0
    bins = max(1, count // (BIN_ROWS * number))
    placed = rows.withColumn("shard", shard_of(F.col("digest"), cuts)).withColumn("bin", F.pmod("spread", F.lit(bins)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bin").orderBy("spread", "doc_id", "digest")
    ranked = placed.withColumn("rank", F.row_number().over(inside))
    return ranked.join(offsets, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", "digest", "shard", (F.col("offset") + F.col("rank") - 1).cast("bigint").alias("slot")
    )


@query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
