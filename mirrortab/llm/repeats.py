"""Removal of passages that occur more than once: a radix sort of windows of ``THRESHOLD`` bytes.

Ordering all suffixes by their first ``THRESHOLD`` bytes only makes equal windows neighbours; the
equal groups are exactly the repeated windows.  The order is refined by passes of most significant
digits, and each pass drops what is already alone, so only repeated text is ever ordered deeply:

1. The first digit of a window is the hash of its least ``GRAM``-byte piece, the *anchor*.  It follows from
   the window's bytes alone, so equal windows have equal anchors, and neighbouring windows share one:
   a run of windows is one row.  Runs whose anchor occurs once hold no repeated window and are done.
2. The next digit is the hash of the whole run.  Runs that are equal as a whole are repeated as a whole;
   one of each class goes on as a partner for runs that share only a part.
3. What is left are runs that share an anchor but are not equal.  They travel with their bytes and are
   ordered by these: from the anchor to the left and from the anchor to the right, digit by digit of
   eight bytes, the most significant first, only what is not alone yet going into the next pass.  From
   both orders follows, for each position of the anchor in a window, which windows are equal; equal
   groups are exactly the repeated windows.  A group of more than ``GROUP`` runs is no task's work: its
   windows are dealt by the position of the anchor, a quarter of the positions at a time, and grouped
   anew by the bytes that all windows of a quarter share, until all 400 bytes are the group's key.

Pass one loses nothing and decides nothing.  In pass two runs, and texts as wholes, are told by 128 bits
of hash; in pass three windows by their bytes alone, so that windows of equal hashes are kept apart.
Hashes of pieces are polynomial over random numbers for the bytes, mixed.

Texts are known by a 128-bit key of their content, so copies are one text.  They are moved once, with
copies reduced before the shuffle, and again only if something in them is repeated.

Defined results: null is the empty text; texts shorter than the threshold keep everything and match
nothing; overlapping repeats inside one document count; a text that occurs twice is removed whole in
all its rows; spans are measured on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.llm.common import query, stored, table, text_or_empty

THRESHOLD, GRAM = 400, 128
#: Pieces of a window.
PIECES = THRESHOLD - GRAM + 1
#: Windows handled at a time in a long text (positions inside fit the low bits of a sort key).
CHUNK = (1 << 20) - 2 * THRESHOLD
_LOW = np.uint64((1 << 20) - 1)
#: Runs that a task compares with each other; a larger group is split by more of its bytes.
GROUP = 4_096
#: Parts that the positions of the anchor are cut into when a group is split.
QUARTERS = 4
#: Bytes of groups that a task holds, on average.
BLOCK_BYTES = 12_000_000

_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8
_NUMBERS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, made once in a worker."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(CHUNK + 3 * THRESHOLD, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any piece follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_NUMBERS[data] * _powers()[0][: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all pieces of ``size`` bytes."""
    h = sums[size:] - sums[:-size]
    h *= _powers()[1][: len(h)]
    return _mixed(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, whole, first, last)``: runs of window starts that share an anchor, and their hashes."""
    out: list[tuple] = []
    for at in range(0, len(data) - THRESHOLD + 1, CHUNK):
        end = min(len(data) - THRESHOLD + 1, at + CHUNK)
        sums = _sums(data[at : end + THRESHOLD - 1])
        grams = _hashes(sums, GRAM)
        # the least leading bits, leftmost first: decided by the bytes of the window alone
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(key, PIECES) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        stop = last + THRESHOLD
        whole = (sums[stop] - sums[first]) * _powers()[1][first]
        whole = _mixed(whole + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((grams[anchor[first]], whole, first + at, last + at))
    if not out:
        none = np.empty(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


ROWS = "k1 bigint, k2 bigint, anchor bigint, whole bigint, first bigint, last bigint"


def _run_rows(frames):
    names = ["k1", "k2", "anchor", "whole", "first", "last"]
    for batch in frames:
        sizes, held, parts = [], 0, []
        begin = 0

        def flush(upto: int):
            counts = np.array(sizes, np.int64)
            keys = [np.repeat(batch.column(c).to_numpy()[begin:upto], counts) for c in (0, 1)]
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(k) for k in keys] + [pa.array(c.view(np.int64)) for c in columns], names
            )

        for i, text in enumerate(batch.column(2)):
            found = runs(np.frombuffer(text.as_buffer(), np.uint8))
            sizes.append(len(found[0]))
            parts.append(found)
            held += len(found[0])
            if held > 200_000:
                yield flush(i + 1)
                sizes, held, parts, begin = [], 0, [], i + 1
        if sizes:
            yield flush(batch.num_rows)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` never null and the key of its content."""
    text = text_or_empty()
    return docs.select(
        "doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text")
    )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``k1, k2, runs``: per text its runs that are repeated whole (``full``) or go on (``goes``)."""
    long = docs.where(F.octet_length("text") >= THRESHOLD).select("k1", "k2", F.col("text").cast("binary"))
    rows = long.mapInArrow(_run_rows, ROWS)
    # pass one: anchors that occur again; all spans equal means there is nothing more to find
    anchors = rows.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")
    ).where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("same"))
    left = stored(rows.join(stored(anchors, "repeat-anchors"), "anchor"), "repeat-runs")
    # pass two: classes of equal runs
    mixed = left.where("not same")
    classes = mixed.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")
    )
    # stored, so that the join below is one that Spark can split where a run is very common
    of_class = mixed.join(stored(classes, "repeat-classes"), ["anchor", "whole"]).select(
        "k1", "k2", "first", "last", (F.col("n") > 1).alias("full"),
        (F.col("one") == F.struct("k1", "k2", "first")).alias("goes"),
    )
    whole = left.where("same").select("k1", "k2", "first", "last", F.lit(True).alias("full"), F.lit(False).alias("goes"))
    # rows of copies are equal: they are reduced before they meet
    distinct = whole.unionByName(of_class).groupBy("k1", "k2", "first", "last").agg(
        F.max("full").alias("full"), F.max("goes").alias("goes")
    )
    return distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "full", "goes")).alias("runs"))


def _texts(group):
    """``(k1, k2, bytes, runs)`` of a group's rows; runs as an array of ``first, last, full, goes``."""
    for k1, k2, text, flat in zip(
        group.column("k1").to_pylist(), group.column("k2").to_pylist(), group.column("text"), group.column("runs")
    ):
        of = flat.values
        found = np.stack([
            of.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "last", "full", "goes")
        ], axis=1)
        yield k1, k2, np.frombuffer(text.as_buffer(), np.uint8), found


def removed(size: int, intervals: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in ``intervals`` (first, last) cover."""
    out: list[tuple[int, int]] = []
    for first, last in intervals[np.argsort(intervals[:, 0], kind="stable")].tolist():
        end = min(size, last + THRESHOLD)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _anchor(piece: np.ndarray) -> tuple[int, int]:
    """Position and hash of the anchor that all windows of a run share."""
    grams = _hashes(_sums(piece), GRAM)
    at = int(np.argmin(grams & ~_LOW))  # the leftmost of the least
    return at, int(grams[at])


PIECES_OF_RUNS = "key binary, low int, high int, k1 bigint, k2 bigint, first bigint, at int, piece binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = zip(*rows) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECES_OF_RUNS.split(", ")]
    )


def _piece_rows(frames):
    """Runs that go on, as rows with their bytes; the key of a group is the anchor."""
    for batch in frames:
        rows, size = [], 0
        for k1, k2, data, found in _texts(batch):
            for first, last in found[found[:, 3] > 0, :2].tolist():
                piece = data[first : last + THRESHOLD]
                at, anchor = _anchor(piece)
                rows.append((anchor.to_bytes(8, "big"), 0, THRESHOLD - GRAM, k1, k2, first, at, piece.tobytes()))
                size += len(piece)
                if size > 4_000_000:
                    yield _piece_batch(rows)
                    rows, size = [], 0
        yield _piece_batch(rows)


def split_row(low: int, high: int, k1: int, k2: int, first: int, at: int, piece: bytes) -> list[tuple]:
    """The windows of a row by quarters of the anchor's positions ``low`` to ``high`` in them.

    The key of a quarter is the bytes that all its windows share, whatever run they are from.
    """
    rows, step = [], -(-(high - low + 1) // QUARTERS)
    least = at - (len(piece) - THRESHOLD)
    for a in range(low, high + 1, step):
        b = min(a + step - 1, high)
        mine_a, mine_b = max(a, least), min(b, at)
        if mine_a <= mine_b:
            key = a.to_bytes(2, "big") + piece[at - a : at - b + THRESHOLD]
            rows.append((key, a, b, k1, k2, first + at - mine_b, mine_b, piece[at - mine_b : at - mine_a + THRESHOLD]))
    return rows


def _split(frames):
    for batch in frames:
        rows = []
        for r in zip(*(c.to_pylist() for c in batch.columns[1:8])):
            rows += split_row(*r)
            if len(rows) > 4_096:
                yield _piece_batch(rows)
                rows = []
        yield _piece_batch(rows)


def sorted_by_digits(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix, by most-significant-digit passes over eight bytes at a time."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    digits = padded.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(digits.shape[1]):
        alone = np.ones(n, bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[:-1] != group[1:]
        rest = np.flatnonzero(~alone)
        if not len(rest):
            break
        digit = digits[order[rest], d].astype(np.uint64)
        turn = np.lexsort((digit, group[rest]))
        order[rest], digit = order[rest][turn], digit[turn]
        old = group[rest]  # sorted already, and stays so
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (digit[1:] != digit[:-1])))
        group[rest] = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
    return order


def _classes(rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For every row and depth a number that rows have in common if their first bytes up to the depth are equal."""
    order = sorted_by_digits(rows)
    there = rows[order]
    differ = there[1:] != there[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)
    out = np.zeros((len(rows), len(depths)), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < depths[None, :], axis=0)
    return out


def repeated_windows(pieces: list[bytes], ats: list[int]) -> list[tuple[int, int, int]]:
    """``(row, first, last)``: windows of the pieces (starts in them) whose bytes another piece has as well.

    ``ats`` are the positions of the anchor, which equal windows hold at the same place.
    """
    n = len(pieces)
    high = np.array(ats)
    low = high - np.array([len(p) - THRESHOLD for p in pieces])
    offsets = np.arange(low.min(), high.max() + 1)
    left = np.zeros((n, int(offsets[-1])), np.uint8)
    right = np.zeros((n, THRESHOLD - int(offsets[0])), np.uint8)
    for i, (piece, at) in enumerate(zip(pieces, ats)):
        data = np.frombuffer(piece, np.uint8)
        left[i, :at] = data[:at][::-1]
        right[i, : len(data) - at] = data[at:]
    key = _classes(left, offsets) * n + _classes(right, THRESHOLD - offsets)
    there = (offsets >= low[:, None]) & (offsets <= high[:, None])
    key[~there] = np.broadcast_to(-1 - np.arange(n)[:, None], key.shape)[~there]  # no window there: equal to none
    by_key = np.argsort(key, axis=0)
    ordered = np.take_along_axis(key, by_key, axis=0)
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(key.shape, bool)
    again[1:] |= same
    again[:-1] |= same
    marked = np.zeros((n, len(offsets) + 2), np.int8)
    np.put_along_axis(marked[:, 1:-1], by_key, again, axis=0)
    change = np.diff(marked, axis=1)
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1] - 1
    return list(zip(row.tolist(), (high[row] - offsets[end]).tolist(), (high[row] - offsets[begin]).tolist()))


FOUND = "k1 bigint, k2 bigint, first bigint, last bigint"


def _compared(group):
    """Groups of a task, each by itself."""
    keys = group.column("key").to_pylist()
    members: dict[bytes, list[int]] = {}
    for i, key in enumerate(keys):
        members.setdefault(key, []).append(i)
    pieces, ats = group.column("piece").to_pylist(), group.column("at").to_pylist()
    rows, first, last = [], [], []
    for of in members.values():
        for i, a, b in repeated_windows([pieces[i] for i in of], [ats[i] for i in of]):
            rows.append(of[i])
            first.append(a)
            last.append(b)
    taken = group.select(["k1", "k2", "first"]).take(pa.array(rows, pa.int64()))
    start = taken.column("first").to_numpy()
    return pa.table([
        taken.column("k1"), taken.column("k2"), pa.array(start + np.array(first, np.int64)), pa.array(start + np.array(last, np.int64))
    ], ["k1", "k2", "first", "last"])


def equal_windows(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """``k1, k2, first, last``: windows (ranges of starts) of runs that go on which occur in another run too.

    ``texts`` is ``k1, k2, text`` (bytes) and ``runs``.
    """
    rows = texts.mapInArrow(_piece_rows, PIECES_OF_RUNS)
    found = None
    while True:
        rows = stored(rows, "repeat-pieces")
        # stored, so that the join is one that Spark can split at a large group
        sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-groups")
        size, larger = sizes.agg(F.sum("n"), F.max("n")).first()
        sized = rows.join(sizes, "key")
        blocks = -(-(size or 0) * (2 * THRESHOLD) // BLOCK_BYTES) or 1
        few = sized.where(F.col("n") <= group).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        part = few.select("block", "key", "k1", "k2", "first", "at", "piece").groupBy("block").applyInArrow(_compared, FOUND)
        found = part if found is None else found.unionByName(part)
        if (larger or 0) <= group:
            return found
        many = sized.where(F.col("n") > group)
        # where one position is left, the key is the whole window
        whole = many.where("low = high").select("k1", "k2", "first", F.col("first").alias("last"))
        found = found.unionByName(whole)
        rows = many.where("low < high").drop("n").mapInArrow(_split, PIECES_OF_RUNS)


def _spans(frames):
    """Spans to remove and the digest of the rest, of each text."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in frames:
        spans, digests = [], []
        pairs = lambda flat: np.stack([flat.values.field(n).to_numpy(zero_copy_only=False) for n in ("first", "last")], axis=1)
        for (_, _, data, runs_), more in zip(_texts(batch), batch.column("found")):
            intervals = [runs_[runs_[:, 2] > 0, :2]]
            if more.is_valid:
                intervals.append(pairs(more).astype(np.int64))
            mine = removed(len(data), np.concatenate(intervals))
            digest, at = hashlib.sha256(), 0
            for a, b in mine:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            spans.append([{"first": a, "end": b} for a, b in mine])
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(spans, kind), pa.array(digests, pa.string())],
            ["k1", "k2", "spans", "kept_sha256"],
        )


def repeated_spans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """``k1, k2, spans, kept_sha256`` of ``texts`` (``k1, k2, text`` as bytes, ``runs``)."""
    found = equal_windows(texts, group).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return texts.join(stored(found, "repeat-windows"), ["k1", "k2"], "left").mapInArrow(
        _spans, "k1 bigint, k2 bigint, spans array<struct<first:bigint,end:bigint>>, kept_sha256 string"
    )


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, spans`` (bytes to remove) and ``kept_sha256``.

    Groups of more than ``group`` runs are split before a task compares them.
    """
    docs = keyed(docs)
    found = stored(repeated_runs(docs), "repeat-texts")
    # one row of each text, copies reduced before the shuffle
    texts = docs.groupBy("k1", "k2").agg(F.first(F.col("text").cast("binary")).alias("text"))
    texts = stored(texts.join(found, ["k1", "k2"]), "repeat-candidates")
    spans = stored(repeated_spans(texts, group), "repeat-spans")
    rows = docs.select(
        "doc_id", "k1", "k2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")
    )
    return rows.join(spans, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


@query("op5_repeated_spans")
def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    lengths = F.transform("spans", lambda s: s["end"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256",
    )
