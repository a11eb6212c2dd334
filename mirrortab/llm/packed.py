"""Finding hashes that occur in several places, exchanged in packed form.

A *block* is a bounded set of items whose hashes a task can compute again at will.  Each block sends
its distinct hashes, cut into *parts* by their leading bits, as sorted differences: a few bytes a
hash instead of a row.  One task for each part sees the hashes of all blocks in its range and answers
every block with those that are repeated.  Spark shuffles ``(part, block, bytes)`` rows; sizes of
parts and blocks are bounded by their number, which the caller derives from counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes of a part, on average.
PART_HASHES = 2_000_000

SENT = "part int, block bigint, hashes binary, twice binary"
ANSWERED = "block bigint, hashes binary"

_ZSTD = pa.Codec("zstd", compression_level=1)


def part_bits(total: int) -> int:
    """Leading bits that cut ``total`` hashes into parts of bounded size."""
    return max(0, int(total // PART_HASHES).bit_length())


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct ``uint64`` values as differences, byte plane by byte plane."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return len(values).to_bytes(4, "little") + bytes([used]) + _ZSTD.compress(body, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    n, used = int.from_bytes(data[:4], "little"), data[4]
    planes = np.zeros((8, n), np.uint8)
    body = _ZSTD.decompress(data[5:], decompressed_size=n * used, asbytes=True)
    planes[:used] = np.frombuffer(body, np.uint8).reshape(used, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def sent(block: int, hashes: np.ndarray, width: int, bits: int) -> pa.Table:
    """Rows of a block: its hashes (of ``width`` bits; they are sorted in place) by part.

    ``twice`` marks hashes that the block itself holds more than once.
    """
    hashes.sort()
    edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist()
    edges.append(len(hashes))
    rows: dict[str, list] = {"part": [], "block": [], "hashes": [], "twice": []}
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            some = hashes[a:b]
            at = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            again = np.diff(at, append=b - a) > 1
            rows["part"].append(part)
            rows["block"].append(block)
            rows["hashes"].append(packed(some[at]))
            rows["twice"].append(np.packbits(again).tobytes() if again.any() else b"")
    return pa.table([
        pa.array(rows["part"], pa.int32()), pa.array(rows["block"], pa.int64()),
        pa.array(rows["hashes"], pa.binary()), pa.array(rows["twice"], pa.binary()),
    ], list(rows))


def _answers(part):
    blocks = part.column("block").to_pylist()
    each = [unpacked(h) for h in part.column("hashes").to_pylist()]
    all_ = np.concatenate(each)
    all_.sort()
    repeated = [all_[1:][all_[1:] == all_[:-1]]]
    del all_
    for values, marks in zip(each, part.column("twice").to_pylist()):
        if marks:
            repeated.append(values[np.unpackbits(np.frombuffer(marks, np.uint8), count=len(values)).astype(bool)])
    repeated = np.unique(np.concatenate(repeated))
    rows, of = [], []
    for block, values in zip(blocks, each):
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, values), len(repeated) - 1)
            hit = values[repeated[at] == values]
            if len(hit):
                rows.append(packed(hit))
                of.append(block)
    return pa.table([pa.array(of, pa.int64()), pa.array(rows, pa.binary())], ["block", "hashes"])


def repeated_hashes(rows: DataFrame) -> DataFrame:
    """``(block, hashes)``: for every block its hashes that occur twice or more, in one or more rows."""
    return rows.groupBy("part").applyInArrow(_answers, ANSWERED)


def gathered(answers: pa.Table) -> np.ndarray:
    """All answered hashes of a block, sorted."""
    parts = [unpacked(h) for h in answers.column("hashes").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


class Members:
    """Membership in a sorted array; a bitmap answers most of the noes."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.shift = np.uint64(max(16, min(26, len(values).bit_length() + 3)))
        self.seen = np.zeros(1 << int(self.shift), bool)
        self.seen[self._low(values)] = True

    def _low(self, x: np.ndarray) -> np.ndarray:
        return x & np.uint64((1 << int(self.shift)) - 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whether each of ``x`` is a member."""
        found = self.seen[self._low(x)]
        at = np.flatnonzero(found)
        if len(at):
            y = x[at]
            where = np.minimum(np.searchsorted(self.values, y), len(self.values) - 1)
            found[at] = self.values[where] == y
        return found
