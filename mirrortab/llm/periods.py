"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` and a length of ``max(12, 2 q)`` or
more that no neighbouring word extends.  If ``2 B - 1 <= q``, the words from its start to ``q`` before
its end hold a dyadic block of ``B`` words (one that starts at a multiple of ``B``), and the block
occurs again ``q`` words later.  So every block asks for its occurrences at distances from ``2 B - 1``
to ``4 B - 2``: over all powers ``B`` of two that is every period.  The least power is 4, with blocks
at each second word and distances from 1, because a run has 12 words at least.

Many texts are laid end to end, each closed by a symbol of its own, and sorted together by prefix
doubling: after round ``k`` equal blocks of ``2 ** k`` words have equal classes, and the suffixes that
begin with a block are one interval of the suffix array.  A wavelet matrix over that array says which
of them begin in a window of the text (range successor).  A window of ``B`` starts holds one arithmetic
progression of occurrences, so that its first two and their number are enough.  Three or more mean
that the block has the progression's difference as its period; where this period reaches from the
block to the last of them, the only run to find is the one of the difference.  All other members are
candidate periods of their own.  Candidates are extended to both sides by the classes of all rounds,
longest first, and the smallest period of a stretch is kept.

Work is ``n log n`` for ``n`` words whatever the text, with no shuffle: documents are read where they
lie, batches of texts being sorted together.  Memory follows the batch or, if longer, one text.

Defined results: null and empty texts and texts without words have no runs and an empty collapsed
text; texts of any length are one sequence, never cut; a tie between periods of a stretch goes to the
smallest, overlapping runs are all listed; repeated rows are each answered; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import query, table, text_or_empty
from mirrortab.llm.quality import let
from mirrortab.llm.wavelet import WaveletMatrix

#: Words of a run, at least.
LEAST = 12
#: Words of the least blocks, as a power of two.
LEAST_POWER = 2
#: Words of texts that are sorted together; a longer text is sorted alone.
TOGETHER = 150_000

_NONE = np.empty(0, np.int64)


def _starts(same_as_before: np.ndarray) -> np.ndarray:
    """For each sorted entry the place at which its group starts."""
    at = np.arange(len(same_as_before))
    return np.maximum.accumulate(np.where(same_as_before, 0, at))


def _repeats(keys: np.ndarray) -> np.ndarray:
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    return same


class Blocks:
    """Classes of equal blocks of each power of two, and the suffix array, of a sequence of symbols.

    The last symbol occurs nowhere else.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        start = _starts(_repeats(symbols[order]))
        known = np.empty(n, np.int64)
        known[order] = start
        self.suffixes = order.copy()
        #: Per power: the class of every place.
        self.classes = [known]
        #: Per power: places whose block occurs again, in order of the suffix array, and the size of their class.
        self.shared: list[tuple[np.ndarray, np.ndarray]] = [self._again(order, start)]
        step = 1
        while len(self.shared[-1][0]):
            places = self.shared[-1][0]
            key = known[places] * (n + 1) + known[np.minimum(places + step, n - 1)]
            by_key = np.argsort(key, kind="stable")
            places, key = places[by_key], key[by_key]
            old = known[places]
            since_old, since_key = _starts(_repeats(old)), _starts(_repeats(key))
            self.suffixes[old + np.arange(len(places)) - since_old] = places
            known = known.copy()
            known[places] = old + since_key - since_old
            self.classes.append(known)
            self.shared.append(self._again(places, since_key))
            step *= 2

    @staticmethod
    def _again(places: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(start, minlength=len(start))[start]
        return places[size > 1], size[size > 1]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on (``i < j``)."""
        i, j = i.copy(), j.copy()
        begin, last = i.copy(), len(self.classes[0]) - 1
        for power in range(len(self.classes) - 1, -1, -1):
            c = self.classes[power]
            step = (j <= last) & (c[i] == c[np.minimum(j, last)])
            i += step << power
            j += step << power
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before ``i`` and ``j`` (``i < j``)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for power in range(len(self.classes) - 1, -1, -1):
            c, width = self.classes[power], 1 << power
            step = (i >= width) & (c[np.maximum(i - width, 0)] == c[np.maximum(j - width, 0)])
            i -= step << power
            j -= step << power
        return begin - i


def _progressions(tree: WaveletMatrix, low, high, first_start, last_start):
    """First place, difference and number of the occurrences that start in each window (none where empty).

    ``low`` and ``high`` are the interval of the pattern; the window has no more starts than the pattern words.
    """
    before = tree.below(low, high, first_start)
    number = tree.below(low, high, last_start + 1) - before
    some = number > 0
    first, difference = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    first[some] = tree.nth(low[some], high[some], before[some])
    more = number > 1
    difference[more] = tree.nth(low[more], high[more], before[more] + 1) - first[more]
    return first, difference, number


def candidates(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which a block occurs again, all that runs need."""
    if len(blocks.shared) <= LEAST_POWER or not len(blocks.shared[LEAST_POWER][0]):
        return _NONE, _NONE
    n = len(blocks.suffixes)
    # only suffixes that share their first words with another can be an answer
    again = np.zeros(n, bool)
    again[blocks.shared[LEAST_POWER][0]] = True
    again = again[blocks.suffixes]
    tree = WaveletMatrix(blocks.suffixes[again])
    rank = np.concatenate(([0], np.cumsum(again)))
    at, distance = [], []
    for power in range(LEAST_POWER, len(blocks.shared)):
        width = 1 << power
        nearest, farthest = 1 if power == LEAST_POWER else 2 * width - 1, 4 * width - 2
        if 2 * nearest > n:
            break
        places, size = blocks.shared[power]
        aligned = places % (width // 2 if power == LEAST_POWER else width) == 0
        places, size = places[aligned], size[aligned]
        low = rank[blocks.classes[power][places]]
        high = low + size
        in_reach = tree.below(low, high, places + farthest + 1) - tree.below(low, high, places + nearest) > 0
        places, low, high = places[in_reach], low[in_reach], high[in_reach]
        for d in range(nearest, farthest + 1, width):
            first, difference, number = _progressions(
                tree, low, high, places + d, places + min(d + width - 1, farthest)
            )
            # the block's period reaches from the block to the last of the progression
            long = np.flatnonzero(number > 2)
            reach = first[long] + difference[long] * (number[long] - 1) + width - places[long] - difference[long]
            covered = long[blocks.forward(places[long], places[long] + difference[long]) >= reach]
            at.append(places[covered])
            distance.append(difference[covered])
            number[covered] = 0
            each = np.repeat(np.arange(len(places)), number)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
            at.append(places[each])
            distance.append(first[each] + nth * difference[each] - places[each])
    return np.concatenate([_NONE, *at]), np.concatenate([_NONE, *distance])


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence whose last symbol is unique, by start, then period."""
    blocks = Blocks(symbols)
    at, period = candidates(blocks)
    start = at - blocks.backward(at, at + period)
    length = at + period + blocks.forward(at, at + period) - start
    right = length >= np.maximum(LEAST, 2 * period)
    start, length, period = start[right], length[right], period[right]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = ~(_repeats(start) & _repeats(length))  # of equal stretches the smallest period comes first
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _answers(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each of some texts (lists of words)."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - np.diff(ends, prepend=0)
    symbols = np.empty(int(ends[-1]), np.int64)
    for t, a, b in zip(texts, begins.tolist(), ends.tolist()):
        symbols[a : b - 1] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    symbols[ends - 1] = len(number) + np.arange(len(texts))
    start, length, period = runs(symbols)
    text = np.searchsorted(ends, start, side="right")
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge) > 0
    found: list[list[dict]] = [[] for _ in texts]
    for i, s, n, q in zip(text.tolist(), (start - begins[text]).tolist(), length.tolist(), period.tolist()):
        found[i].append({"start": s, "length": n, "period": q})
    collapsed = []
    for t, of, a in zip(texts, found, begins.tolist()):
        if of:
            t = [t[i] for i in np.flatnonzero(~dropped[a : a + len(t)]).tolist()]
        collapsed.append(b" ".join(t))
    return found, collapsed


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(frames, together: int):
    names = ["doc_id", "n_words", "runs", "collapsed"]
    for batch in frames:
        ids, held, words, begin = batch.column(0), [], 0, 0
        rows = batch.num_rows
        for i, text in enumerate(batch.column(1)):
            held.append(text.as_buffer().to_pybytes().split())
            words += len(held[-1])
            if words >= together or i + 1 == rows:
                found, collapsed = _answers(held)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, len(held)), pa.array([len(t) for t in held], pa.int64()), pa.array(found, _RUNS),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ], names)
                held, words, begin = [], 0, i + 1


def periodic_runs(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (``doc_id, text``).

    ``runs`` has ``start, length, period`` by start, then period; ``collapsed`` is the text without the
    words of a run after its first period, words joined by one space.  Texts of ``together`` words are
    sorted together.
    """
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(kind)), T.StructField("collapsed", T.StringType()),
    ])
    return docs.select("doc_id", text_or_empty().cast("binary")).mapInArrow(lambda frames: _found(frames, together), schema)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the tail of each tenth document, chosen by its id, made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        a = g % F.size(w)
        return F.struct(a.alias("a"), (F.floor((F.size(w) - a) / (g % 8 + 3)) + 1).alias("p"))

    def repeated(w: Column) -> Column:
        at = lambda i, t: F.when(i >= t["a"], t["a"] + (i - t["a"]) % t["p"]).otherwise(i).cast("int")
        return let(tail(w), lambda t: F.array_join(
            F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, at(i, t))), " "
        ))

    words = F.filter(F.split(text_or_empty(), "[ \t-\r]+"), lambda w: w != "")
    planted = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    of = found.withColumn("longest", longest)
    return of.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
