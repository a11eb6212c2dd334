"""Filter interaction audit by truth-table survival words.

Every document becomes a 32-bit word: bit ``S`` says whether it survives the subset ``S`` of the five
filters.  A filter is a column of the truth table, a constant word with the bits of the subsets that
leave it out; the word of a document is the conjunction of the columns of the filters it fails.

Positional popcounts of the words give the survivors of all 32 subsets, for each part and for all,
good and toxic documents.  Words are summed by carry-save adders: three words of a weight become one
of the same weight and one of twice the weight, until two words of each weight are left and only these
are read bit by bit.  Any order of the filters is a chain of subsets, so that what every step of the
120 orders keeps, removes and loses, and the Shapley value, are differences of the 32 counts.

Texts are read once, in a projection.  What moves is a row of a few numbers a document (for the
labels and for the first copy of a text) and 32 rows a part and task.

Defined results: null texts are empty texts (they fail A only, and E if a smaller id is empty too);
equal texts are told by their SHA-256; a document without an id neither fails E nor makes another
fail, and has no labels; rows that repeat an id and text do not make each other fail; an id with
several label rows is good or toxic if one of them says so; a part is a language, null and the empty
string being one part; no documents give no rows; texts of any length; other columns are not read.
"""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.llm.common import query, stored, table, text_or_empty

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 200
#: Percentages: distinct words at least, capitals at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
#: Parts whose counts a task holds before it passes them on.
HELD_PARTS = 1_000
#: Copies of the first id of a text, for rows of very common texts; documents without an id are spread alike.
SALTS = 16


def truth_column(filter_: int) -> int:
    """The subsets that leave a filter out, as bits of a word."""
    return sum(1 << s for s in range(SUBSETS) if not s >> filter_ & 1)


def failures(text: Column) -> list[Column]:
    """What filters A to D, which read the text alone, say."""
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return [
        n < MIN_WORDS,
        distinct * 100 < n * LEAST_DISTINCT,
        capitals * 100 > F.char_length(text) * MOST_CAPITALS,
        text.rlike(SYMBOLS),
    ]


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, word, good, toxic`` of every document."""
    text = text_or_empty()
    judged = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"),
        *[f.alias(f"fails_{letter}") for f, letter in zip(failures(text), FILTERS)],
    )
    rows = stored(
        judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS))), "audit-rows"
    )
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # stored, so that the join is one that Spark can split at a very common text
    copies = first.select("same", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    rows = rows.join(stored(copies, "audit-first"), ["same", "salt"], "left").drop("same", "salt")
    rows = rows.withColumn("fails_E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    word = F.lit((1 << SUBSETS) - 1).cast("bigint")
    for i, letter in enumerate(FILTERS):
        word = word.bitwiseAND(F.when(F.col(f"fails_{letter}"), F.lit(truth_column(i))).otherwise((1 << SUBSETS) - 1))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    worded = rows.select("doc_id", "part", word.alias("word"))
    with_id = worded.where("doc_id is not null").join(known, "doc_id", "left")
    without = worded.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    none = F.lit(False)
    return with_id.unionByName(without).select(
        "doc_id", "part", "word", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")
    )


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (uint32) have each bit, by carry-save addition."""
    counts, weight = np.zeros(SUBSETS, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * third :]))
        for left in words.tolist():
            counts += weight * np.fromiter((left >> s & 1 for s in range(SUBSETS)), np.int64, SUBSETS)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return counts


def _counted(frames):
    names = ["part", "subset", "n", "good", "toxic"]
    held: dict[str, np.ndarray] = {}

    def passed_on():
        counts = np.concatenate(list(held.values()), axis=1)
        parts = pa.array(np.repeat(np.array(list(held), object), SUBSETS), pa.string())
        subsets = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))
        out = pa.RecordBatch.from_arrays([parts, subsets, *[pa.array(c) for c in counts]], names)
        held.clear()
        return out

    for batch in frames:
        codes = batch.column(0).dictionary_encode()
        part = codes.indices.to_numpy()
        order = np.argsort(part, kind="stable")
        word = batch.column(1).to_numpy().astype(np.uint32)[order]
        marks = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in (2, 3)]
        edges = np.searchsorted(part[order], np.arange(len(codes.dictionary) + 1)).tolist()
        for name, a, b in zip(codes.dictionary.to_pylist(), edges, edges[1:]):
            some = word[a:b]
            counts = np.stack([positional_popcount(x) for x in (some, some[marks[0][a:b]], some[marks[1][a:b]])])
            held[name] = held[name] + counts if name in held else counts
            if len(held) >= HELD_PARTS:
                yield passed_on()
    if held:
        yield passed_on()


def subset_survivors(words: DataFrame) -> DataFrame:
    """``part, survivors``: per part an array over the 32 subsets of ``(n, good, toxic)``."""
    partial = words.select("part", "word", "good", "toxic").mapInArrow(
        _counted, "part string, subset int, n bigint, good bigint, toxic bigint"
    )
    total = partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    listed = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))  # 32 entries
    return total.groupBy("part").agg(listed.alias("survivors"))


def audit(survivors: DataFrame) -> DataFrame:
    """Every step of every order of the filters, from the survivors of the subsets."""
    orders = ",".join("".join(o) for o in itertools.permutations(FILTERS))
    steps = (
        survivors.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {at}, 1)) - 1)"
    earlier = f"aggregate(sequence(1, {len(FILTERS)}), 0, (a, k) -> a + if(k < step, {bit('k')}, 0))"
    steps = steps.withColumns({"f": F.expr(bit("step")), "before": F.expr(earlier)})
    of = lambda subset, what: F.get("survivors", subset)[what]
    after, everything = F.col("before") + F.col("f"), SUBSETS - 1
    removed = of(F.col("before"), "n") - of(after, "n")
    failing = of(F.lit(0), "n") - of(F.col("f"), "n")
    # orders in which exactly the filters of a subset come before the one of the step
    weights = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(everything)), F.lit(0).cast("bigint"),
        lambda a, s: a + F.when(
            s.bitwiseAND(F.col("f")) == 0,
            F.get(F.array(*map(F.lit, weights)), F.bit_count(s)) * (of(s, "n") - of(s + F.col("f"), "n")),
        ).otherwise(0),
    )
    return steps.select(
        "part", "filter_order", "step", of(after, "n").alias("kept"), removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (of(F.lit(everything) - F.col("f"), "n") - of(F.lit(everything), "n")).alias("unique_fails"),
        (of(F.col("before"), "good") - of(after, "good")).alias("good_lost"),
        (of(F.col("before"), "toxic") - of(after, "toxic")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part of ``docs`` (``doc_id, text, lang``), order of the filters and step."""
    return audit(subset_survivors(survival_words(docs, labels)))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"

SQL_AUDIT = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
),
j AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
      CASE WHEN len(w) < {MIN_WORDS} THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' END,
      CASE WHEN first < d.doc_id THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM j GROUP BY part, fails
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS x, fails, n, good, toxic,
    len(list_filter(fails, lambda y: instr(filter_order, y) < step)) = 0 AS here, list_contains(fails, filter_order[step]) AS failing
  FROM m, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
r AS (
  SELECT part, filter_order, step, x,
    CAST(sum(CASE WHEN here AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN here AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN NOT here AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failing AND len(fails) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN here AND failing THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN here AND failing THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", SQL_AUDIT)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
