"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most four bits exactly if some value differs from each in at most
two.  So every distinct fingerprint emits the 2,081 values of its ball of radius two, the values are
shuffled, and fingerprints that meet at a value are linked.  A meeting at a value proves a distance of
four at most, and any two fingerprints within four meet, so nothing is missed or assumed.

The balls of a corpus are thousands of values for each fingerprint, too many for rows.  They travel
packed (:mod:`mirrortab.llm.packed`), shortened to a width that leaves few chance meetings; blocks of
fingerprints learn which of their values are repeated, and only those are emitted as rows
``(value, fingerprint)``, verified by equality of the whole value.  A value links its fingerprints to
the smallest one there, never all pairs, so a thousand copies give a thousand links.

Documents are hashed where they lie; equal fingerprints are counted first and travel once.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked
like any other; texts of fewer than four words have one shingle; repeated rows share a component; the
component of documents without an id is the smallest id in it, null if there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import blank_words, query, stored, table
from mirrortab.llm.graph import components
from mirrortab.llm.packed import SENT, Members, gathered, part_bits, repeated_hashes, sent

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a block.
BLOCK = 2_048
#: Blocks that one task computes.
BLOCKS_OF_TASK = 4
#: Copies of a component's smallest key that its rows are dealt over when they look it up.
SALTS = 32
#: Bits by which the shortened values exceed the number of values: one in 2 ** SPARE meets by chance.
SPARE = 8


def fingerprint(text: str | None) -> int:
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        some = hashes[at : at + 65_536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def ball_masks() -> np.ndarray:
    """The 2,081 patterns of at most two of 64 bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate((np.zeros(1, np.uint64), one, one[i] | one[j]))


MASKS = ball_masks()


def shortened(values: np.ndarray, width: int) -> np.ndarray:
    """The leading ``width`` bits of a mixed value."""
    x = values * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - width)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row; only this pass reads texts."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())
    ])

    def run(frames):
        for batch in frames:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], schema.names
            )

    return rows.mapInArrow(run, schema)


def linked(fps: DataFrame, count: int) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that join all within the radius."""
    total = max(1, count) * len(MASKS)
    width = min(64, total.bit_length() + SPARE)
    bits = part_bits(total)
    blocks = -(-max(1, count) // BLOCK)
    placed = fps.select(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(blocks)).alias("block"), "fp").repartition(
        -(-blocks // BLOCKS_OF_TASK), "block"
    )

    def balls(key, group):
        own = group.column("fp").to_numpy().view(np.uint64)
        values = np.empty((len(own), len(MASKS)), np.uint64)
        for at in range(0, len(own), 128):
            values[at : at + 128] = shortened(own[at : at + 128, None] ^ MASKS, width)
        return sent(key[0].as_py(), values.ravel(), width, bits)

    def meetings(own, answers):
        fps_, met = own.column("fp").to_numpy().view(np.uint64), gathered(answers)
        values, owners = [], []
        if len(met):
            members = Members(met)
            for at in range(0, len(fps_), 128):
                ball = fps_[at : at + 128, None] ^ MASKS
                hit = members.of(shortened(ball.ravel(), width))
                values.append(ball.ravel()[hit])
                owners.append(np.repeat(fps_[at : at + 128], len(MASKS))[hit])
        whole = lambda parts: pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64))
        return pa.table([whole(values), whole(owners)], ["value", "fp"])

    answers = repeated_hashes(placed.groupBy("block").applyInArrow(balls, SENT))
    met = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meetings, "value bigint, fp bigint")
    # a value has 2,081 fingerprints around it at most, so this window's groups are bounded
    least = F.min("fp").over(Window.partitionBy("value"))
    return met.withColumn("b", least).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def clustered(rows: DataFrame, key) -> DataFrame:
    """``fp, least``: the smallest ``key`` in the component of every fingerprint of ``rows``.

    Keys are reduced by fingerprint before components are joined; the fingerprints of a large
    component meet copies of its smallest key, so that it needs no task of its own.
    """
    own = stored(rows.groupBy("fp").agg(F.min(key).alias("own")), "simhash-own")
    roots = components(linked(own.select("fp"), own.count()))
    roots = stored(roots.withColumnRenamed("node", "fp").join(own, "fp"), "simhash-roots")
    least = roots.groupBy("root").agg(F.min("own").alias("least"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = roots.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(copies, ["root", "salt"])
    return own.join(known.select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "own").alias("least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = stored(fingerprints(docs), "simhash")
    # stored, so that the join is one that Spark can split at a fingerprint of very many rows
    return rows.join(stored(clustered(rows, F.col("doc_id")), "simhash-components"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest text hash.

    Rows without an id come last.  Nothing but the kept keys meets the texts, in one join.  Only if
    several rows share a kept key (repeated rows) are those compared with each other.
    """
    rows = stored(fingerprints(docs), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    kept = stored(clustered(rows, key).select("least.*").distinct(), "simhash-kept")
    named = "_".join(["kept", *sorted(docs.columns)])
    keyed = docs.withColumn(named, F.xxhash64("text"))
    is_kept = lambda df, hashed: df["doc_id"].eqNullSafe(kept["doc_id"]) & (df[hashed] == kept["text_hash"])
    out = keyed.join(kept, is_kept(keyed, named), "left_semi")
    ties = rows.join(kept, is_kept(rows, "text_hash"), "left_semi").groupBy("doc_id", "text_hash").count()
    if ties.where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", named])
    return out.drop(named)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
