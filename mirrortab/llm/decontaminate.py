"""Benchmark decontamination: a broadcast set of benchmark windows, scanned over the documents.

A window is 13 consecutive words of a benchmark item, or the whole item if it has fewer words.
Documents are scanned in place: no shuffle, one narrow pass for each block of benchmark windows.
A block holds at most ``BLOCK_BYTES`` of benchmark text, which bounds what is broadcast; a larger
benchmark is scanned in several passes, each stored before the next, so nothing is left out.

In a document every word is replaced by its number in the block's vocabulary.  Only runs of known
words can hold a window; there the exact tuple of word numbers is looked up, so a hit is verified
by equality and never rests on a hash alone.

Defined results: null or empty texts have no words and no hits; an item without words has no
window; repeated documents are each judged, repeated items are one; items with the same id count once;
an item id of null is listed as the empty string; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import alnum_words, query, stored, table
from mirrortab.operators.core import running_total

#: Words of a window.
WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
#: Benchmark text that one broadcast may hold.
BLOCK_BYTES = 2_000_000
#: Words of a piece that a long item is cut into (pieces overlap by a window less one word).
PIECE_WORDS = 4096

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_BUILT: dict[int, tuple] = {}


def fresh(columns, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _pieces(frames):
    """Cut items into overlapping pieces of bounded size, every window whole in one of them."""
    for batch in frames:
        ids, texts = (c.to_pylist() for c in batch.columns)
        size, out_id, out_words = [], [], []
        for item, text in zip(ids, texts):
            words = alnum_words(text)
            step = PIECE_WORDS - WINDOW + 1
            for start in range(0, max(len(words) - WINDOW + 1, min(1, len(words))), step):
                piece = b" ".join(words[start : start + PIECE_WORDS])
                out_id.append("" if item is None else item)
                out_words.append(piece)
                size.append(len(piece))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_id, pa.string()), pa.array(out_words, pa.binary()), pa.array(size, pa.int64())],
            ["item", "words", "size"],
        )


def benchmark_blocks(benchmark: DataFrame, block_bytes: int | None = None):
    """Broadcasts of distinct ``(item, words)`` pieces, each of ``block_bytes`` and one piece at most.

    Repeated items are one; pieces are cut once and stored, and dealt to blocks by their running size.
    """
    spark, block_bytes = benchmark.sparkSession, block_bytes or BLOCK_BYTES
    pieces = benchmark.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(
        _pieces, "item string, words binary, size bigint"
    )
    pieces = stored(pieces.distinct().withColumns({"all": F.lit(0), "place": F.sha2("words", 256)}), "benchmark-pieces")
    run = running_total(pieces.select("all", "place", "item", "size"), ["all"], ["place", "item"], "size")
    block = F.floor((F.col("cum") - F.col("size")) / block_bytes).cast("bigint")
    placed = pieces.select("place", "item", "words").join(run.select("place", "item", block.alias("block")), ["place", "item"])
    placed = stored(placed.select("block", "item", "words"), "benchmark-blocks")
    for b in range((placed.agg(F.max("block")).first()[0] or 0) + 1):
        rows = placed.where(F.col("block") == b).select("item", "words").collect()
        yield spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows])


def _windows(shared) -> tuple[dict, dict, list[int]]:
    """Vocabulary, window -> items, window lengths; built once in a worker."""
    pieces = shared.value
    key = id(pieces)
    built = _BUILT.get(key)
    if built is None:
        number: dict[bytes, int] = {}
        windows: dict[tuple, list[str]] = {}
        for item, words in pieces:
            ids = [number.setdefault(w, len(number)) for w in words.split()]
            length = min(WINDOW, len(ids))
            for i in range(len(ids) - length + 1):
                items = windows.setdefault(tuple(ids[i : i + length]), [])
                if item not in items:
                    items.append(item)
        _BUILT.clear()
        _BUILT[key] = built = (number, windows, sorted({len(w) for w in windows}), pieces)
    return built[:3]


def hits(words: list[bytes], number: dict, windows: dict, lengths: list[int]) -> tuple[list[int], set[str]]:
    """Covered spans of words as a flat list ``start, end, start, end, ...``, and the items."""
    spans: list[int] = []
    items: set[str] = set()
    if not lengths or len(words) < lengths[0]:
        return spans, items
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    edge = np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if end - start < lengths[0]:
            continue
        run = ids[start:end].tolist()
        for i in range(len(run) - lengths[0] + 1):
            reach = 0
            for length in lengths:
                if i + length > len(run):
                    break
                found = windows.get(tuple(run[i : i + length]))
                if found:
                    items.update(found)
                    reach = length
            if reach:
                if spans and spans[-1] >= start + i:
                    spans[-1] = max(spans[-1], start + i + reach)
                else:
                    spans += (start + i, start + i + reach)
    return spans, items


def merged(spans: list[int], more: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(spans[::2], spans[1::2]), *zip(more[::2], more[1::2])]):
        if out and out[-1] >= s:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int | None = None
) -> tuple[DataFrame, str]:
    """``docs`` and a struct column ``(n_words, spans, items)``; returns the column's name too."""
    name = fresh(docs.columns, "contamination")
    found = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    out = docs
    for turn, shared in enumerate(benchmark_blocks(benchmark, block_bytes)):
        if turn:
            out = stored(out, "decontaminate")
        where, later = docs.columns.index(text), turn > 0

        def one_pass(frames, shared=shared, where=where, later=later):
            sets = _windows(shared)
            for batch in frames:
                before = batch.column(batch.num_columns - 1).to_pylist() if later else repeat(None)
                rows = []
                for value, old in zip(batch.column(where).to_pylist(), before):
                    words = alnum_words(value)
                    spans, items = hits(words, *sets)
                    if old:
                        spans, items = merged(old["spans"], spans), items | set(old["items"])
                    rows.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
                columns = list(batch.columns)[: batch.num_columns - later]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(rows, kind)], [str(i) for i in range(len(columns))] + ["found"]
                )

        schema = T.StructType([*docs.schema.fields, T.StructField(name, found)])
        out = out.mapInArrow(one_pass, _numbered(schema)).toDF(*docs.columns, name)
    return out, name


def _numbered(schema: T.StructType) -> T.StructType:
    """The schema with positions as names, so that columns may have any name."""
    last = len(schema.fields) - 1
    return T.StructType(
        [T.StructField("found" if i == last else str(i), f.dataType, True) for i, f in enumerate(schema.fields)]
    )


def n_hit(found) -> F.Column:
    spans = found["spans"]
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )


def is_contaminated(found) -> F.Column:
    return (n_hit(found) > 0) & (n_hit(found) * SHARE >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """Drop contaminated documents, or cut every hit span out of the texts.

    ``remove="documents"`` drops the rows of which a share of ``1 / SHARE`` of the words or more
    is hit; ``remove="spans"`` keeps all rows and removes the hit words from their texts.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    marked, name = scan(docs, benchmark)
    found = F.col(f"`{name}`")
    if remove == "documents":
        return marked.where(~is_contaminated(found)).drop(name)

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, flat):
            if text is None or flat is None or not len(flat):
                return text
            at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
            kept, last = [], 0
            for s, e in zip(flat[::2], flat[1::2]):
                kept.append(text[last : at[s][0]])
                last = at[e - 1][1]
            return "".join([*kept, text[last:]])

        return texts.combine(spans, one)

    return marked.withColumn("text", cut(F.col("text"), found["spans"])).drop(name)


_LOWER = {b: b + 32 for b in range(0x41, 0x5B)}

_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

SQL_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
),
hit AS (SELECT doc_id, item, i, n FROM places JOIN bw USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items, a digest of the items, and the verdict."""
    marked, name = scan(docs.select("doc_id", "text"), benchmark)
    found = F.col(f"`{name}`")
    return marked.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(found["items"])), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


@query("op3_decontaminate", SQL_DECONTAMINATE)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
