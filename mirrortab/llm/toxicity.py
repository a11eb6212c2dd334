"""Toxicity: a linear classifier with a counterfactual penalty.

Features are the presence of words and of word beginnings.  Besides the usual log loss, training
looks at labelled sentences that mention a group of people: each is copied with the group's name
swapped for another group's, and a change of the score between the two is penalised.  A mention by
itself therefore cannot carry weight, which is what makes neutral mentions false positives.

Learning uses a sample of at most ``MAX_SAMPLE`` labelled documents (the smallest hashes of their
ids, so the sample is the same wherever it is drawn); the ids are broadcast, the texts are never
shuffled.  Document frequencies of the features are counted by Spark over the sample, the most telling
``MAX_FEATURES`` are kept, and each sampled document becomes a short list of feature numbers.  The
driver fits the weights on those bounded lists.  Every document of the corpus is scored in a narrow
pass with the broadcast weights, whole texts included.

Defined results: null and empty texts get the score of a text without known features; rows of
``labels`` without an id or a 0/1 mark are ignored, an id with contradicting marks counts as toxic; an id
that labels several documents labels them all; without any labelled document the score is the prior
0 for every text; repeated rows get equal scores; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import alnum_words, query, stored, table

#: Labelled documents that are learnt from, at most.
MAX_SAMPLE = 12_000
#: Features of the classifier, at most, and documents that one must occur in.
MAX_FEATURES, MIN_DOCUMENTS = 4_000, 3
#: Strength of the counterfactual penalty and of the squared weights, and steps of the descent.
FAIRNESS, SHRINK, STEPS = 4.0, 2e-4, 400
#: Bytes of a word's beginning, as features of their own.
BEGINNINGS = (4, 5)
#: Labels of ids with this remainder are held out.
HELD_OUT_OF = 5

#: Names of groups of people, by kind; a counterfactual swaps names of one kind.  Fixed values.
GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
)
SWAPS = {
    name.encode(): tuple(o.encode() for o in kind if o != name) for kind in GROUPS for name in kind
}


def features(words: set[bytes]) -> set[bytes]:
    """Words and their beginnings (marked by a blank, which no word holds)."""
    found = set(words)
    for k in BEGINNINGS:
        found.update(b" " + w[:k] for w in words if len(w) > k)
    return found


def counterfactuals(words: set[bytes]) -> list[set[bytes]]:
    """The same text with every group's name swapped for another of its kind, first and last choice."""
    named = [w for w in words if w in SWAPS]
    if not named:
        return []
    rest = words.difference(named)
    return [rest | {SWAPS[w][at] for w in named} for at in (0, -1)]


def is_held_out(doc_id: Column) -> Column:
    """Null ids are held out: they cannot be labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(True))


@dataclass
class Classifier:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -50.0

    def score(self, text: str | None) -> float:
        get = self.weights.get
        margin = self.bias + sum(map(get, self.weights.keys() & features(set(alnum_words(text)))))
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_SAMPLE) -> DataFrame:
    """``text, toxic`` of sampled documents that are not held out, stored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    marks = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = stored(chosen, "toxicity-labels")  # at most ``limit`` rows of two numbers
    return stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")


def _count(frames):
    """Per batch: documents of each mark that hold a feature."""
    for batch in frames:
        counts: dict[bytes, list[int]] = {}
        for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
            for f in features(set(alnum_words(text.as_py()))):
                counts.setdefault(f, [0, 0])[mark] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *(pa.array([counts[k][m] for k in keys], pa.int64()) for m in (0, 1))],
            ["feature", "clean", "toxic"],
        )


def telling_features(sample: DataFrame, clean: int, toxic: int, limit: int = MAX_FEATURES) -> list[bytes]:
    """The features whose document frequencies differ most, by the chi-square statistic."""
    counts = sample.select("text", "toxic").mapInArrow(_count, "feature binary, clean bigint, toxic bigint")
    n = counts.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    total = float(clean + toxic)
    both = F.col("c") + F.col("t")
    apart = F.col("t") * float(clean) - F.col("c") * float(toxic)
    chi = total * apart * apart / (both * (total - both) * float(clean) * float(toxic))
    best = (
        n.where((both >= MIN_DOCUMENTS) & (both < total)).select("feature", chi.alias("chi"))
        .orderBy(F.desc("chi"), "feature").limit(limit)
    )
    return [bytes(r[0]) for r in best.collect()]


def _rows(sample: DataFrame, names: list[bytes]) -> list:
    """``(toxic, feature numbers, numbers of each counterfactual...)`` of the sampled documents."""
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(frames):
        number = shared.value
        packed = lambda words: np.sort(np.fromiter((number[f] for f in features(words) if f in number), np.int32)).tobytes()
        for batch in frames:
            marks, own, swapped = [], [], []
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(alnum_words(text.as_py()))
                marks.append(mark)
                own.append(packed(words))
                swapped.append([packed(w) for w in counterfactuals(words)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.int32()), pa.array(own, pa.binary()), pa.array(swapped, pa.list_(pa.binary()))],
                ["toxic", "own", "swapped"],
            )

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, own binary, swapped array<binary>").collect()


class _Lists:
    """Lists of feature numbers, multiplied with weights like a 0/1 matrix."""

    def __init__(self, packed: list[bytes]) -> None:
        parts = [np.frombuffer(p, np.int32) for p in packed]
        self.n = len(parts)
        self.column = np.concatenate([*parts, np.empty(0, np.int32)])
        self.row = np.repeat(np.arange(self.n), [len(p) for p in parts])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, r[self.row], size)


def fit_weights(rows, size: int, fairness: float = FAIRNESS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimise log loss (either mark weighs half) + ``fairness`` x mean squared change of the margin + squared weights (Adam)."""
    y = np.array([r[0] for r in rows], float)
    x = _Lists([bytes(r[1]) for r in rows])
    origin = [i for i, r in enumerate(rows) for _ in r[2]]
    swapped = _Lists([bytes(s) for r in rows for s in r[2]])
    balance = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = x.times(w[:size]) + w[size]
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        grad = np.append(x.back(error, size), error.sum()) / len(y)
        grad[:size] += 2 * SHRINK * w[:size]
        if origin:
            change = margin[origin] - (swapped.times(w[:size]) + w[size])
            pull = np.bincount(origin, change, len(y))
            grad[:size] += 2 * fairness * (x.back(pull, size) - swapped.back(change, size)) / len(origin)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS, limit: int = MAX_SAMPLE) -> Classifier:
    sample = labelled_sample(docs, labels, limit)
    seen = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not seen:
        return Classifier()
    if len(seen) == 1:
        return Classifier({}, 50.0 if 1 in seen else -50.0)
    names = telling_features(sample, seen[0], seen[1])
    weights, bias = fit_weights(_rows(sample, names), len(names), fairness)
    return Classifier({f: float(w) for f, w in zip(names, weights) if w}, bias)


def scored(docs: DataFrame, model: Classifier, text: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``to``: the score from 0 to 1; a column called so already is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    kept = docs.drop(to)
    where, columns = kept.columns.index(text), kept.columns
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(kept.schema.fields)]).add("score", "double")

    def run(frames):
        score = shared.value.score
        for batch in frames:
            found = pa.array([score(t.as_py()) for t in batch.column(where)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema.names)

    return kept.mapInArrow(run, schema).toDF(*columns, to)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs, model)
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
