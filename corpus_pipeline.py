"""A corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``docs``; the last adds the ids and what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.llm import bpe, decontaminate, pii, simhash, toxicity
from mirrortab.llm.common import bounded_batches, stored, table
from mirrortab.sources.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepare(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier learns from those of ``docs`` that have labels.

    Null and empty texts are scored like any other, by the classifier's bias; texts of any length are read
    whole; repeated rows share a score; without labels of both kinds nothing is learnt; an empty table
    stays empty; all columns stay, whatever their names.
    """
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = "_".join(["score", *sorted(docs.columns)])  # a name no column has
    return toxicity.scored(docs, model, to=score).where(F.col(f"`{score}`") < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.

    That is the one of the smallest id, then of the smallest text hash; rows without an id come last.
    Repeated rows are one; null, empty and blank texts are one group, having fingerprint zero; texts of any
    length are read whole; an empty table stays empty; all columns stay, whatever their names.
    """
    prepare(spark)
    return simhash.near_deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is covered by benchmark windows go.

    Null and empty texts stay, they have no words; texts of any length are read whole; repeated rows are
    judged alike; an empty table stays empty, and an empty benchmark removes nothing; all columns stay,
    whatever their names.
    """
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; a column ``n_chars`` follows the text.

    Null and empty texts stay; texts of any length are read whole; equal values, in repeated rows too, get
    equal pseudonyms; an empty table stays empty; all other columns stay, whatever their names.
    """
    prepare(spark)
    done = pii.pseudonymised(docs, pii.EXAMPLE_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded``.

    Null and empty texts have no ids; texts of any length are coded whole; repeated rows are coded alike; an
    empty table stays empty; columns that are called like the added ones are replaced, all others stay.
    """
    prepare(spark)
    coded = bpe.encode(docs, bpe.default_path(), decoded="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("tokens", tokenise),
]

#: No SQL says the classifier's training or the tokens; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
