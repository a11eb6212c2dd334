"""Helpers the text operators share: words of bytes, tables in the shared folder, registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a blank.
#: Bytes from 0x80 on (all of a non-ASCII character) stay, so splitting at blanks gives the words
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


#: Rows of an Arrow batch between the JVM and Python, at most: texts can be long.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in the folder that the cluster shares."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, keeps columns prunable.

    The schema is passed on, so an empty table keeps its columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` has written, once its successor is written."""
    path = getattr(df, "stored_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without_clash(df: DataFrame, name: str, replaced: str | None = None) -> DataFrame:
    """``df`` without a column ``name`` (other than ``replaced``), for a result to take its place.

    A column that differs from ``name`` in case only is refused.
    """
    if name == replaced:
        return df
    if any(c != name and c.lower() == name.lower() for c in df.columns):
        raise ValueError(f"a column differs from {name!r} in case only: rename it or choose another name")
    return df.drop(name)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of up to ``size`` items."""
    chunk: list = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
