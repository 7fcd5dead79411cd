"""Shared pieces of the corpus operators.

Conventions that every operator follows:

* Columns are taken by their exact name; extra columns, whatever they are called, are ignored.
* A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. ``bytes.split()`` cuts at exactly these
  six characters, so texts are handled as UTF-8 bytes and never decoded for counting.
* A null text counts as an empty one.
* A document is identified by (doc_id, 64-bit hash of its text): rows that repeat both are one document
  and get equal results.
* Intermediate tables are written below ``spark.checkpoint.dir``, which every executor can read;
  lineage is cut there, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, shared_dir, written  # noqa: F401  used by the operators

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ARROW_BYTES = "4m"


def bounded(spark: SparkSession) -> SparkSession:
    """Holds the session's Arrow batches at ``ARROW_BYTES``: counted in rows, a batch of long texts would take hundreds of MB in a task's
    Python worker, and as much again in its JVM. Queries and pipeline stages call it where they start; operators leave the session alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables."""
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, even beside columns that differ from them only in case."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with null texts made empty, and ``key``, the text's hash."""
    return pick(docs, *columns).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", text_hash(F.col("text")))
