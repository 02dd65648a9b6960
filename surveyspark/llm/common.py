"""Helpers shared by the operators: inputs, stage tables, fold of a row."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def row_key() -> Column:
    """Names the rows of equal id and text: SHA-256 of the text in hex, then the id (nothing for null)."""
    return F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def id_of(key: str) -> Column:
    """The id in a row key."""
    return F.nullif(F.substring(key, 65, 20), F.lit("")).cast("long")


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0 as crc32('')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="llm-stages-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return posixpath.join(shared, f"{name}-{uuid.uuid4().hex}")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Bounds the rows that pass to Python at once in what is run meanwhile: for rows that hold
    whole texts or packed arrays."""
    before = spark.conf.get(_ARROW_ROWS)
    try:
        if rows is not None:
            spark.conf.set(_ARROW_ROWS, str(rows))
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def written(df: DataFrame, name: str, rows: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Write a stage table to the shared folder and go on from the written copy.

    The copy outlives lost executors and later plans start from one scan of it.
    ``rows``: see ``arrow_rows``, while it is written. ``by``: columns whose values get folders of their own.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with arrow_rows(spark, rows):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    return copy.select(*df.columns) if by else copy
