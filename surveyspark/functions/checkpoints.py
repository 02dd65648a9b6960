"""Reliable checkpoints: the shared folder they go to, and cutting lineage."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for a local run."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="surveyspark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    The copy survives lost executors, later jobs do not repeat the work, and the
    plans built on top start from a single scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return posixpath.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table: for copies that are put in a union, whose plan
    must not carry constraints on columns the copy no longer has."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
