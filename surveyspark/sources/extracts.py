"""Scans of survey extracts and sinks for stage and result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from surveyspark.params import BIRTH_COLUMNS, CLUSTER_COLUMNS, WOMEN_COLUMNS

_LONG_COLUMNS = {"v005"}
_TEXT_COLUMNS = {"caseid"}


def _extract_schema(names: Iterable[str], required: set[str]) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name in _TEXT_COLUMNS:
            return T.StringType()
        return T.LongType() if name in _LONG_COLUMNS else T.IntegerType()

    return T.StructType([T.StructField(n, kind(n), n not in required) for n in names])


BIRTHS_SCHEMA = _extract_schema(BIRTH_COLUMNS, {"caseid", "bidx"})
WOMEN_SCHEMA = _extract_schema(WOMEN_COLUMNS, {"caseid"})


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{what}: required columns not found: {missing}")


def scan_extract(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    pattern: str | None = None,
    schema: T.StructType | None = None,
    format: str = "parquet",
    several: str = "union",
    **options,
) -> DataFrame:
    """Read only ``columns`` of the extract files found below ``root``.

    No file at all is an error. Of several files that match, ``several`` says what
    to read: "union" all of them (the parts of one table), "first" the first by
    path, "error" none.

    ``pattern`` is a file-name glob searched at every depth. It is
    case-sensitive. With a ``schema`` the declared types are enforced by the
    reader; without one, Parquet's own schema is used.
    """
    reader = spark.read.format(format).options(**options)
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(root)
    files = sorted(df.inputFiles())
    if not files:
        raise FileNotFoundError(f"extract {root}: no file matches {pattern or 'it'}")
    if len(files) > 1 and several == "error":
        raise ValueError(f"extract {root}: {len(files)} files match {pattern}")
    if len(files) > 1 and several == "first":
        df = (reader.schema(schema) if schema is not None else reader).load(files[0])
    require_columns(df, columns, f"extract {root}")
    return df.select(*columns)


def cluster_attributes(df: DataFrame) -> DataFrame:
    """Keep the four cluster attributes, whatever the case of their names."""
    wanted = set(CLUSTER_COLUMNS)
    return df.select(*[F.col(c).alias(c.upper()) for c in df.columns if c.upper() in wanted])


def scan_clusters(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    """Cluster attribute table, or None where the source does not exist."""
    try:
        return cluster_attributes(spark.read.format(format).load(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Materialise a stage. The table also cuts lineage for later stages."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read an earlier stage; a missing one is an error that names the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{path} not found: run the earlier stage first") from error
        raise


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
