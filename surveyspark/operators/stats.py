"""Prevalence, importance and profile aggregates, with ranking and top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut


def prevalence(df: DataFrame, outcome: str) -> DataFrame:
    """Valid n and unweighted prevalence of a nullable 0/1 outcome."""
    return df.agg(F.count(outcome).alias("n_valid"), F.avg(outcome).alias("prevalence"))


def weighted_prevalence(
    df: DataFrame, group: str, outcome: str = "sba", weight: str = "weight"
) -> DataFrame:
    """n, weighted and unweighted prevalence per non-null group."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.sum(F.col(outcome) * F.col(weight)), F.sum(weight)).alias(
                f"weighted_{outcome}_prevalence"
            ),
            F.avg(outcome).alias(f"unweighted_{outcome}_prevalence"),
        )
    )


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Class counts and the positive-class weight n_neg / n_pos."""
    counts = df.agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")
    )
    return counts.withColumn(
        "pos_weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos"))
    )


def importance_long(
    phi: DataFrame, feature: str = "feature", value: str = "phi", weight: str = "weight"
) -> DataFrame:
    """Weighted and unweighted mean absolute value per feature of a long table."""
    size = F.abs(F.col(value))
    return phi.groupBy(feature).agg(
        F.try_divide(F.sum(size * F.col(weight)), F.sum(weight)).alias("weighted_mean_abs_shap"),
        F.avg(size).alias("unweighted_mean_abs_shap"),
    )


def importance_wide(
    phi: DataFrame, columns: dict[str, str], weight: str = "weight"
) -> DataFrame:
    """The same from a wide table; ``columns`` maps feature name to phi column.

    One row per observation goes in, and one aggregated row is unpivoted: the
    long form of rows x features is never built.
    """
    aggregated = phi.agg(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.try_divide(F.sum(F.abs(F.col(c)) * F.col(weight)), F.sum(weight)).alias(
                    "weighted_mean_abs_shap"
                ),
                F.avg(F.abs(F.col(c))).alias("unweighted_mean_abs_shap"),
            ).alias(f"f_{i}")
            for i, (name, c) in enumerate(columns.items())
        ]
    )
    rows = F.array(*[F.col(f"f_{i}") for i in range(len(columns))])
    return aggregated.select(F.inline(rows))


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Add ``rank`` from 1 by descending value.

    For result tables with one row per feature: the window has no partition and
    must never see more than such a table.
    """
    return df.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc(value), F.asc(tie)))
    )


def top_k(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(tie)).limit(k)


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value.

    Counts are combined first, so a group contributes one row per distinct
    value; ``max_by`` then needs no sort.
    """
    counts = df.filter(F.col(group).isNotNull()).groupBy(group, value).count()
    best = counts.groupBy(group).agg(F.max("count").alias("n"))
    return (
        counts.join(best, group)
        .filter(F.col("count") == F.col("n"))
        .groupBy(group)
        .agg(F.min(value).alias(value), F.first("n").alias("n"))
    )


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample standard deviation and count per group."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )


def value_states(df: DataFrame, columns: Sequence[str], whole: Sequence[str], limit: int) -> DataFrame:
    """(column, low, high, values) of each task: its extremes and its ``limit`` + 1 smallest
    distinct values, of the columns in ``whole`` all of them. Nulls do not count; NaN counts
    as the largest value."""
    columns, whole = list(columns), set(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        ends: dict[str, tuple[float, float]] = {}
        for batch in batches:
            for name, column in zip(columns, batch.columns):
                found = np.unique(column.drop_null().to_numpy(zero_copy_only=False))  # NaN comes last
                if not len(found):
                    continue
                if name in held:
                    low, high = ends[name]
                    ends[name] = np.fmin(low, found[0]), found[-1] if np.isnan(found[-1]) else np.maximum(high, found[-1])
                    found = np.unique(np.concatenate([held[name], found]))
                else:
                    ends[name] = found[0], found[-1]
                held[name] = found if name in whole else found[: limit + 1]
        names = list(held)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([ends[n][0] for n in names], pa.float64(), from_pandas=False),
            pa.array([ends[n][1] for n in names], pa.float64(), from_pandas=False),
            pa.array([held[n].tolist() for n in names], pa.list_(pa.float64())),
        ], ["column", "low", "high", "values"])

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.mapInArrow(run, "column string, low double, high double, values array<double>")


def training_profile(
    df: DataFrame, columns: Sequence[str], never_continuous: Sequence[str] = ("region_stratum",),
    distinct_limit: int = 10,
) -> DataFrame:
    """Per column: min, max, whether it counts as continuous (more than
    ``distinct_limit`` values, and not a declared category), and the values of a
    categorical column.

    Tasks keep a bounded state per column, so a continuous column's values are never
    shuffled: a column with more distinct values than the limit in all has more than it
    in some task, or in what the tasks kept.
    """
    states = value_states(df, columns, never_continuous, distinct_limit)
    ends = states.groupBy("column").agg(F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    distinct = states.select("column", F.explode("values").alias("value")).distinct()
    listed = distinct.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    continuous = (F.size("values") > distinct_limit) & ~F.col("column").isin(list(never_continuous))
    return ends.join(listed, "column").select(
        "column", "min_value", "max_value", continuous.alias("is_continuous"),
        F.when(~continuous, F.col("values")).alias("values"),
    )


def column_profile(
    df: DataFrame, columns: Sequence[str], never_continuous: Sequence[str] = ("region_stratum",),
    distinct_limit: int = 10,
) -> DataFrame:
    """The training profile and the exact number of distinct values of each column.

    Only for reports: counting a continuous column's values shuffles them. Searches and
    filters use ``training_profile``.
    """
    profile = cut(training_profile(df, columns, never_continuous, distinct_limit))
    many = [r[0] for r in profile.filter("is_continuous").select("column").collect()]  # names of columns
    if not many:
        return profile.withColumn("n_distinct", F.size("values").cast("long"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in many])
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    counted = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return profile.join(counted, "column", "left").withColumn(
        "n_distinct", F.coalesce("n", F.size("values").cast("long"))
    ).drop("n")


def fold_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias(f"{value}_mean"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of result frames or survey rounds."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
