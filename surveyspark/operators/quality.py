"""Data-quality profiles, guards and cleaning filters.

Profiles are one aggregation pass over the table whatever the number of
columns; the unpivot that follows works on a single row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surveyspark.sources.extracts import require_columns


def _one_row_to_long(row: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """Turn a one-row table into (column, value) rows."""
    return row.unpivot([], list(names), "column", value)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null) for the given columns."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _one_row_to_long(row, columns, "n_null")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_share) unrounded, as a percentage."""
    row = df.agg(
        *[F.avg(F.col(c).isNull().cast("double") * 100.0).alias(c) for c in columns]
    )
    return _one_row_to_long(row, columns, "null_share")


def missingness_profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` columns by percentage null, rounded to one decimal."""
    rounded = missingness(df, columns).select(
        "column", F.round("null_share", 1).alias("pct_null")
    )
    return rounded.orderBy(F.desc("pct_null"), "column").limit(top)


def fully_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with no value at all (tested before rounding)."""
    return missingness(df, columns).filter(F.col("null_share") == 100.0).select("column")


def complete_case(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """Rows where every required column has a value.

    Written as separate is-not-null tests: they reach the Parquet scan, which a
    single "at least n non-nulls" test does not.
    """
    require_columns(df, required, what)
    return df.filter(all_present(required))


def all_present(required: Sequence[str]) -> Column:
    """True where every column has a value."""
    return reduce(and_, [F.col(name).isNotNull() for name in required])


def complete_case_counts(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """Rows before, kept and removed by the complete-case filter, in one pass."""
    require_columns(df, required, what)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(all_present(required)).alias("n_kept"),
    )
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_kept"))


def guarded_complete_case(
    df: DataFrame, required: Sequence[str], what: str, guard: DataFrame | None = None
) -> DataFrame:
    """Complete-case filter that fails the job if it would remove every row.

    The guard is a scalar subquery over the null flags of the required columns,
    so the filter itself stays lazy. It reads ``guard``, the same rows, if given.
    """
    everything_lost = F.raise_error(
        F.lit(f"{what}: complete-case filtering removed ALL rows")
    ).cast("boolean")
    verdict = complete_case_counts(df if guard is None else guard, required, what).select(
        F.when((F.col("n_before") > 0) & (F.col("n_kept") == 0), everything_lost).otherwise(True)
    )
    # Filtering the whole input (not the survivors) makes the guard run even
    # when nothing survives.
    return df.filter(verdict.scalar()).filter(all_present(required))


def fill_skip_pattern(df: DataFrame, columns: Sequence[str], sentinel: int) -> DataFrame:
    """Recode structurally missing values; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.fillna(sentinel, subset=present)


def skip_pattern_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_recoded): how many values ``fill_skip_pattern`` would change."""
    present = [c for c in columns if c in df.columns]
    return null_counts(df, present).withColumnRenamed("n_null", "n_recoded")


def _implausible(column: str, maximum: float) -> Column:
    return F.coalesce(F.col(column) > maximum, F.lit(False))


def plausible(df: DataFrame, column: str, maximum: float) -> DataFrame:
    """Rows at or below the maximum. A null is not implausible and stays."""
    return df.filter(~_implausible(column, maximum))


def implausible(
    df: DataFrame, column: str, maximum: float, ids: Sequence[str] = ("caseid", "bidx", "v024")
) -> DataFrame:
    """The complement of ``plausible``: ids and offending value."""
    kept_ids = [c for c in ids if c in df.columns]
    return df.filter(_implausible(column, maximum)).select(*kept_ids, column)


def eligibility_consistency(
    df: DataFrame, recency: str, maximum: int, attendants: Sequence[str]
) -> DataFrame:
    """Rows in the window against rows with any attendant answer, before filtering."""
    answered = F.coalesce(*[F.col(c) for c in attendants]).isNotNull()
    counts = df.agg(
        F.count_if(F.col(recency) <= maximum).alias("n_in_window"),
        F.count_if(answered).alias("n_answered"),
    )
    return counts.withColumn("matches", F.col("n_in_window") == F.col("n_answered"))


def matrix_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of a model matrix that still hold nulls, with their counts."""
    return null_counts(df, columns).filter("n_null > 0")


def assert_no_nulls(df: DataFrame, columns: Sequence[str], what: str = "model matrix") -> DataFrame:
    """Pass rows through, failing the job on the first null in ``columns``."""
    problem = F.raise_error(F.lit(f"{what} still contains missing values")).cast("boolean")
    return df.filter(F.when(all_present(columns), True).otherwise(problem))


def _funnel_counts(stages: Sequence[tuple[str, Column]]) -> list[Column]:
    """n_0, n_1, ...: rows in all, and rows that passed the first 1, 2, ... stages."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("n_0")]
    for i, (_, condition) in enumerate(stages, start=1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n_{i}"))
    return counts


def _funnel_table(row: DataFrame, names: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("stage"),
            F.col(f"n_{i - 1}").alias("n_before"),
            F.col(f"n_{i}").alias("n_after"),
        )
        for i, name in enumerate(names, start=1)
    ]
    return row.select(F.inline(F.array(*entries))).withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def stage_funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows surviving each successive filter, counted in one pass.

    Each stage is (name, condition); a row reaches a stage only if it passed
    all earlier ones. A null condition counts as not passed.
    """
    return _funnel_table(df.agg(*_funnel_counts(stages)), [name for name, _ in stages])


class Funnel:
    """The same counts, observed while a job reads the rows anyway.

    ``watch`` marks the rows; whatever action first runs on them fills the counts, and
    ``table`` waits for it. Filters above the mark are not pushed below it.
    """

    def __init__(self, name: str):
        self._observation = Observation(f"funnel of {name}")
        self._names: list[str] = []

    def watch(self, df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
        self._names = [name for name, _ in stages]
        return df.observe(self._observation, *_funnel_counts(stages))

    def table(self, spark: SparkSession) -> DataFrame:
        counts = self._observation.get
        row = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))
        return _funnel_table(row, self._names)


def label_collisions(codebook: DataFrame) -> DataFrame:
    """Labels shared by two or more codes of a (code, label) table.

    A codebook has one row per variable, so the code list is small.
    """
    return (
        codebook.groupBy("label")
        .agg(
            F.count_distinct("code").alias("n_codes"),
            F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"),
        )
        .filter("n_codes > 1")
    )


def category_coverage(
    query: DataFrame, train: DataFrame, column: str, stratum: str
) -> DataFrame:
    """Distinct values of ``column`` in each stratum of the query sample, next to
    the values seen in training and the query values training never saw.

    Both sides are made distinct before collecting, so what one task gathers is
    the column's category set and not its rows.
    """
    def category_list(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        values = df.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
        return values.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias(name))

    seen = category_list(train, [], "seen").scalar()
    joined = category_list(query, [stratum], "asked").withColumn("seen", seen)
    as_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return joined.select(
        stratum,
        as_text(F.col("asked")).alias("query_values"),
        as_text(F.col("seen")).alias("train_values"),
        F.size(F.array_except("asked", "seen")).alias("n_unseen"),
    )
