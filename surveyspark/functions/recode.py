"""Column derivations: outcome, bins, lookups, flags, encodings.

Everything here is a built-in expression, so it stays inside whole-stage
codegen and filters above it still reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain, pairwise
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.params import (
    IMPROVED_SANITATION_CODES,
    IMPROVED_WATER_CODES,
    NULL_TOKENS,
    Bins,
)
from surveyspark.sources.extracts import require_columns


def null_safe_in(column: Column | str, values: Sequence) -> Column:
    """Membership where a null is simply not a member."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(list(values)), F.lit(False))


def recent(df: DataFrame, column: str, maximum: int) -> DataFrame:
    """Rows within the recency window; unknown recency is outside it."""
    return df.filter(F.col(column) <= maximum)


def any_equals(columns: Sequence[str], target: int) -> Column:
    """1 if any column equals the target, 0 if none does, null if all are null."""
    hit = reduce(or_, [F.coalesce(F.col(c) == target, F.lit(False)) for c in columns])
    known = reduce(or_, [F.col(c).isNotNull() for c in columns])
    return F.when(known, hit.cast("int"))


def with_outcome(df: DataFrame, columns: Sequence[str], target: int, name: str) -> DataFrame:
    require_columns(df, columns, "outcome")
    return df.withColumn(name, any_equals(columns, target))


def lookup(column: Column | str, mapping: Mapping) -> Column:
    """Constant-map lookup; an unmapped or null code gives null."""
    column = F.col(column) if isinstance(column, str) else column
    literal_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal_map, column)


def with_labels(df: DataFrame, code: str, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Table form of ``lookup`` for label sets kept as data.

    A left join with no hint: the optimizer broadcasts the label table when its
    size allows and shuffles otherwise.
    """
    renamed = labels.select(F.col(key).alias("_code"), F.col(label))
    return df.join(renamed, F.col(code) == F.col("_code"), "left").drop("_code")


def bin_text(bins: Bins, outside: str | None = None) -> Column:
    """Left-closed interval of the source column as text such as ``[15, 20)``.

    ``outside="nan"`` gives the text the published tables carry for values
    outside every bin; the default is null.
    """
    source = F.col(bins.source)
    intervals = [
        F.when((source >= lo) & (source < hi), F.lit(f"[{lo}, {hi})"))
        for lo, hi in pairwise(bins.edges)
    ]
    return F.coalesce(*intervals, F.lit(outside))


def bin_labels(bins: Bins) -> Column:
    """Label of the right-closed interval ``(lo, hi]``; null outside."""
    source = F.col(bins.source)
    return F.coalesce(
        *[
            F.when((source > lo) & (source <= hi), F.lit(label))
            for (lo, hi), label in zip(pairwise(bins.edges), bins.labels, strict=True)
        ]
    )


def any_positive(columns: Sequence[str]) -> Column:
    """True if any column is above zero; null counts as zero."""
    return reduce(or_, [F.coalesce(F.col(c), F.lit(0)) > 0 for c in columns])


def all_members(sets: Mapping[str, Sequence[int]]) -> Column:
    """True if every column's value lies in its set."""
    return reduce(and_, [null_safe_in(c, values) for c, values in sets.items()])


def wash_improved(water: str = "v113", toilet: str = "v116") -> Column:
    return all_members({water: IMPROVED_WATER_CODES, toilet: IMPROVED_SANITATION_CODES})


def with_round(df: DataFrame, year: int) -> DataFrame:
    return df.withColumn("survey_year", F.lit(year))


def scaled_weight(column: str, divisor: float) -> Column:
    return F.col(column) / F.lit(float(divisor))


def round_cluster(year: Column | int, cluster: str) -> Column:
    """Cluster id prefixed with its round, so rounds never share a cluster."""
    year = F.lit(year) if isinstance(year, int) else year
    return F.concat_ws("_", year.cast("string"), F.col(cluster).cast("string"))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """Add a constant column only where the table lacks it."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def normalised(column: Column | str) -> Column:
    return F.lower(F.trim(column))


def numeric_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast integer, boolean and float features to double, leave the rest."""
    numeric = {
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    }
    return df.withColumns({c: F.col(c).cast("double") for c in columns if c in numeric})


def canonical_category(column: Column | str) -> Column:
    """One stable text per category: numbers as ``1.0``, other text trimmed.

    Nulls and null-like tokens fail the job: they must be removed upstream.
    """
    column = F.col(column) if isinstance(column, str) else column
    text = F.trim(column.cast("string"))
    number = text.try_cast("double")
    return (
        F.when(
            text.isNull() | text.isin(list(NULL_TOKENS)),
            F.raise_error(F.concat(F.lit("missing category: "), F.coalesce(text, F.lit("null")))),
        )
        .when(number.isNotNull(), F.format_string("%.1f", number))
        .otherwise(text)
    )


def category_to_double(column: Column | str) -> Column:
    """Category text back to a number; a null or non-numeric text fails the job."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(
        column.isNull(), F.raise_error(F.lit("missing value in scoring input")).cast("double")
    ).otherwise(column.cast("double"))


def flagged_counts(df: DataFrame, group: str, flagged: Sequence[str], minimum: int) -> DataFrame:
    """Row count of each flagged group, 0 where it has no row, and a small flag.

    Counted as one conditional sum per flagged group: a single aggregated row,
    no join.
    """
    counts = df.agg(
        *[F.count_if(F.col(group) == name).alias(f"n_{i}") for i, name in enumerate(flagged)]
    )
    entries = [
        F.struct(F.lit(name).alias(group), F.col(f"n_{i}").alias("n"))
        for i, name in enumerate(flagged)
    ]
    return counts.select(F.inline(F.array(*entries))).withColumn("is_small", F.col("n") < minimum)


def unmapped_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("n_unmapped"))


def model_matrix(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Ids that are present, then the features in order; nothing else can enter."""
    require_columns(df, features, "model matrix")
    return df.select(*[c for c in ids if c in df.columns], *dict.fromkeys(features))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): sorted distinct labels numbered from 0.

    Built once on the whole population, before any split. The label set of a
    categorical survey variable is small, so numbering the distinct labels is
    one array expression on a single row.
    """
    labels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    ordered = labels.agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return ordered.select(F.posexplode("labels").alias("code", "label")).select("label", "code")


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace a label column by its code from a (label, code) table."""
    coded = with_labels(df, column, codes, "label", "code")
    order = [F.col("code").alias(column) if c == column else F.col(c) for c in df.columns]
    return coded.select(*order)


def decode(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Add the label of a code column from a (label, code) table."""
    return with_labels(df, column, codes, "code", "label").withColumnRenamed("label", name)


def canonical_encode(df: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    """Fixed encoding; rows whose label is outside the map are dropped."""
    return df.filter(null_safe_in(column, list(codes))).withColumn(column, lookup(column, codes))


def outside_canonical_count(df: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    return df.agg(F.count_if(~null_safe_in(column, list(codes))).alias("n_dropped"))


def codebook(df: DataFrame, code: str, labels: Mapping[str, str], name: str = "label") -> DataFrame:
    """Label of each variable code; the code itself where none is known."""
    return df.withColumn(name, F.coalesce(lookup(code, labels), F.col(code)))


def relabel_columns(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})
