"""One survey round from raw extracts to the model matrix, as chained DataFrames.

Only the featured rows (for the matrix) and the cluster table of the survey design are
written on the way. The rest is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions import recode
from surveyspark.functions.checkpoints import cut, staged
from surveyspark.operators import joins, quality, splits
from surveyspark.params import SurveyParams


def birth_stages(p: SurveyParams) -> list[tuple[str, Column]]:
    """The filters that births pass, as the stages of a funnel."""
    return [
        ("plausible", F.coalesce(F.col(p.visits) <= p.visits_max, F.lit(True))),
        ("complete", quality.all_present(p.birth_required)),
        ("eligible", F.col(p.recency_var) <= p.recency_max),
    ]


def clean_births(births: DataFrame, p: SurveyParams, funnel: quality.Funnel | None = None) -> DataFrame:
    """``funnel`` watches the rows on their way; the guard reads them unwatched."""
    watched = births if funnel is None else funnel.watch(births, birth_stages(p))
    plausible = [quality.plausible(b, p.visits, p.visits_max) for b in (watched, births)]
    return quality.guarded_complete_case(plausible[0], p.birth_required, "births", plausible[1])


def clean_women(women: DataFrame, p: SurveyParams) -> DataFrame:
    filled = quality.fill_skip_pattern(women, p.skip_pattern, p.skip_sentinel)
    return quality.guarded_complete_case(filled, p.women_required, "women")


def merged_round(
    births: DataFrame, women: DataFrame, p: SurveyParams, funnel: quality.Funnel | None = None
) -> DataFrame:
    return joins.merge_many_to_one(clean_births(births, p, funnel), clean_women(women, p), p.woman_key)


def with_known_outcome(df: DataFrame, p: SurveyParams) -> DataFrame:
    """Rows inside the recency window whose outcome is known."""
    eligible = recode.recent(df, p.recency_var, p.recency_max)
    derived = recode.with_outcome(eligible, p.attendants, p.attendant_target, p.outcome)
    return derived.filter(F.col(p.outcome).isNotNull())


def with_regions(df: DataFrame, p: SurveyParams, labels: DataFrame | None = None) -> DataFrame:
    """Add region name and stratum, from parameters or from a label table with
    columns (code, region_name, region_stratum)."""
    if labels is not None:
        coded = labels.withColumnRenamed("code", "_code")
        return df.join(coded, F.col("v024") == F.col("_code"), "left").drop("_code")
    named = df.withColumn("region_name", recode.lookup("v024", p.region_labels))
    return named.withColumn(
        "region_stratum", recode.lookup("region_name", p.region_to_stratum)
    )


def with_reporting_recodes(df: DataFrame, p: SurveyParams) -> DataFrame:
    """Descriptive recodes. The ``rr_`` prefix keeps them out of the features."""
    return df.withColumns(
        {
            "rr_age_group": recode.bin_text(p.age_bins, outside="nan"),
            "rr_education_simple": recode.lookup("v106", p.education),
            "rr_parity_group": recode.bin_labels(p.parity_bins),
            "rr_anc_group": recode.bin_labels(p.visit_bins),
            "rr_media_any_exposure": recode.any_positive(p.media),
            "rr_wash_improved": recode.wash_improved(),
        }
    )


def featured_round(
    births: DataFrame, women: DataFrame, p: SurveyParams, labels: DataFrame | None = None,
    funnel: quality.Funnel | None = None,
) -> DataFrame:
    """``funnel`` counts the births filters in the first job that reads the rows."""
    known = with_known_outcome(merged_round(births, women, p, funnel), p)
    regions = with_regions(known, p, labels)
    tagged = recode.with_round(with_reporting_recodes(regions, p), p.survey_year)
    return tagged.withColumn("weight", recode.scaled_weight(p.weight_var, p.weight_divisor))


def cluster_cells(featured: DataFrame, p: SurveyParams) -> DataFrame:
    """(cluster, region_stratum, count), written down: the one pass over the rows that
    cluster sizes and stratum labels are both read from."""
    return cut(featured.groupBy(p.fold_cluster, "region_stratum").count())


def survey_design(featured: DataFrame, p: SurveyParams, cells: DataFrame | None = None) -> DataFrame:
    """Add cluster folds and the cluster hold-out (both over all rows).

    Both are decided on one cluster-size table, which is tiny next to the rows, and
    joined to each other first: the rows are joined once, so that adaptive execution
    can split a hot cluster. Rows without a cluster fail the job.
    """
    cells = cells if cells is not None else cluster_cells(featured, p)
    cluster = p.fold_cluster
    sizes = cells.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum("count").alias("count"))
    design = splits.fold_table(sizes, cluster, p.folds, p.seed).join(
        splits.holdout_table(sizes, cluster, p.holdout_fraction, p.seed), cluster
    )
    placed = quality.assert_no_nulls(featured, [cluster], "survey design")
    return placed.join(cut(design), cluster)


def design_matrix(
    analytic: DataFrame, p: SurveyParams, extra_ids: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Ids, weight, splits, outcome and ordered features with the stratum coded.

    ``cells`` (or any table with the stratum labels) saves a pass over the rows.
    """
    ids = [*p.birth_key, p.cluster, "weight", "cv_fold", "geo_holdout", p.outcome, *extra_ids]
    matrix = recode.model_matrix(analytic, ids, p.features)
    codes = recode.category_codes(cells if cells is not None else analytic, "region_stratum")
    return recode.encode(matrix, "region_stratum", codes)


def round_matrix(featured: DataFrame, p: SurveyParams, extra_ids: Sequence[str] = ()) -> DataFrame:
    """Featured rows to the model matrix. The columns it needs are written once: cells
    and rows both come from there, and the joins behind them run once."""
    ids = [*p.birth_key, p.cluster, p.fold_cluster, "weight", p.outcome, *extra_ids]
    names = dict.fromkeys([*ids, "region_stratum", *p.features])
    rows = staged(featured.select(*[c for c in names if c in featured.columns]), "featured")
    cells = rows.groupBy(p.fold_cluster, "region_stratum").count()
    return design_matrix(survey_design(rows, p, cells), p, extra_ids, cells)


def canonical_round(
    analytic: DataFrame, p: SurveyParams, codes: dict[str, int]
) -> DataFrame:
    """Round-independent matrix for cross-round comparison: fixed stratum codes,
    round-prefixed cluster, and the round's own hold-out flag if it has one."""
    tagged = recode.with_default(
        recode.with_default(analytic, "survey_year", p.survey_year), "geo_holdout", False
    )
    coded = recode.canonical_encode(tagged, "region_stratum", codes)
    return coded.select(
        *p.birth_key,
        recode.round_cluster(p.survey_year, p.cluster).alias("round_cluster"),
        "survey_year",
        "geo_holdout",
        F.col(p.outcome).cast("int").alias(p.outcome),
        *p.features,
    )
