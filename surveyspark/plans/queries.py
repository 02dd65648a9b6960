"""The registered queries: (spark, sf_dir) -> DataFrame over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions import recode
from surveyspark.functions.checkpoints import cut, stage_path
from surveyspark.operators import (
    bootstrap,
    compare,
    counterfactual,
    explain,
    joins,
    metrics,
    model,
    oversample,
    quality,
    report,
    splits,
    stats,
)
from surveyspark.params import (
    CANONICAL_STRATUM_CODES,
    VARIABLE_LABELS,
    SurveyParams,
    TreeParams,
    round_2016,
    round_2024,
)
from surveyspark.plans import fixtures as fx
from surveyspark.plans import rounds
from surveyspark.sources import extracts, stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

P = round_2024(flagged_regions=fx.FLAGGED_NATIONS, small_sample=1000)
# The summary and the imbalance study fit the published 500 boosting rounds, other queries fewer.
FEW_TREES = TreeParams(trees=5, rate=0.3)
MODEL = round_2024(tree=FEW_TREES)
WHOLE = round_2024()
REPLICATES = 1000
KEY = ["caseid", "bidx"]
VISIT_RANGE = {"m14": (0.0, 20.0)}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that two engines' last bits cannot differ."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# --- Shared inputs -----------------------------------------------------------
def merged(spark: SparkSession, d: str, p: SurveyParams = P) -> DataFrame:
    return rounds.merged_round(fx.births(spark, d), fx.women(spark, d), p)


def featured(spark: SparkSession, d: str, p: SurveyParams = P) -> DataFrame:
    return rounds.featured_round(
        fx.births(spark, d), fx.women(spark, d), p, fx.region_labels(spark, d)
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.cluster_region_pairs(fx.births(spark, d), fx.clusters(spark, d))


PHI_FEATURES = ("m14", "bord", "v467b", "v467c", "m10")


def phi(spark: SparkSession, d: str) -> DataFrame:
    """A long attribution table (feature, phi, weight, stratum code) from births."""
    b = fx.births(spark, d)
    long = b.select(*KEY, "v005", "v022", *PHI_FEATURES).unpivot(
        [*KEY, "v005", "v022"], list(PHI_FEATURES), "feature", "value"
    )
    return long.filter("value IS NOT NULL").selectExpr(
        "caseid", "bidx", "feature", "v022 % 3 AS region_stratum", "v005 / 1e6 AS weight",
        "((value * 5 + caseid) % 11 - 5) / 1e1 AS phi",
    )


_STAGES: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, name: str, build: Callable[[], object]):
    """Build a stage once per application and data folder, as a saved stage would be."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """The complete-case model matrix, written once: a stage also ends the
    long cleaning lineage for the many jobs that training runs on it."""
    def build() -> DataFrame:
        coded = rounds.round_matrix(featured(spark, d, MODEL), MODEL)
        # What this leaves out is counted by ``training_rejects``.
        return quality.complete_case(coded, MODEL.features, "model matrix")

    def stage() -> DataFrame:
        store = stages.StageStore(spark, stage_path(spark, "stages"))
        return store.once("matrix", build, {"data": d, "round": MODEL.survey_year, "features": MODEL.features})

    return _once(spark, d, "matrix", stage)


def fitted(spark: SparkSession, d: str, p: SurveyParams = MODEL):
    return _once(
        spark, d, f"model of {p.tree}", lambda: model.fit_final(matrix(spark, d), p.features, p)
    )


def canonical_rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both survey rounds in canonical form: women carry the round they belong to."""
    def one(p: SurveyParams) -> DataFrame:
        women = fx.women(spark, d).filter(F.col("survey_year") == p.survey_year)
        analytic = rounds.featured_round(
            fx.births(spark, d), women.drop("survey_year"), p, fx.region_labels(spark, d)
        )
        sizes = cut(splits.cluster_sizes(analytic, p.fold_cluster))
        held = splits.geographic_holdout(
            analytic, p.fold_cluster, p.holdout_fraction, p.seed, sizes=sizes
        )
        return cut(rounds.canonical_round(held, p, CANONICAL_STRATUM_CODES))

    return _once(spark, d, "rounds", lambda: (one(round_2016(tree=FEW_TREES)), one(MODEL)))


# --- Scans, cleaning, quality ------------------------------------------------
@query
def column_pruned_scan(spark, d):
    return extracts.scan_extract(
        spark, d, ["l_orderkey", "l_suppkey", "l_quantity"], pattern="lineitem*.parquet"
    )


@query
def cluster_attributes(spark, d):
    lower = fx.clusters(spark, d).withColumn("LATNUM", F.lit(0.0))
    return extracts.cluster_attributes(lower.toDF(*[c.lower() for c in lower.columns]))


@query
def missingness_profile(spark, d):
    return rounded(quality.missingness_profile(fx.births(spark, d), [*P.birth_required, "v467a"]))


@query
def fully_missing(spark, d):
    return quality.fully_missing(fx.births(spark, d), [*P.birth_required, "v467a"])


@query
def complete_case(spark, d):
    kept = quality.guarded_complete_case(fx.births(spark, d), P.birth_required, "births")
    return kept.select(*KEY, "m14", "m3c", "b19")


@query
def complete_case_counts(spark, d):
    return quality.complete_case_counts(fx.births(spark, d), P.birth_required, "births")


@query
def skip_sentinel(spark, d):
    filled = quality.fill_skip_pattern(fx.women(spark, d), P.skip_pattern, P.skip_sentinel)
    return filled.select("caseid", *P.skip_pattern)


@query
def skip_sentinel_counts(spark, d):
    return quality.skip_pattern_counts(fx.women(spark, d), P.skip_pattern)


@query
def plausible_kept(spark, d):
    return quality.plausible(fx.births(spark, d), P.visits, P.visits_max).select(*KEY, "v024", "m14")


@query
def plausible_rejected(spark, d):
    return quality.implausible(fx.births(spark, d), P.visits, P.visits_max)


@query
def eligibility_consistency(spark, d):
    return quality.eligibility_consistency(
        fx.births(spark, d), P.recency_var, P.recency_max, P.attendants
    )


@query
def matrix_nulls(spark, d):
    return quality.matrix_nulls(fx.women(spark, d), P.women_required + list(P.skip_pattern))


@query
def stage_funnel(spark, d):
    return quality.stage_funnel(
        fx.births(spark, d),
        [
            ("plausible", F.coalesce(F.col("m14") <= P.visits_max, F.lit(True))),
            ("complete", quality.all_present(P.birth_required)),
            ("eligible", F.col("b19") <= P.recency_max),
        ],
    )


@query
def observed_funnel(spark, d):
    """The same counts, read off the run that builds the model matrix."""
    funnel = quality.Funnel("births")
    births = fx.births(spark, d)
    matrix = rounds.round_matrix(
        rounds.featured_round(births, fx.women(spark, d), P, fx.region_labels(spark, d), funnel), P
    )
    cut(matrix)
    return funnel.table(spark)


@query
def label_collisions(spark, d):
    labels = fx.region_labels(spark, d)
    return quality.label_collisions(
        labels.select(F.col("code").cast("string").alias("code"), F.col("region_stratum").alias("label"))
    )


@query
def category_coverage(spark, d):
    b = fx.births(spark, d)
    held = splits.geographic_holdout(b, "v021", P.holdout_fraction, P.seed)
    return quality.category_coverage(b, splits.train_rows(held), "bord", "v022")


# --- Derivations -------------------------------------------------------------
@query
def recency_filter(spark, d):
    return recode.recent(fx.births(spark, d), P.recency_var, P.recency_max).select(*KEY, "b19")


@query
def outcome(spark, d):
    derived = recode.with_outcome(fx.births(spark, d), P.attendants, P.attendant_target, "sba")
    return derived.select(*KEY, "sba")


@query
def outcome_prevalence(spark, d):
    derived = recode.with_outcome(fx.births(spark, d), P.attendants, P.attendant_target, "sba")
    return rounded(stats.prevalence(derived, "sba"))


@query
def region_label(spark, d):
    b = fx.births(spark, d).select(*KEY, "v024")
    return recode.with_labels(b, "v024", fx.region_labels(spark, d), "code", "region_name")


@query
def stratum(spark, d):
    return rounds.with_regions(
        fx.births(spark, d).select(*KEY, "v024"), P, fx.region_labels(spark, d)
    )


@query
def stratum_from_parameters(spark, d):
    return rounds.with_regions(fx.births(spark, d).select(*KEY, "v024"), P)


@query
def unmapped_rows(spark, d):
    return recode.unmapped_count(stratum(spark, d), "region_stratum")


@query
def small_sample_flags(spark, d):
    return recode.flagged_counts(
        featured(spark, d), "region_name", P.flagged_regions, P.small_sample
    )


@query
def age_bins(spark, d):
    return fx.women(spark, d).select(
        "caseid",
        recode.bin_text(P.age_bins).alias("age_group"),
        recode.bin_text(P.age_bins, outside="nan").alias("age_group_text"),
    )


@query
def parity_anc_bins(spark, d):
    b, w = fx.births(spark, d), fx.women(spark, d).select("caseid", "v218")
    return b.join(w, "caseid").select(
        *KEY, recode.bin_labels(P.parity_bins).alias("parity"), recode.bin_labels(P.visit_bins).alias("anc")
    )


@query
def education(spark, d):
    return fx.women(spark, d).select("caseid", recode.lookup("v106", P.education).alias("education"))


@query
def media_any(spark, d):
    return fx.women(spark, d).select("caseid", recode.any_positive(P.media).alias("media_any"))


@query
def wash_improved(spark, d):
    return fx.women(spark, d).select("caseid", recode.wash_improved().alias("wash_improved"))


@query
def weights(spark, d):
    b = fx.births(spark, d)
    return rounded(b.select(*KEY, recode.scaled_weight(P.weight_var, P.weight_divisor).alias("weight")))


@query
def model_matrix(spark, d):
    coded = recode.numeric_matrix(rounds.round_matrix(featured(spark, d), P), P.features)
    return rounded(coded)


@query
def round_union(spark, d):
    old, new = canonical_rounds(spark, d)
    both = stats.union_all([old, new])
    return both.groupBy("survey_year", "region_stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sba").alias("n_positive")
    )


@query
def stratum_codes(spark, d):
    return recode.category_codes(featured(spark, d), "region_stratum")


@query
def canonical_codes(spark, d):
    b = stratum(spark, d)
    return recode.canonical_encode(b, "region_stratum", CANONICAL_STRATUM_CODES).select(
        *KEY, "region_stratum"
    )


@query
def canonical_dropped(spark, d):
    return recode.outside_canonical_count(stratum(spark, d), "region_stratum", CANONICAL_STRATUM_CODES)


@query
def round_cluster(spark, d):
    return fx.women(spark, d).select(
        "caseid", recode.round_cluster(F.col("survey_year"), "v001").alias("round_cluster")
    )


@query
def default_columns(spark, d):
    b = fx.births(spark, d).select(*KEY, "v001")
    return recode.with_default(
        recode.with_default(recode.with_default(b, "survey_year", 2024), "geo_holdout", False), "v001", -1
    )


@query
def codebook(spark, d):
    births_with_women = joins.merge_many_to_one(fx.births(spark, d), fx.women(spark, d))
    counts = quality.null_counts(births_with_women, [f for f in P.features if f != "region_stratum"])
    return recode.codebook(counts.withColumnRenamed("column", "code"), "code", VARIABLE_LABELS)


@query
def category_strings(spark, d):
    b, c = fx.births(spark, d), fx.clusters(spark, d)
    numbers = b.select(recode.canonical_category("bord").alias("category"))
    names = c.select(recode.canonical_category("ADM1NAME").alias("category"))
    return numbers.unionByName(names).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def category_to_double(spark, d):
    text = fx.births(spark, d).select(*KEY, recode.canonical_category("v467b").alias("category"))
    return text.select(*KEY, recode.category_to_double("category").alias("value"))


@query
def stratum_code_labels(spark, d):
    codes = recode.category_codes(fx.region_labels(spark, d), "region_stratum")
    summary = stats.spread(phi(spark, d), "region_stratum", "phi")
    return rounded(recode.decode(summary, "region_stratum", codes, "stratum_label")).orderBy(
        "region_stratum"
    )


# --- Joins -------------------------------------------------------------------
@query
def merge_m1(spark, d):
    return joins.merge_many_to_one(fx.births(spark, d), fx.women(spark, d)).select(
        *KEY, "v001", "v005", "v024", "v012", "v190", "m14"
    )


@query
def merge_unmatched(spark, d):
    return joins.unmatched_left(fx.births(spark, d), fx.women(spark, d)).select(*KEY, "v001")


@query
def cluster_region_pairs(spark, d):
    return pairs(spark, d).select("v001", "v024", "ADM1NAME")


@query
def linkage_check(spark, d):
    return rounded(
        joins.linkage_check(pairs(spark, d), fx.region_labels(spark, d), "code", "region_name")
    )


@query
def region_crosswalk(spark, d):
    return joins.region_crosswalk(
        pairs(spark, d), fx.region_labels(spark, d), "code", "region_name"
    ).orderBy("v024_code")


@query
def crosswalk_errors(spark, d):
    return joins.crosswalk_errors(region_crosswalk(spark, d))


@query
def majority_name(spark, d):
    return stats.majority(fx.clusters(spark, d), "ADM1DHS", "ADM1NAME")


# --- Splits ------------------------------------------------------------------
@query
def group_kfold(spark, d):
    folded = splits.group_folds(fx.births(spark, d).select("v021"), "v021", P.folds, P.seed)
    return folded.groupBy("v021", "cv_fold").agg(F.count(F.lit(1)).alias("n"))


@query
def geo_holdout(spark, d):
    held = splits.geographic_holdout(
        fx.births(spark, d).select("v021"), "v021", P.holdout_fraction, P.seed
    )
    return held.groupBy("v021", "geo_holdout").agg(F.count(F.lit(1)).alias("n"))


@query
def train_pool(spark, d):
    held = splits.geographic_holdout(fx.births(spark, d), "v021", P.holdout_fraction, P.seed)
    return splits.train_rows(held).select(*KEY, "v021")


@query
def stratum_sample(spark, d):
    derived = recode.with_outcome(fx.births(spark, d), P.attendants, P.attendant_target, "sba")
    return splits.stratum_sample(derived, "v022", "sba", KEY, 3, P.seed).select("v022", *KEY)


@query
def scenario_split(spark, d):
    return compare.scenario_split(*canonical_rounds(spark, d), MODEL)


# --- Aggregates --------------------------------------------------------------
@query
def weighted_prevalence_by_region(spark, d):
    return rounded(stats.weighted_prevalence(featured(spark, d), "region_name"))


@query
def weighted_prevalence_by_stratum(spark, d):
    return rounded(stats.weighted_prevalence(featured(spark, d), "region_stratum"))


@query
def class_weight(spark, d):
    return rounded(stats.class_balance(fx.scored(spark, d), "y"))


@query
def class_weight_column(spark, d):
    weighted = model.with_class_weight(fx.scored(spark, d), "y", "w")
    return rounded(weighted.groupBy("y", "w").agg(F.count(F.lit(1)).alias("n")))


@query
def feature_importance_weighted(spark, d):
    table = stats.importance_long(phi(spark, d))
    return rounded(stats.ranked(rounded(table), "weighted_mean_abs_shap", "feature"))


@query
def labelled_importance(spark, d):
    top = stats.top_k(rounded(stats.importance_long(phi(spark, d))), "weighted_mean_abs_shap", "feature", 3)
    labelled = recode.codebook(top, "feature", VARIABLE_LABELS)
    return labelled.select("label", "weighted_mean_abs_shap")


@query
def interaction_summary(spark, d):
    return rounded(stats.spread(phi(spark, d), "region_stratum", "phi"))


PROFILED = ("m14", "bord", "b19", "v467b", "m10", "v024")


def _profile_sides(spark, d):
    """All complete rows, and the plausible ones of clusters outside the hold-out."""
    b = quality.complete_case(fx.births(spark, d), PROFILED)
    held = splits.geographic_holdout(b, "v021", P.holdout_fraction, P.seed)
    return b, quality.plausible(splits.train_rows(held), P.visits, P.visits_max)


def _profile_text(profile: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",")
    return profile.withColumn("values", listed)


@query
def column_profile(spark, d):
    _, train = _profile_sides(spark, d)
    return _profile_text(stats.column_profile(train, PROFILED, ("v024",)))


@query
def in_distribution(spark, d):
    asked, train = _profile_sides(spark, d)
    profile = counterfactual.Profile.collect(stats.training_profile(train, PROFILED))
    return counterfactual.in_distribution(asked, profile, PROFILED).select(*KEY, "bord", "b19")


@query
def out_of_distribution_counts(spark, d):
    asked, train = _profile_sides(spark, d)
    profile = counterfactual.Profile.collect(stats.training_profile(train, PROFILED))
    return counterfactual.out_of_distribution_counts(asked, profile, PROFILED)


@query
def permitted_range(spark, d):
    _, train = _profile_sides(spark, d)
    profile = stats.training_profile(train, PROFILED)
    return counterfactual.permitted_range(profile, ("m14", "b19", "v467b"), VISIT_RANGE)


GRID = ("m14", "v467b", "m10")


@query
def counterfactual_grid(spark, d):
    """How many variations of each kind the search goes through per query row."""
    births, train = _profile_sides(spark, d)
    derived = recode.with_outcome(births, P.attendants, P.attendant_target, "sba")
    asked = splits.stratum_sample(derived, "v022", "sba", KEY, 3, P.seed).select(*KEY, *GRID)
    profile = counterfactual.Profile.collect(stats.training_profile(train, GRID))
    varied = stats.union_all(
        [counterfactual.variations(asked, profile, GRID, n, VISIT_RANGE) for n in (1, 2, 3)]
    )
    return varied.groupBy(*KEY, "n_changed").agg(
        F.count(F.lit(1)).alias("n_variations"), F.countDistinct(*GRID).alias("n_distinct"),
        F.round(F.sum("distance"), 6).alias("total_distance"),
    )


# --- Metrics -----------------------------------------------------------------
@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(fx.scored(spark, d)))


@query
def average_precision(spark, d):
    return rounded(metrics.average_precision(fx.scored(spark, d)))


@query
def brier(spark, d):
    return rounded(metrics.brier(fx.scored(spark, d)))


@query
def threshold_metrics(spark, d):
    return rounded(metrics.threshold_metrics(fx.scored(spark, d)))


@query
def confusion_matrix(spark, d):
    return rounded(metrics.confusion_matrix(fx.scored(spark, d)))


@query
def roc_points(spark, d):
    return rounded(metrics.roc_points(fx.scored(spark, d)))


@query
def pr_points(spark, d):
    return rounded(metrics.pr_points(fx.scored(spark, d)))


@query
def calibration_quantile(spark, d):
    return rounded(metrics.calibration_curve(fx.scored(spark, d)))


@query
def calibration_by_part(spark, d):
    """One calibration curve for each residence group."""
    return rounded(metrics.calibration_curve(fx.scored(spark, d), parts=["v025"]))


@query
def equity_by_wealth(spark, d):
    return rounded(metrics.equity_table(fx.scored(spark, d), "v190")).orderBy("v190")


@query
def equity_by_residence(spark, d):
    return rounded(metrics.equity_table(fx.scored(spark, d), "v025")).orderBy("v025")


@query
def equity_gaps(spark, d):
    return rounded(metrics.equity_gaps(fx.scored(spark, d), "v190"))


@query
def equity_gaps_min_cell(spark, d):
    # Every cluster here passes the default of 5; a higher minimum makes the test bite.
    return rounded(metrics.equity_gaps_min_cell(fx.scored(spark, d), "v021", minimum=220))


@query
def stat_vector(spark, d):
    histogram = metrics.score_histogram(fx.scored(spark, d), P.equity_groups)
    return rounded(metrics.statistic_vector(histogram, [], P.equity_groups))


@query
def bootstrap_ci(spark, d):
    return rounded(
        bootstrap.bootstrap_intervals(fx.scored(spark, d), "v021", P.equity_groups, REPLICATES, P.seed)
    )


@query
def holdout_metrics(spark, d):
    return rounded(metrics.holdout_metrics(fx.scored(spark, d), parts=["v025"]))


@query
def metrics_long(spark, d):
    return rounded(compare.metrics_long(metrics.holdout_metrics(fx.scored(spark, d), parts=["v025"]), ["v025"]))


@query
def fold_prevalence_mean(spark, d):
    """Mean over folds of the outcome's share in each fold."""
    derived = recode.with_outcome(fx.births(spark, d), P.attendants, P.attendant_target, "sba")
    folded = splits.group_folds(derived.select("v021", "sba"), "v021", P.folds, P.seed)
    by_fold = folded.groupBy("cv_fold").agg(F.avg("sba").alias("prevalence"))
    return rounded(stats.fold_mean(by_fold, "prevalence"))


@query
def imbalance_verdict(spark, d):
    """Verdict over a metrics table of three scorings of the same rows."""
    scored = fx.scored(spark, d)
    variants = {"class_weight": "proba", "smote": "proba * proba", "none": "1 - proba"}
    table = stats.union_all(
        [
            scored.selectExpr(f"'{m}' AS method", "y", f"round({e}, 6) AS proba")
            for m, e in variants.items()
        ]
    )
    return compare.imbalance_verdict(rounded(metrics.holdout_metrics(table, parts=["method"])))


# --- Model, explanation, counterfactuals, comparison -------------------------
@query
def training_rejects(spark, d):
    """Rows that training leaves out because a feature is null."""
    coded = rounds.round_matrix(featured(spark, d, MODEL), MODEL)
    return quality.complete_case_counts(coded, MODEL.features, "model matrix")


@query
def null_cluster_rows(spark, d):
    """Rows that no split could place, for two possible cluster columns."""
    return splits.null_cluster_rows(fx.births(spark, d), ["v021", "v467c"])


def _cv(spark, d, p: SurveyParams = MODEL) -> DataFrame:
    pool = splits.train_rows(matrix(spark, d))
    return _once(
        spark, d, f"cv of {p.tree}", lambda: cut(model.cluster_cv(pool, p.features, p, parallelism=p.folds))
    )


@query
def gbt_cv(spark, d):
    """Every fold's AUC next to their mean."""
    cv = _cv(spark, d)
    return rounded(cv.withColumn("roc_auc_mean", stats.fold_mean(cv, "roc_auc").scalar()))


@query
def cv_fold_sizes(spark, d):
    """The rows each fold's model was tested on, and whether its AUC is above chance."""
    return _cv(spark, d).select("cv_fold", "n_test", (F.col("roc_auc") > 0.5).alias("better_than_chance"))


@query
def holdout_keys(spark, d):
    """The rows the final model was scored on, with their outcome."""
    scored = model.score(fitted(spark, d), splits.holdout_rows(matrix(spark, d)))
    return scored.filter(F.col("proba").between(0, 1)).select(*KEY, "sba")


@query
def gbt_holdout_scores(spark, d):
    held = splits.holdout_rows(matrix(spark, d))
    return rounded(model.score(fitted(spark, d), held).select(*KEY, "sba", "proba", "pred"))


@query
def gbt_holdout_metrics(spark, d):
    held = model.score(fitted(spark, d), splits.holdout_rows(matrix(spark, d)))
    return rounded(metrics.holdout_metrics(held, "sba", size_name="n_holdout"))


@query
def native_importance(spark, d):
    return rounded(explain.native_importance(fitted(spark, d), matrix(spark, d)))


@query
def shap_values(spark, d):
    return rounded(explain.shap_values(fitted(spark, d), splits.train_rows(matrix(spark, d)), KEY))


@query
def shap_additivity(spark, d):
    """Rows whose attributions and base value sum up to the log-odds."""
    scored = model.score(fitted(spark, d), splits.train_rows(matrix(spark, d)))
    wide = explain.shap_values(fitted(spark, d), scored, ["proba"])
    total = reduce(add, [F.col(f"phi_{f}") for f in MODEL.features], F.col("base_value"))
    odds = F.log(F.col("proba") / (1 - F.col("proba")))
    return wide.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - odds) < 1e-6).alias("n_additive")
    )


@query
def shap_importance(spark, d):
    wide = explain.shap_values(fitted(spark, d), splits.train_rows(matrix(spark, d)), ["weight"])
    table = stats.importance_wide(wide, {f: f"phi_{f}" for f in MODEL.features})
    best = stats.ranked(table, "weighted_mean_abs_shap", "feature")
    return rounded(recode.codebook(best, "feature", VARIABLE_LABELS))


@query
def shap_interactions(spark, d):
    train = splits.train_rows(matrix(spark, d))
    found = explain.interaction_summary(fitted(spark, d), train, MODEL.interaction_pairs)
    summary = found.select("pair", F.col("stratum").alias("region_stratum"), "mean", "std", "count")
    codes = recode.category_codes(fx.region_labels(spark, d), "region_stratum")
    return rounded(recode.decode(summary, "region_stratum", codes, "stratum_label"))


@query
def interaction_counts(spark, d):
    """Rows behind each stratum's interaction summary, with the stratum's label."""
    return shap_interactions(spark, d).groupBy("region_stratum", "stratum_label").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.min("count").alias("fewest"), F.max("count").alias("most")
    )


@query
def partial_dependence(spark, d):
    train = splits.train_rows(matrix(spark, d))
    return rounded(
        stats.union_all(
            [explain.partial_dependence(fitted(spark, d), train, v) for v in MODEL.dependence_vars]
        )
    )


@query
def dependence_sizes(spark, d):
    """Rows behind each dependence curve and the points it is drawn at."""
    train = splits.train_rows(matrix(spark, d))
    curves = stats.union_all(
        [explain.partial_dependence(fitted(spark, d), train, v) for v in MODEL.dependence_vars]
    )
    return curves.groupBy("region_stratum", "feature").agg(
        F.max("n").alias("n"), F.count("grid_value").alias("n_points"),
        F.min("grid_value").alias("first_point"), F.max("grid_value").alias("last_point"),
    )


def _counterfactuals(spark, d) -> DataFrame:
    train, fit = splits.train_rows(matrix(spark, d)), fitted(spark, d)
    asked = splits.stratum_sample(train, "region_stratum", "sba", KEY, 3, MODEL.seed)
    return counterfactual.counterfactual_search(
        asked, train, MODEL.features, KEY, MODEL.mutable,
        lambda df: model.score(fit, df).drop("pred"), MODEL.counterfactuals, VISIT_RANGE,
    )


@query
def counterfactuals(spark, d):
    return rounded(_counterfactuals(spark, d))


def _cell_counterfactuals(spark, d) -> DataFrame:
    train, fit = splits.train_rows(matrix(spark, d)), fitted(spark, d)
    asked = splits.stratum_sample(train, "region_stratum", "sba", KEY, 3, MODEL.seed)
    return counterfactual.cell_search(fit, asked, train, KEY, MODEL.mutable, MODEL.counterfactuals, VISIT_RANGE)


@query
def counterfactual_cells(spark, d):
    """The same search with real values: the nearest points of the cells between thresholds."""
    return rounded(_cell_counterfactuals(spark, d))


@query
def cf_validity(spark, d):
    train = splits.train_rows(matrix(spark, d))
    profile = counterfactual.Profile.collect(stats.training_profile(train, MODEL.features))
    return rounded(counterfactual.validity_rate(_counterfactuals(spark, d), profile, MODEL.features))


@query
def smotenc(spark, d):
    train = splits.train_rows(matrix(spark, d))
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in MODEL.features], "sba")
    return rounded(
        oversample.smotenc(rows, MODEL.features, "sba", MODEL.smote_continuous, MODEL.smote_neighbours, MODEL.seed)
    )


@query
def smotenc_counts(spark, d):
    """Rows per class after oversampling, and the categories of its nominal features."""
    made = smotenc(spark, d)
    nominal = [f for f in MODEL.features if f not in MODEL.smote_continuous]
    long = made.unpivot(["sba"], nominal, "feature", "value").distinct()
    kinds = long.groupBy("sba").agg(F.count(F.lit(1)).alias("n_categories"))
    return made.groupBy("sba").agg(F.count(F.lit(1)).alias("n")).join(kinds, "sba")


@query
def scenario_metrics(spark, d):
    sides = [quality.complete_case(s, MODEL.features) for s in canonical_rounds(spark, d)]
    return rounded(compare.scenario_comparison(*sides, MODEL.features, MODEL, parallelism=4))


@query
def scenario_sizes(spark, d):
    """Rows and prevalences on both sides of each scenario that was fitted."""
    return scenario_metrics(spark, d).select("scenario", "n_train", "n_test", "train_prevalence", "test_prevalence")


def _study(spark, d) -> compare.ImbalanceStudy:
    return _once(spark, d, "study", lambda: compare.imbalance_study(matrix(spark, d), WHOLE.features, WHOLE, parallelism=3))


@query
def imbalance_compare(spark, d):
    table = _study(spark, d).table
    return rounded(table.withColumn("cluster_cv_auc_folds", F.transform("cluster_cv_auc_folds", lambda a: F.round(a, 6))))


@query
def imbalance_folds(spark, d):
    """The rows each method's folds were tested on, and whether they rank better than chance."""
    return _study(spark, d).folds.select("method", "cv_fold", "n_test", (F.col("roc_auc") > 0.5).alias("better_than_chance"))


@query
def imbalance_calibration(spark, d):
    return rounded(_study(spark, d).calibration)


# --- The fitted model on the hold-out ----------------------------------------
def _fitted_scores(spark, d, p: SurveyParams = MODEL) -> DataFrame:
    scored = model.score(fitted(spark, d, p), splits.holdout_rows(matrix(spark, d)))
    return scored.select(*KEY, "v001", "v190", "v025", F.col("sba").alias("y"), "proba")


@query
def fitted_equity(spark, d):
    """Equity by wealth and residence of the model's own hold-out scores."""
    scored = _fitted_scores(spark, d)
    tables = [
        metrics.equity_table(scored, g).withColumnRenamed(g, "value").withColumn("group", F.lit(g)) for g in P.equity_groups
    ]
    return rounded(stats.union_all(tables))


@query
def fitted_equity_sizes(spark, d):
    return fitted_equity(spark, d).select("group", "value", "n", "observed_sba_rate")


@query
def fitted_ci(spark, d):
    """Bootstrap intervals of the model's own hold-out metrics."""
    return rounded(bootstrap.bootstrap_intervals(_fitted_scores(spark, d), "v001", P.equity_groups, REPLICATES, P.seed))


@query
def counterfactual_changes(spark, d):
    """Each changed feature of each counterfactual with its label, from and to."""
    origin = matrix(spark, d).select(*KEY, *[F.col(f).cast("double").alias(f"was_{f}") for f in MODEL.mutable])
    found = _counterfactuals(spark, d).join(origin, KEY)
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"was_{f}").alias("before"), F.col(f).cast("double").alias("after"))
        for f in MODEL.mutable
    ])
    long = found.select(*KEY, "cf_rank", "n_changed", F.inline(F.filter(entries, lambda e: e["before"] != e["after"])))
    return recode.codebook(long, "feature", VARIABLE_LABELS)


def _fitted_summary(spark, d) -> DataFrame:
    scored = _fitted_scores(spark, d, WHOLE)
    wide = explain.shap_values(fitted(spark, d, WHOLE), splits.train_rows(matrix(spark, d)), ["weight"])
    importance = stats.importance_wide(wide, {f: f"phi_{f}" for f in WHOLE.features})
    return report.run_summary(
        {
            "cluster_cv": rounded(_cv(spark, d, WHOLE)),
            "holdout_metrics": rounded(metrics.holdout_metrics(scored, size_name="n_holdout")),
            "equity_by_wealth": rounded(metrics.equity_table(scored, "v190")),
            "equity_gaps": rounded(metrics.equity_gaps(scored, "v190")),
        },
        rounded(importance), {"data": "synthetic test tables", "note": "associational estimates, not causal effects"},
    )


@query
def fitted_summary(spark, d):
    return _fitted_summary(spark, d)


@query
def summary_keys(spark, d):
    """The parts of the fitted model's summary and how many rows each has."""
    parts = _fitted_summary(spark, d).select(
        F.from_json("summary", "map<string,string>").alias("parts")
    ).select(F.explode("parts").alias("part", "body"))
    rows = F.when(F.col("part") == "provenance", 1).otherwise(F.json_array_length("body"))
    return parts.select("part", rows.alias("n"))


# --- Reports and sinks -------------------------------------------------------
@query
def checkpoint_roundtrip(spark, d):
    """Stage table, CSV and JSON written and read back."""
    root = stage_path(spark, "roundtrip")
    extracts.write_stage(merged(spark, d).select(*KEY, "v024", "m14"), f"{root}/merged")
    stage = extracts.read_stage(spark, f"{root}/merged")
    counts = stage.groupBy("v024").agg(F.count(F.lit(1)).alias("n"))
    extracts.write_csv(counts, f"{root}/counts_csv")
    extracts.write_json(counts, f"{root}/counts_json")
    from_csv = spark.read.schema(counts.schema).option("header", True).csv(f"{root}/counts_csv")
    from_json = spark.read.schema(counts.schema).json(f"{root}/counts_json")
    return counts.join(from_csv.withColumnRenamed("n", "n_csv"), "v024").join(
        from_json.withColumnRenamed("n", "n_json"), "v024"
    )


@query
def stage_reuse(spark, d):
    """A stage built once, read again for the same inputs, built anew for others, removed."""
    with stages.StageStore(spark, stage_path(spark, "reuse")) as store:
        counts = []
        for year in (2024, 2024, 2016):
            def build(year=year):
                women = fx.women(spark, d).filter(F.col("survey_year") == year)
                return women.groupBy("v024", "v190").agg(F.count(F.lit(1)).alias("n"), F.lit(year).alias("survey_year"))

            # The second time another year would be built, if it were not the same input.
            stage = store.once("women", build if len(counts) != 1 else lambda: build(2016), {"year": year})
            counts.append(stage.groupBy("survey_year", "v190").agg(F.sum("n").alias("n")).withColumn("run", F.lit(len(counts))))
        return cut(stats.union_all(counts))


@query
def run_summary(spark, d):
    scored = fx.scored(spark, d)
    return report.run_summary(
        {
            "holdout_metrics": rounded(metrics.holdout_metrics(scored, size_name="n_holdout")),
            "equity_gaps": rounded(metrics.equity_gaps(scored, "v190")),
            "counterfactual_validity": None,
        },
        rounded(stats.importance_long(phi(spark, d))),
        {"data": "synthetic test tables", "note": "associational estimates, not causal effects"},
    )


@query
def formatted_equity(spark, d):
    return report.formatted(metrics.equity_table(fx.scored(spark, d), "v190"))
