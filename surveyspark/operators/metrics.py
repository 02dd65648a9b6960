"""Exact classification, calibration and fairness metrics on a scored table.

Curves start from one row per (part, score) with positive and negative totals:
ties collapse on the map side, and everything after works on distinct scores.
``weight`` may name an integer multiplicity column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.prefix import interpolated_quantiles, prefix_sum

THRESHOLD = 0.5


def _predicted(score: str, threshold: float) -> Column:
    return F.col(score) >= F.lit(threshold)


def score_counts(
    df: DataFrame, parts: Sequence[str] = (), y: str = "y", score: str = "proba",
    weight: str | None = None,
) -> DataFrame:
    """(parts, score, pos, neg): the histogram every curve is computed from."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        df.select(*parts, F.col(score).alias("score"), F.col(y).alias("_y"), w.cast("long").alias("_w"))
        .groupBy(*parts, "score")
        .agg(
            F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0)).alias("neg"),
        )
    )


def ranking_metrics(counts: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and average precision per part, from one prefix pass.

    AUC counts tied pairs as half and is null with a single class. Average
    precision is the step-wise sum of precision over recall increments; with no
    positive it is 0.
    """
    running = prefix_sum(counts, parts, "score", ["pos", "neg"])
    number = {c: F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg", "total_pos", "total_neg")}
    below = number["cum_neg"] - number["neg"]
    won = number["pos"] * (below + number["neg"] / 2)
    true_above = number["total_pos"] - number["cum_pos"] + number["pos"]
    false_above = number["total_neg"] - number["cum_neg"] + number["neg"]
    gained = number["pos"] * F.try_divide(true_above, true_above + false_above)
    return running.groupBy(*parts).agg(
        F.try_divide(F.sum(won), F.first(number["total_pos"]) * F.first(number["total_neg"])).alias("roc_auc"),
        F.coalesce(
            F.try_divide(F.sum(gained), F.first(number["total_pos"])), F.lit(0.0)
        ).alias("average_precision"),
    )


def roc_auc(df: DataFrame, parts: Sequence[str] = (), y: str = "y", score: str = "proba") -> DataFrame:
    return ranking_metrics(score_counts(df, parts, y, score), parts).select(*parts, "roc_auc")


def average_precision(
    df: DataFrame, parts: Sequence[str] = (), y: str = "y", score: str = "proba"
) -> DataFrame:
    return ranking_metrics(score_counts(df, parts, y, score), parts).select(
        *parts, "average_precision"
    )


def brier_expression(y: str = "y", score: str = "proba") -> Column:
    gap = F.col(score) - F.col(y)
    return F.avg(gap * gap)


def brier(df: DataFrame, y: str = "y", score: str = "proba") -> DataFrame:
    return df.agg(brier_expression(y, score).alias("brier_score"))


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _threshold_ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": _ratio_or_zero(tp, tp + fp),
        "recall": _ratio_or_zero(tp, tp + fn),
        "f1": _ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    }


def _cell(y: str, label: int, predicted: Column) -> Column:
    return F.count_if((F.col(y) == label) & predicted)


def threshold_metrics(
    df: DataFrame, y: str = "y", score: str = "proba", threshold: float = THRESHOLD
) -> DataFrame:
    """Precision, recall and F1 at a threshold; an empty denominator gives 0."""
    hit = _predicted(score, threshold)
    cells = df.agg(
        _cell(y, 1, hit).alias("tp"), _cell(y, 0, hit).alias("fp"), _cell(y, 1, ~hit).alias("fn")
    )
    ratios = _threshold_ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return cells.select(*[c.alias(name) for name, c in ratios.items()])


def confusion_matrix(
    df: DataFrame, y: str = "y", score: str = "proba", threshold: float = THRESHOLD
) -> DataFrame:
    """The four cells with counts and the share of their actual class."""
    hit = _predicted(score, threshold)
    cells = [(actual, predicted) for actual in (0, 1) for predicted in (0, 1)]
    row = df.agg(
        *[_cell(y, a, hit if p else ~hit).alias(f"c{a}{p}") for a, p in cells]
    )
    entries = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            F.col(f"c{a}{p}").alias("n"),
            F.try_divide(F.col(f"c{a}{p}"), F.col(f"c{a}0") + F.col(f"c{a}1")).alias("row_share"),
        )
        for a, p in cells
    ]
    return row.select(F.inline(F.array(*entries)))


def roc_points(df: DataFrame, y: str = "y", score: str = "proba") -> DataFrame:
    """ROC curve as (fpr, tpr, threshold).

    As is usual, points in the middle of a straight run are left out: a point
    stays only if it is an end of the curve or the step into it differs from the
    step out of it. The curve starts at (0, 0) with an infinite threshold.
    """
    running = prefix_sum(score_counts(df, (), y, score), (), "score", ["pos", "neg"], previous=True)
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    is_lowest = F.col("prev_pos").isNull()
    is_highest = (tp == F.col("pos")) & (fp == F.col("neg"))
    bends = (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg"))
    points = running.filter(is_lowest | is_highest | bends).select(
        F.try_divide(fp, F.col("total_neg")).alias("fpr"),
        F.try_divide(tp, F.col("total_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(origin)


def pr_points(df: DataFrame, y: str = "y", score: str = "proba") -> DataFrame:
    """Precision-recall points for every distinct threshold, the closing point
    (1, 0), and the no-skill prevalence."""
    running = prefix_sum(score_counts(df, (), y, score), (), "score", ["pos", "neg"])
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    total = F.col("total_pos") + F.col("total_neg")
    prevalence = F.col("total_pos") / total
    real = F.struct(
        F.try_divide(tp, tp + fp).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("total_pos")), F.lit(1.0)).alias("recall"),
        F.col("score").alias("threshold"),
        prevalence.alias("no_skill"),
    )
    closing = F.struct(
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
        prevalence.alias("no_skill"),
    )
    # The closing point comes with the row of the highest score.
    is_highest = (F.col("cum_pos") + F.col("cum_neg")) == total
    return running.select(
        F.inline(F.when(is_highest, F.array(real, closing)).otherwise(F.array(real)))
    )


def calibration_curve(
    df: DataFrame, y: str = "y", score: str = "proba", bins: int = 10, parts: Sequence[str] = ()
) -> DataFrame:
    """Mean prediction and observed fraction in quantile bins (of each part); empty bins dropped."""
    parts = list(parts)
    counts = score_counts(df, parts, y, score).withColumn("n", F.col("pos") + F.col("neg"))
    quantiles = interpolated_quantiles(
        counts.select(*parts, "score", "n"), parts, "score", "n", [i / bins for i in range(1, bins)]
    )
    value = F.col("score")
    if parts:
        edged = counts.join(quantiles.withColumnRenamed("quantiles", "edges"), parts)
    else:
        edged = counts.withColumn("edges", quantiles.scalar())
    return (
        edged.withColumn("bin", F.size(F.filter("edges", lambda e: e < value)))
        .groupBy(*parts, "bin")
        .agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_pred"),
            (F.sum("pos") / F.sum("n")).alias("frac_pos"),
            F.sum("n").alias("n"),
        )
    )


def _rates(y: str, score: str, threshold: float) -> dict[str, Column]:
    """TPR and FPR; null where the class is empty."""
    hit = _predicted(score, threshold).cast("double")
    return {
        "tpr": F.avg(F.when(F.col(y) == 1, hit)),
        "fpr": F.avg(F.when(F.col(y) == 0, hit)),
    }


def equity_table(
    df: DataFrame, group: str, y: str = "y", score: str = "proba",
    threshold: float = THRESHOLD, outcome: str = "sba",
) -> DataFrame:
    """Per subgroup: size, observed rate, mean prediction, AUC, TPR and FPR.

    Everything but AUC needs sums only, and AUC needs (group, score) totals, so
    one pass to a (group, score) histogram serves both.
    """
    grouped = df.filter(F.col(group).isNotNull())
    counts = score_counts(grouped, [group], y, score)
    hit = _predicted("score", threshold)
    total = F.sum(F.col("pos") + F.col("neg"))
    sums = counts.groupBy(group).agg(
        total.alias("n"),
        (F.sum("pos") / total).alias(f"observed_{outcome}_rate"),
        (F.sum(F.col("score") * (F.col("pos") + F.col("neg"))) / total).alias("mean_predicted_proba"),
        F.try_divide(F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum("pos")).alias("tpr"),
        F.try_divide(F.sum(F.when(hit, F.col("neg")).otherwise(0)), F.sum("neg")).alias("fpr"),
    )
    auc = ranking_metrics(counts, [group]).select(group, F.col("roc_auc").alias("auc"))
    return sums.join(auc, group).select(
        group, "n", f"observed_{outcome}_rate", "mean_predicted_proba", "auc", "tpr", "fpr"
    )


def rate_gaps(rates: DataFrame) -> DataFrame:
    """Max minus min TPR and FPR, null unless two groups have a TPR."""
    enough = F.count("tpr") > 1
    return rates.agg(
        F.when(enough, F.max("tpr") - F.min("tpr")).alias("tpr_gap"),
        F.when(enough, F.max("fpr") - F.min("fpr")).alias("fpr_gap"),
    )


def equity_gaps(
    df: DataFrame, group: str, y: str = "y", score: str = "proba", threshold: float = THRESHOLD
) -> DataFrame:
    rates = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        *[c.alias(name) for name, c in _rates(y, score, threshold).items()]
    )
    return rate_gaps(rates)


def equity_gaps_min_cell(
    df: DataFrame, group: str, y: str = "y", score: str = "proba",
    threshold: float = THRESHOLD, minimum: int = 5,
) -> DataFrame:
    """Gaps over the groups with at least ``minimum`` positives and negatives."""
    rates = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(F.col(y) == 1).alias("pos"),
        F.count_if(F.col(y) == 0).alias("neg"),
        *[c.alias(name) for name, c in _rates(y, score, threshold).items()],
    )
    return rate_gaps(rates.filter((F.col("pos") >= minimum) & (F.col("neg") >= minimum)))


def statistic_vector(
    histogram: DataFrame, parts: Sequence[str], groups: Sequence[str],
    threshold: float = THRESHOLD, minimum: int = 5,
) -> DataFrame:
    """AUC, AP, Brier, F1 and two gaps per group variable, for each part.

    ``histogram`` holds (parts, groups, y, score, n): rows collapsed with their
    multiplicity. Parts with a single class are left out.
    """
    parts = list(parts)
    counts = score_counts(histogram, parts, "y", "score", "n")
    ranking = ranking_metrics(counts, parts)

    hit = _predicted("score", threshold)
    gap = F.col("score") - F.col("y")
    cells = histogram.groupBy(*parts, *groups).agg(
        F.sum(F.when((F.col("y") == 1) & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") == 0) & hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"),
        F.sum(gap * gap * F.col("n")).alias("squared"),
    )
    sums = ["tp", "fp", "pos", "neg", "squared"]
    totals = cells.groupBy(*parts).agg(*[F.sum(c).alias(c) for c in sums])
    per_group = {
        g: cells.groupBy(*parts, g).agg(*[F.sum(c).alias(c) for c in sums[:4]]) for g in groups
    }
    return vector_of_sums(totals, ranking, per_group, parts, minimum)


def vector_of_sums(
    totals: DataFrame, ranking: DataFrame, per_group: Mapping[str, DataFrame],
    parts: Sequence[str], minimum: int = 5,
) -> DataFrame:
    """The statistic vector from sums per part (tp, fp, pos, neg, squared), ranking
    metrics per part, and for each grouping the sums per part and group value."""
    parts = list(parts)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    vector = totals.filter((pos > 0) & (neg > 0)).select(
        *parts,
        (F.col("squared") / (pos + neg)).alias("brier_score"),
        _threshold_ratios(tp, fp, pos - tp)["f1"].alias("f1"),
    )
    vector = _join_parts(vector, ranking, parts)
    for group, sums in per_group.items():
        usable = sums.filter(F.col(group).isNotNull() & (pos >= minimum) & (neg >= minimum)).select(
            *parts, (tp / pos).alias("tpr"), (fp / neg).alias("fpr")
        )
        enough = F.count(F.lit(1)) > 1
        gaps = usable.groupBy(*parts).agg(
            F.when(enough, F.max("tpr") - F.min("tpr")).alias(f"{group}_tpr_gap"),
            F.when(enough, F.max("fpr") - F.min("fpr")).alias(f"{group}_fpr_gap"),
        )
        vector = _join_parts(vector, gaps, parts)
    columns = ["roc_auc", "average_precision", "brier_score", "f1"]
    columns += [f"{g}_{r}_gap" for g in per_group for r in ("tpr", "fpr")]
    return vector.select(*parts, *columns)


def _join_parts(left: DataFrame, right: DataFrame, parts: list[str]) -> DataFrame:
    """Left join of per-part results. Without parts both are single rows, and the
    right one is attached as a scalar subquery instead of a join."""
    if parts:
        return left.join(right, parts, "left")
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def score_histogram(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str] = (), y: str = "y", score: str = "proba"
) -> DataFrame:
    """Collapse scored rows to (keys, groups, y, score, n)."""
    return df.groupBy(*keys, *groups, F.col(y).alias("y"), F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n")
    )


def holdout_metrics(
    df: DataFrame, y: str = "y", score: str = "proba", threshold: float = THRESHOLD,
    parts: Sequence[str] = (), size_name: str = "n",
) -> DataFrame:
    """Size, prevalence and the six headline metrics per part (or in one row)."""
    parts = list(parts)
    counts = score_counts(df, parts, y, score)
    hit = _predicted("score", threshold)
    n = F.col("pos") + F.col("neg")
    wrong = F.col("pos") * (1 - F.col("score")) * (1 - F.col("score")) + F.col("neg") * F.col("score") * F.col("score")
    sums = counts.groupBy(*parts).agg(
        F.sum(n).alias("_n"),
        F.sum("pos").alias("_pos"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("_fp"),
        F.sum(wrong).alias("_squared"),
    )
    tp, fp, pos = F.col("_tp"), F.col("_fp"), F.col("_pos")
    ratios = _threshold_ratios(tp, fp, pos - tp)
    joined = _join_parts(sums, ranking_metrics(counts, parts), parts)
    return joined.select(
        *parts,
        F.col("_n").alias(size_name),
        (pos / F.col("_n")).alias("prevalence"),
        "roc_auc",
        "average_precision",
        *[c.alias(name) for name, c in ratios.items()],
        (F.col("_squared") / F.col("_n")).alias("brier_score"),
    )
