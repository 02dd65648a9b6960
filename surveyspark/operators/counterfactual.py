"""Training-profile checks and the constrained counterfactual searches.

``counterfactual_search`` goes through a grid of values with any scoring function.
``cell_search`` is for tree ensembles and real values: the prediction only changes at the
trees' thresholds, so the nearest point of each cell between thresholds is all there is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations, islice
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut, staged
from surveyspark.operators.explain import LeafTables, leaf_tables
from surveyspark.operators.model import model_features
from surveyspark.operators.quality import complete_case
from surveyspark.operators.stats import training_profile


class Profile(dict):
    """Training profile by column: (continuous, low, high, values).

    One entry per column, and values only for categorical columns, so it is a
    handful of literals. As literals they become plain comparisons in the filter,
    which Catalyst can push to the scan.
    """

    @classmethod
    def collect(cls, table: DataFrame) -> Profile:
        return cls(
            (r["column"], (r["is_continuous"], r["min_value"], r["max_value"], r["values"]))
            for r in table.collect()
        )

    def inside(self, feature: str) -> Column:
        """Value within the observed range, or among the observed categories."""
        if feature not in self:
            return F.lit(False)
        continuous, low, high, values = self[feature]
        value = F.col(feature)
        test = value.between(low, high) if continuous else value.isin(values)
        return F.coalesce(test, F.lit(False))


def in_distribution(query: DataFrame, profile: Profile, features: Sequence[str]) -> DataFrame:
    """Query rows whose every feature lies inside the training profile."""
    return query.filter(reduce(and_, [profile.inside(f) for f in features]))


def out_of_distribution_counts(
    query: DataFrame, profile: Profile, features: Sequence[str]
) -> DataFrame:
    """(feature, n_rejected, n_rows) for features that reject any query row."""
    row = query.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~profile.inside(f)).alias(f) for f in features],
    )
    return row.unpivot(["n_rows"], list(features), "feature", "n_rejected").filter("n_rejected > 0")


def validity_rate(
    counterfactuals: DataFrame, profile: Profile, features: Sequence[str]
) -> DataFrame:
    """Number of counterfactuals and the share inside the observed distribution."""
    valid = reduce(and_, [profile.inside(f) for f in features])
    return counterfactuals.agg(
        F.count(F.lit(1)).alias("n_counterfactuals"),
        F.avg(valid.cast("double")).alias("share_in_distribution"),
        F.lit("complete_case_no_imputation").alias("missing_value_policy"),
    )


def permitted_range(
    profile: DataFrame, mutable: Sequence[str], overrides: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """(feature, low, high, categories): what a search may set each feature to.

    ``overrides`` fixes the range of a continuous feature, such as visits to
    [0, 20]; a categorical feature lists its observed categories as text.
    """
    low, high = F.col("min_value"), F.col("max_value")
    for feature, (fixed_low, fixed_high) in overrides.items():
        low = F.when(F.col("column") == feature, float(fixed_low)).otherwise(low)
        high = F.when(F.col("column") == feature, float(fixed_high)).otherwise(high)
    wide = F.col("is_continuous")
    texts = F.transform("values", lambda v: F.format_string("%.1f", v))
    return profile.filter(F.col("column").isin(list(mutable))).select(
        F.col("column").alias("feature"),
        F.when(wide, low).alias("low"),
        F.when(wide, high).alias("high"),
        F.when(~wide, F.array_join(F.sort_array(texts), ",")).alias("categories"),
    )


def permitted_values(
    profile: Profile, feature: str, overrides: Mapping[str, tuple[float, float]], steps: Mapping[str, float]
) -> tuple[Column, float]:
    """All values a search may give a feature, ascending, and the width of its range.

    A categorical feature has its observed categories; a continuous one every
    ``steps[feature]`` (1 if not given) from its lower bound up to its upper one.
    """
    continuous, low, high, values = profile[feature]
    low, high = map(float, overrides.get(feature, (low, high)))
    if not continuous:
        return F.array(*[F.lit(float(v)) for v in values]), high - low
    step = float(steps.get(feature, 1.0))
    count = int((high - low) / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.lit(low) + i * F.lit(step)), high - low


def variations(
    queries: DataFrame, profile: Profile, mutable: Sequence[str], n_changed: int,
    overrides: Mapping[str, tuple[float, float]] | None = None, steps: Mapping[str, float] | None = None,
) -> DataFrame:
    """Every variation of each query row that changes exactly ``n_changed`` features.

    One branch per subset of features; each changed feature takes each permitted
    value but its own. Everything is an expression on the query row: no candidate
    table is shipped and no join is made. ``distance`` is the L1 change with each
    feature scaled to its range.
    """
    branches = []
    for subset in combinations(mutable, n_changed):
        rows = queries.withColumns({f"_new_{f}": F.col(f).cast("double") for f in mutable})
        distance = F.lit(0.0)
        for feature in subset:
            values, width = permitted_values(profile, feature, overrides or {}, steps or {})
            current = F.col(feature).cast("double")
            rows = rows.withColumn(f"_new_{feature}", F.explode(F.filter(values, lambda v: v != current)))
            if width > 0:
                distance = distance + F.abs(F.col(f"_new_{feature}") - current) / F.lit(width)
        branches.append(rows.withColumns({"n_changed": F.lit(n_changed), "distance": distance}))
    varied = reduce(DataFrame.unionByName, branches)
    return varied.withColumns({f: F.col(f"_new_{f}") for f in mutable}).drop(*[f"_new_{f}" for f in mutable])


def counterfactual_search(
    queries: DataFrame, train: DataFrame, features: Sequence[str], key: Sequence[str],
    mutable: Sequence[str], score: Callable[[DataFrame], DataFrame], per_query: int,
    overrides: Mapping[str, tuple[float, float]] | None = None, steps: Mapping[str, float] | None = None,
    stratum: str = "region_stratum", threshold: float = 0.5,
) -> DataFrame:
    """The closest permitted variations that flip each query's predicted class.

    Only mutable features change, and only within what training permits. Queries
    with nulls or outside the training profile are left out. Flipping variations
    with fewest changes come first, then smallest distance (to nine digits), then
    smallest values.
    The search is complete: it goes through all variations with one change, then
    all with two, and so on, and a query leaves once it has ``per_query`` of them.
    ``score`` adds a ``proba`` column; ``key`` names a query row.
    """
    profile = Profile.collect(training_profile(train, features))
    usable = in_distribution(complete_case(queries, features, "queries"), profile, features)
    waiting = cut(score(usable).withColumn("_was", F.col("proba") >= threshold).drop("proba"))
    found: DataFrame | None = None
    for n_changed in range(1, len(mutable) + 1):
        varied = variations(waiting, profile, mutable, n_changed, overrides, steps)
        # Few query rows become many variations: spread them before scoring.
        spread = varied.repartition(*key, *mutable)
        flipped = score(spread).filter((F.col("proba") >= threshold) != F.col("_was"))
        nearest = Window.partitionBy(*key).orderBy(F.round("distance", 9), *mutable)
        best = flipped.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= per_query)
        level = staged(best.drop("_was", "_rank"), "counterfactuals")
        found = level if found is None else found.unionByName(level)
        enough = found.groupBy(*key).count().filter(F.col("count") >= per_query)
        waiting = waiting.join(enough.select(*key), list(key), "left_anti")
        if waiting.isEmpty():
            break
    nearest = Window.partitionBy(*key).orderBy("n_changed", F.round("distance", 9), *mutable)
    return (
        found.withColumn("cf_rank", F.row_number().over(nearest))
        .filter(F.col("cf_rank") <= per_query)
        .withColumn("region_stratum_label", F.col(stratum))
        .select(*key, "cf_rank", "n_changed", "distance", *features, "proba", "region_stratum_label")
    )


def cells_between(thresholds: np.ndarray, low: float, high: float) -> np.ndarray:
    """(first, last) of each cell of [low, high]: a tree sends values up to and including
    its threshold left, so a cell ends at a threshold and the next begins just above it."""
    inner = np.unique(thresholds[(thresholds >= low) & (thresholds < high)])
    return np.column_stack([np.concatenate([[low], np.nextafter(inner, np.inf)]), np.concatenate([inner, [high]])])


def cell_points(cells: np.ndarray, value: float) -> np.ndarray:
    """The nearest point to ``value`` of each cell that does not hold it."""
    first, last = cells[(cells[:, 0] > value) | (cells[:, 1] < value)].T
    return np.where(first > value, first, last)


class _QuerySearch:
    """Variations of one row, nearest first, scored by the leaves that they can reach."""

    def __init__(self, leaf: LeafTables, x: np.ndarray, mutable: Sequence[int]):
        free = np.isin(leaf.feature, mutable) | (leaf.feature < 0)
        # What the other features rule out stays ruled out.
        reachable = (leaf.met(x[None], slice(None))[:, 0].T | free).all(axis=1)
        self.leaf = LeafTables(*[a[reachable] for a in leaf.arrays()])
        self.x = x

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return self.leaf.met(rows, slice(None)).all(axis=0) @ self.leaf.value

    def extremes(self, changed: Sequence[int]) -> tuple[float, float]:
        """Bounds of the margin over all values of ``changed``: each tree's least and most."""
        free = np.isin(self.leaf.feature, changed)
        left = (self.leaf.met(self.x[None], slice(None))[:, 0].T | free).all(axis=1)
        value, tree = self.leaf.value[left], self.leaf.tree[left]
        starts = np.flatnonzero(np.diff(tree, prepend=-1))
        return np.minimum.reduceat(value, starts).sum(), np.maximum.reduceat(value, starts).sum()


def _nearest_first(options: Mapping[int, tuple[np.ndarray, np.ndarray]], subsets: Sequence[tuple[int, ...]]):
    """(distance, features, values) of all combinations, by distance.

    ``options``: a feature's points and distances, ascending. A combination leads to those
    with one point farther, at the places from the last one moved on: each is made once.
    """
    heap = []
    for subset in subsets:
        if all(len(options[f][0]) for f in subset):
            heap.append((sum(options[f][1][0] for f in subset), subset, (0,) * len(subset), 0))
    heapq.heapify(heap)
    while heap:
        distance, subset, at, moved = heapq.heappop(heap)
        yield distance, subset, [options[f][0][k] for f, k in zip(subset, at)]
        for place in range(moved, len(subset)):
            away = options[subset[place]][1]
            if at[place] + 1 < len(away):
                nearer = (*at[:place], at[place] + 1, *at[place + 1 :])
                heapq.heappush(heap, (sum(options[f][1][k] for f, k in zip(subset, nearer)), subset, nearer, place))


def nearest_flips(
    leaf: LeafTables, x: np.ndarray, options: Mapping[int, tuple[np.ndarray, np.ndarray]], per_query: int,
    threshold_margin: float, batch: int = 256,
) -> list[tuple[int, float, float, np.ndarray]]:
    """(n_changed, distance, margin, row) of the first flips of one row.

    Level by level, fewest changes first. Subsets whose margin cannot pass the threshold
    whatever their values are left out; the rest is gone through by distance until enough
    flips are found and nothing as near (to nine digits) is left.
    """
    mutable = list(options)
    search = _QuerySearch(leaf, x, mutable)
    was = search.margins(x[None])[0] >= threshold_margin
    found: list[tuple[int, float, float, np.ndarray]] = []
    for n_changed in range(1, len(mutable) + 1):
        subsets = []
        for subset in combinations(mutable, n_changed):
            least, most = search.extremes(subset)
            # A little room, as sums are added in another order.
            if (least < threshold_margin + 1e-9) if was else (most >= threshold_margin - 1e-9):
                subsets.append(subset)
        level: list[tuple[float, tuple, float, np.ndarray, float]] = []
        waiting = _nearest_first(options, subsets)
        needed = per_query - len(found)
        while part := list(islice(waiting, batch)):
            rows = np.repeat(x[None], len(part), axis=0)
            for row, (_, subset, values) in zip(rows, part):
                row[list(subset)] = values
            margins = search.margins(rows)
            for k in np.flatnonzero((margins >= threshold_margin) != was):
                level.append((round(part[k][0], 9), tuple(rows[k][mutable]), margins[k], rows[k], part[k][0]))
            level.sort(key=lambda c: c[:2])
            if len(level) >= needed and part[-1][0] > level[needed - 1][0] + 1e-8:
                break
        found += [(n_changed, exact, margin, row) for _, _, margin, row, exact in level[:needed]]
        if len(found) >= per_query:
            break
    return found


def cell_search(
    model: PipelineModel, queries: DataFrame, train: DataFrame, key: Sequence[str], mutable: Sequence[str],
    per_query: int, overrides: Mapping[str, tuple[float, float]] | None = None,
    stratum: str = "region_stratum", threshold: float = 0.5,
) -> DataFrame:
    """The closest real-valued variations that flip each query's predicted class, exactly.

    Like ``counterfactual_search``, but continuous features take any value in their
    permitted range: of each cell between the trees' thresholds the point nearest to the
    row stands for the whole cell, at whose other points the prediction is the same.
    Categorical features take their observed categories. Each query is searched in one
    task, best first; the model and the profile are all that is shipped.
    """
    features = model_features(model)
    profile = Profile.collect(training_profile(train, features))
    usable = in_distribution(complete_case(queries, features, "queries"), profile, features)
    leaf = leaf_tables(model)
    thresholds = np.concatenate([leaf.low, leaf.high], axis=1)
    spots = [features.index(f) for f in mutable]
    permitted: dict[int, tuple[np.ndarray, bool, float]] = {}
    for name, spot in zip(mutable, spots):
        continuous, low, high, values = profile[name]
        low, high = map(float, (overrides or {}).get(name, (low, high)))
        if continuous:
            at = np.concatenate([leaf.feature, leaf.feature], axis=1) == spot
            permitted[spot] = cells_between(thresholds[at & np.isfinite(thresholds)], low, high), True, high - low
        else:
            permitted[spot] = np.array(values, float), False, high - low
    shipped = queries.sparkSession.sparkContext.broadcast((leaf.arrays(), permitted))
    margin = float(np.log(threshold / (1 - threshold)))
    inputs = [f"_x_{f}" for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, permitted = shipped.value
        leaf = LeafTables(*arrays)
        for pdf in batches:
            out = []
            for name, x in zip(pdf[list(key)].itertuples(index=False), pdf[inputs].to_numpy(dtype=float)):
                options = {}
                for spot, (given, continuous, width) in permitted.items():
                    points = cell_points(given, x[spot]) if continuous else given[given != x[spot]]
                    away = np.abs(points - x[spot]) / width if width > 0 else np.zeros(len(points))
                    order = np.lexsort((points, away))
                    options[spot] = points[order], away[order]
                for rank, (n_changed, distance, found, row) in enumerate(
                    nearest_flips(leaf, x, options, per_query, margin), 1
                ):
                    out.append((*name, rank, n_changed, distance, *row, 1 / (1 + np.exp(-found))))
            yield pd.DataFrame(out, columns=[*key, "cf_rank", "n_changed", "distance", *features, "proba"])

    kinds = dict(queries.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "cf_rank int, n_changed int, distance double",
                        *[f"`{f}` double" for f in features], "proba double"])
    # Few query rows are much work each: spread them.
    asked = usable.select(*key, *[F.col(f).cast("double").alias(x) for f, x in zip(features, inputs)]).repartition(*key)
    return asked.mapInPandas(run, schema).withColumn("region_stratum_label", F.col(stratum))
