"""Trees, SHAP, partial dependence, oversampling and counterfactuals."""

import dataclasses
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tables import SF_TINY

from surveyspark.operators import boxes, compare, counterfactual, explain, model, oversample, report, splits, stats
from surveyspark.plans import queries as q

FEATURES = q.MODEL.features


@pytest.fixture(scope="module")
def matrix(spark):
    return q.matrix(spark, SF_TINY)


@pytest.fixture(scope="module")
def fitted(spark):
    return q.fitted(spark, SF_TINY)


def log_odds(fitted, df):
    return model.score(fitted, df).withColumn("margin", F.log(F.col("proba") / (1 - F.col("proba"))))


def test_shap_adds_up_to_the_log_odds(matrix, fitted):
    keyed = matrix.select(*q.KEY, *FEATURES)
    phi = explain.shap_values(fitted, keyed, q.KEY).toPandas()
    total = phi["base_value"] + phi[[f"phi_{f}" for f in FEATURES]].sum(axis=1)
    margins = log_odds(fitted, keyed).select(*q.KEY, "margin").toPandas()
    joined = phi[q.KEY].assign(total=total).merge(margins, on=q.KEY)
    assert len(joined) == matrix.count()
    assert np.abs(joined["total"] - joined["margin"]).max() < 1e-9


def interaction_tables(tables) -> np.ndarray:
    """leaves x masks x slots x slots: half of each pair's interaction (i != j), by its definition."""
    d, paid = tables.width, explain._coalition_values(tables)
    phi = np.zeros((*paid.shape[:2], d, d))
    for i, j in itertools.combinations(range(d), 2):
        bi, bj = 1 << i, 1 << j
        for size, s in explain._subsets([m for m in range(d) if m not in (i, j)]):
            weight = explain.factorial(size) * explain.factorial(d - size - 2) / (2 * explain.factorial(d - 1))
            gain = paid[:, :, s | bi | bj] - paid[:, :, s | bi] - paid[:, :, s | bj] + paid[:, :, s]
            phi[:, :, i, j] += weight * gain
        phi[:, :, j, i] = phi[:, :, i, j]
    return phi


def random_leaves(rng, n_leaves, depth, n_features):
    """Leaves with up to ``depth`` different features each, unused slots neutral."""
    feature = np.full((n_leaves, depth), -1)
    low, high, ratio = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf), np.ones(feature.shape)
    for row in range(n_leaves):
        used = rng.integers(1, depth + 1)
        feature[row, :used] = rng.permutation(n_features)[:used]
        low[row, :used] = rng.normal(-0.5, 0.5, used)
        high[row, :used] = low[row, :used] + rng.random(used) * 2
        ratio[row, :used] = rng.uniform(0.05, 0.95, used)
    return explain.LeafTables(feature, low, high, ratio, rng.normal(size=n_leaves), np.zeros(n_leaves, int))


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_paths_equal_the_definition(depth):
    rng = np.random.default_rng(depth)
    leaf, x = random_leaves(rng, 300, depth, 7), rng.normal(size=(40, 7))
    by_table = explain.table_shapley(leaf, explain.shapley_tables(leaf), x, 7)
    assert np.abs(explain.path_shapley(leaf, x, 7) - by_table).max() < 1e-12
    pairs, table = [(0, 1), (1, 0), (2, 6)], interaction_tables(leaf)
    mask, wanted = leaf.masks(x, slice(None)), np.zeros((40, 3))
    for p, (a, b) in enumerate(pairs):
        for k in range(300):
            for i, j in itertools.product(*(np.nonzero(leaf.feature[k] == f)[0] for f in (a, b))):
                wanted[:, p] += table[k, mask[:, k], i, j]
    assert np.abs(explain.path_interactions(leaf, x, pairs) - wanted).max() < 1e-12


def test_paths_of_deep_leaves_add_up():
    """At depth 10 tables would need 4^10 numbers a leaf; paths need ten."""
    rng = np.random.default_rng(10)
    leaf, x = random_leaves(rng, 400, 10, 14), rng.normal(size=(50, 14))
    margin = leaf.met(x, slice(None)).all(axis=0) @ leaf.value
    total = explain.path_shapley(leaf, x, 14).sum(axis=1) + leaf.base()
    assert np.abs(total - margin).max() < 1e-9
    # Rows of the interaction matrix: a pair's values are symmetric.
    one, two = explain.path_interactions(leaf, x, [(3, 8), (8, 3)]).T
    assert np.abs(one - two).max() < 1e-12 and np.abs(one).max() > 0


def test_deep_trees_are_explained_by_paths(spark, matrix):
    """A model of depth 7, whose leaves are too wide for tables."""
    params = dataclasses.replace(q.MODEL, tree=dataclasses.replace(q.MODEL.tree, trees=3, depth=7))
    deep = model.fit_trees(splits.train_rows(matrix), FEATURES, params)
    assert explain.leaf_tables(deep).width > explain._TABLE_WIDTH
    phi = explain.shap_values(deep, matrix.select(*q.KEY, *FEATURES), q.KEY).toPandas()
    total = phi["base_value"] + phi[[f"phi_{f}" for f in FEATURES]].sum(axis=1)
    margins = log_odds(deep, matrix.select(*q.KEY, *FEATURES)).select(*q.KEY, "margin").toPandas()
    joined = phi[q.KEY].assign(total=total).merge(margins, on=q.KEY)
    assert np.abs(joined["total"] - joined["margin"]).max() < 1e-6


@pytest.mark.parametrize("measure", ["interaction", "attribution"])
def test_interaction_moments_equal_those_of_the_rows(matrix, fitted, measure):
    tables = explain.leaf_tables(fitted)
    others = [f for k, f in enumerate(FEATURES) if f != "m14" and len(tables.having(FEATURES.index("m14"), k).value)]
    pairs = [("m14", others[0]), ("m14", others[-1]), ("m14", "gone")]
    got = explain.interaction_summary(fitted, matrix.repartition(7), pairs, measure).toPandas()
    if measure == "interaction":
        rows = explain.shap_interactions(fitted, matrix, pairs, ["m14"]).toPandas()
        column = "phi_m14_x_{}".format
    else:
        rows = explain.shap_values(fitted, matrix, ["m14"]).toPandas()
        column = "phi_{}".format
    for other in {others[0], others[-1]}:
        want = rows.groupby("m14")[column(other)].agg(["mean", "std", "count"])
        have = got[got["pair"] == f"m14_x_{other}"].set_index("stratum").sort_index()
        assert have["count"].tolist() == want["count"].tolist() and want["mean"].abs().max() > 0
        assert np.allclose(have[["mean", "std"]], want[["mean", "std"]], atol=1e-12, equal_nan=True)
    with pytest.raises(ValueError, match="unknown measure"):
        explain.interaction_summary(fitted, matrix, pairs, "other")


def test_partial_dependence_equals_scoring_changed_rows(matrix, fitted):
    got = explain.partial_dependence(fitted, matrix, "m14").filter("grid_value = 3").collect()
    assert got
    for row in got:
        part = matrix.filter(F.col("region_stratum") == row["region_stratum"]).withColumn("m14", F.lit(3))
        mean = model.score(fitted, part).agg(F.avg("proba")).first()[0]
        assert row["average"] == pytest.approx(mean) and row["n"] == part.count()


def test_small_strata_are_flagged_not_computed(matrix, fitted):
    few = matrix.filter("region_stratum = 0").limit(25)
    rows = explain.partial_dependence(fitted, few, "m14").collect()
    assert [(r["n"], r["too_small"], r["average"]) for r in rows] == [(25, True, None)]


def test_dependence_grid_with_many_values(spark):
    rng = np.random.default_rng(0)
    values = rng.random(500)
    df = spark.createDataFrame(pd.DataFrame({"s": 1.0, "x": values}))
    row = explain.dependence_grid(df, "s", "x").first()
    n, ordered = 500, np.sort(values)
    def plotting(p):
        at = n * p + 0.4 + 0.2 * p
        k = int(np.floor(np.clip(at, 1, n - 1)))
        share = np.clip(at - k, 0, 1)
        return (1 - share) * ordered[k - 1] + share * ordered[k]
    assert np.allclose(row["grid"], np.linspace(plotting(0.05), plotting(0.95), 100))


def test_model_survives_saving(spark, matrix, fitted, tmp_path):
    model.save_model(fitted, str(tmp_path / "model"))
    again = model.load_model(str(tmp_path / "model"))
    assert model.model_features(again) == FEATURES
    sample = matrix.orderBy(*q.KEY).limit(50)
    first, second = (model.score(m, sample).orderBy(*q.KEY).select("proba").collect() for m in (fitted, again))
    assert first == second
    importance = explain.native_importance(again, matrix).collect()
    assert importance[0]["feature"] == "m14" and len(importance) == 15


def test_cross_validation_learns(matrix):
    cv = model.cluster_cv(splits.train_rows(matrix), FEATURES, q.MODEL).collect()
    assert cv and all(r["roc_auc"] > 0.5 for r in cv)


def test_a_fit_repeats_whatever_the_layout(matrix):
    """The same rows in one and in five partitions, and without their key."""
    train = splits.train_rows(matrix)
    sample = matrix.orderBy(*q.KEY).limit(200)
    for rows in (train, train.drop(*q.KEY)):
        layouts = (rows.coalesce(1), rows.repartition(5, "v190"))
        one, two = (model.score(model.fit_trees(r, FEATURES, q.MODEL), sample).orderBy(*q.KEY) for r in layouts)
        assert one.select("proba").collect() == two.select("proba").collect()


def test_unknown_imbalance_method(matrix):
    with pytest.raises(ValueError, match="unknown imbalance method"):
        model.fit_trees(matrix, FEATURES, q.MODEL, "other")


def test_single_class_training_side(matrix):
    ones = matrix.filter("sba = 1")
    with pytest.raises(ValueError, match="single class"):
        compare.fit_and_evaluate(ones, matrix, FEATURES, q.MODEL, "scenario2")


def test_training_rows_are_laid_out_once(spark, matrix, monkeypatch):
    """Training reads a kept layout, not a shuffle and a sort for each of its passes."""
    plans = []
    fit = model.GBTClassifier.fit

    def watched(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return fit(self, rows)

    monkeypatch.setattr(model.GBTClassifier, "fit", watched)
    model.fit_trees(matrix, FEATURES, q.MODEL, "none")
    assert len(plans) == 1 and "InMemoryTableScan" in plans[0]
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_fits_share_one_layout(spark, matrix, monkeypatch):
    """The folds' fits, and the scenarios', shuffle and sort their rows once, for the trees of fits of their own."""
    layouts, found = [], {}
    laid_out, fit_trees = model.fixed_layout, model.fit_trees

    def counted(*args):
        layouts.append(args)
        return laid_out(*args)

    def watched(train, *args, **more):
        fitted = fit_trees(train, *args, **more)
        found[train] = model.tree_model(fitted).toDebugString.split("\n", 1)[1]
        return fitted

    monkeypatch.setattr(model, "fixed_layout", counted)
    monkeypatch.setattr(model, "fit_trees", watched)
    monkeypatch.setattr(compare, "fit_trees", watched)
    model.cluster_cv(splits.train_rows(matrix), FEATURES, q.MODEL)
    assert len(layouts) == 1 and len(found) == q.MODEL.folds
    old, new = (matrix.filter(c).withColumn("round_cluster", F.col("v001").cast("string")) for c in ("bidx % 2 = 0", "bidx % 2 = 1"))
    compare.scenario_comparison(old, new, FEATURES, q.MODEL)
    assert len(layouts) == 2 and len(found) == q.MODEL.folds + 5
    for train in list(found)[::3]:
        alone = fit_trees(train, FEATURES, q.MODEL)
        assert model.tree_model(alone).toDebugString.split("\n", 1)[1] == found[train]
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_shallow_trees_keep_no_node_ids(matrix, monkeypatch):
    """Training keeps no copy of all rows' node ids a level, and the trees are the same."""
    train = splits.train_rows(matrix)
    assert not model.tree_classifier(q.FEW_TREES, 42, "sba").getCacheNodeIds()
    assert model.tree_classifier(dataclasses.replace(q.FEW_TREES, depth=12), 42, "sba").getCacheNodeIds()
    walked = model.tree_model(model.fit_trees(train, FEATURES, q.MODEL))
    monkeypatch.setattr(model, "_WALKED", 0)
    kept = model.tree_model(model.fit_trees(train, FEATURES, q.MODEL))
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]


def test_large_fits_run_one_after_another(spark):
    assert model.fits_at_once(spark.range(1000), 4) == 4
    assert model.fits_at_once(spark.range(3_000_000), 4) == 2
    assert model.fits_at_once(spark.range(20_000_000), 4) == 1
    assert model.fits_at_once(spark.range(0), 4) == 4


def brute_neighbours(x, k, n_continuous, penalty, asked):
    d = oversample._distances(x, x, n_continuous, penalty)
    np.fill_diagonal(d, np.inf)
    return {q: [i for i in np.lexsort((np.arange(len(x)), d[q]))[:k] if np.isfinite(d[q, i])] for q in asked}


@pytest.mark.parametrize(("pivots", "block_rows"), [(None, 1024), (1, 60), (6, 40), (90, 1024)])
def test_nearest_neighbours_equal_brute_force(spark, pivots, block_rows):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.integers(0, 4, (400, 4)).astype(float), columns=list("abcd"))
    pdf.loc[:150, "a"] = 1.0  # a crowded corner
    pdf["row_id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    got = oversample.nearest_neighbours(
        df, df.filter("row_id % 3 = 0"), "row_id", list("abcd"), 2, 1.7, 5, pivots=pivots, block_rows=block_rows
    ).toPandas()
    want = brute_neighbours(pdf[list("abcd")].to_numpy(), 5, 2, 1.7, range(0, 400, 3))
    assert {q: rows.sort_values("place")["other"].tolist() for q, rows in got.groupby("row_id")} == want


def test_nearest_neighbours_of_few_rows(spark):
    rows = spark.createDataFrame([(k, float(k * k), 1.0) for k in range(4)], "row_id long, a double, b double")
    got = oversample.nearest_neighbours(rows, rows, "row_id", ["a", "b"], 1, 1.0, 9).toPandas()
    assert got.groupby("row_id")["other"].apply(list).tolist() == [[1, 2, 3], [0, 2, 3], [1, 0, 3], [2, 1, 0]]


def test_neighbour_search_compares_far_fewer_than_all_pairs(spark):
    """Four times the rows: all pairs grow by 16, the pairs compared by clearly less."""
    rng = np.random.default_rng(9)

    def compared(n):
        x = np.column_stack([rng.random((n, 2)) * 100, rng.integers(0, 3, n)])
        df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(row_id=np.arange(n)))
        tree = oversample.PivotTree(df, "row_id", list("abc"), 2, 4.0, 5)
        home = tree.home(df)
        bounds = oversample.known_bounds(tree.nearest_in_blocks(home), "row_id", 5)
        return tree.compared_pairs(home) + tree.compared_pairs(tree.searches(home, bounds))

    small, large = compared(2000), compared(8000)
    assert small < 0.2 * 2000**2 and large < 0.1 * 8000**2
    assert large < 10 * small


def test_neighbour_search_returns_nothing_beyond_the_bounds(spark):
    """Shelves send back rows within a query's bound only, not k each."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.random((3000, 2)) * 100, rng.integers(0, 3, 3000)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(row_id=np.arange(3000)))
    tree = oversample.PivotTree(df, "row_id", list("abc"), 2, 4.0, 5)
    home = tree.home(df)
    bounds = oversample.known_bounds(tree.nearest_in_blocks(home), "row_id", 5)
    found = tree.nearest_in_blocks(tree.searches(home, bounds)).join(bounds, "row_id")
    assert found.count() > 0
    assert found.filter(F.col("distance") > F.col("bound") * (1 + 1e-5) + 1e-5).isEmpty()


def test_nearest_neighbours_far_from_the_origin(spark):
    """Small distances between large values: more than single precision holds."""
    rng = np.random.default_rng(6)
    x = np.column_stack([1e7 + rng.random((300, 2)), rng.integers(0, 3, 300)])
    x[:100, 0] *= -1e3
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(row_id=np.arange(300)))
    got = oversample.nearest_neighbours(df, df, "row_id", list("abc"), 2, 0.1, 5, pivots=6, block_rows=40).toPandas()
    want = brute_neighbours(x, 5, 2, 0.1, range(300))
    assert {q: rows.sort_values("place")["other"].tolist() for q, rows in got.groupby("row_id")} == want


def test_oversampling_equalises_and_invents_no_category(spark):
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame(
        {
            "age": rng.integers(15, 50, n).astype(float),
            "kind": rng.choice([-1.0, 1.0, 2.0], n),
            "y": (rng.random(n) < 0.25).astype(int),
        }
    )
    pdf.loc[pdf["y"] == 1, ["age", "kind"]] = np.where(
        (np.arange((pdf["y"] == 1).sum()) % 3 == 0)[:, None], [20.0, 2.0], pdf.loc[pdf["y"] == 1, ["age", "kind"]]
    )  # a third of the minority are copies of one row
    df = spark.createDataFrame(pdf)
    got = oversample.smotenc(df, ["age", "kind"], "y", ["age"], 5, 42).toPandas()
    counts = got["y"].value_counts()
    assert counts[0] == counts[1] == (pdf["y"] == 0).sum()
    assert set(got["kind"]) <= {-1.0, 1.0, 2.0}
    minority = pdf[pdf["y"] == 1]
    made = got[got["y"] == 1]
    assert made["age"].between(minority["age"].min(), minority["age"].max()).all()


@pytest.mark.parametrize("depth", [None, 4])
def test_shared_neighbours_give_each_fold_its_own_oversampling(spark, depth, monkeypatch):
    """Equal to a fresh search per fold, also where few neighbours are left (a small depth) and
    where a fold changes the price of a category; and one search where the depth settles all."""
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({
        "age": rng.integers(15, 50, n).astype(float), "visits": rng.integers(0, 9, n).astype(float),
        "kind": rng.choice([-1.0, 1.0, 2.0], n), "place": rng.choice([0.0, 1.0], n),
        "y": (rng.random(n) < 0.3).astype(float), "cv_fold": rng.integers(0, 4, n),
    })
    pdf.loc[pdf["cv_fold"] == 3, "age"] *= 2.0
    pdf.loc[:60, ["age", "visits", "kind", "place", "y"]] = [20.0, 3.0, 2.0, 1.0, 1.0]  # copies in all folds
    pool = spark.createDataFrame(pdf)
    features, args = ["age", "kind", "visits", "place"], ("y", ["age", "visits"])
    searches = []
    search = oversample.nearest_neighbours
    monkeypatch.setattr(oversample, "nearest_neighbours", lambda *a, **k: searches.append(1) or search(*a, **k))
    shared = oversample.FoldNeighbours(pool, features, *args, "cv_fold", 4, 42, depth)
    for fold in (None, 0, 3):
        rows = pool if fold is None else pool.filter(F.col("cv_fold") != fold)
        got = shared.oversampled(rows.select(*features, "y"), fold).toPandas()
        monkeypatch.undo()
        want = oversample.smotenc(rows.select(*features, "y"), features, *args, 4, 42).toPandas()
        monkeypatch.setattr(oversample, "nearest_neighbours", lambda *a, **k: searches.append(1) or search(*a, **k))
        order = [*features, "y"]
        got, want = (t.round(9).sort_values(order).reset_index(drop=True) for t in (got, want))
        pd.testing.assert_frame_equal(got, want)
    assert len(searches) <= (4 if depth else 2)


def test_oversampling_small_minorities(spark):
    def frame(n_minority):
        rows = [(float(i), 1.0, 0) for i in range(20)] + [(float(i), 2.0, 1) for i in range(n_minority)]
        return spark.createDataFrame(rows, "age double, kind double, y int")

    args = (["age", "kind"], "y", ["age"], 5, 42)
    assert oversample.smotenc(frame(0), *args).count() == 20
    assert oversample.smotenc(frame(1), *args).count() == 21
    assert oversample.smotenc(frame(3), *args).count() == 40


def test_counterfactuals_keep_their_promises(spark, matrix, fitted):
    got = q.QUERIES["counterfactuals"](spark, SF_TINY).toPandas()
    assert len(got) > 0 and (got.groupby(q.KEY)["cf_rank"].max() <= 3).all()
    origin = model.score(fitted, matrix).toPandas().set_index(q.KEY)
    for _, row in got.iterrows():
        was = origin.loc[tuple(row[q.KEY].astype(int))]
        assert (row["proba"] >= 0.5) != (was["proba"] >= 0.5)
        changed = [f for f in FEATURES if float(row[f]) != float(was[f])]
        assert set(changed) <= set(q.MODEL.mutable) and len(changed) == row["n_changed"]
        assert 0 <= row["m14"] <= 20


def test_counterfactual_search_is_complete(spark):
    """Against every point of the permitted grid, with a real-valued step."""
    from itertools import product

    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [
        (k, float(rng.integers(0, 14)), float(rng.choice([1.0, 2.0, 5.0])), float(rng.integers(0, 13)) / 4, int(k % 2))
        for k in range(300)
    ]
    names = ["k", "a", "kind", "real", "region_stratum"]
    train = spark.createDataFrame(rows, "k long, a double, kind double, real double, region_stratum int")
    value = lambda a, kind, real: 0.1 * a + 0.07 * kind * (real > 1.4) - 0.05 * real + 0.3
    score = lambda df: df.withColumn("proba", F.expr("0.1 * a + 0.07 * kind * CAST(real > 1.4 AS DOUBLE) - 0.05 * real + 0.3"))
    got = counterfactual.counterfactual_search(
        train.limit(40), train, names[1:], ["k"], ["a", "kind", "real"], score, 4,
        {"a": (0.0, 7.0)}, {"real": 0.25},
    ).toPandas()
    low, high = (f([r[3] for r in rows]) for f in (min, max))
    reals = np.arange(low, high + 1e-9, 0.25) if len({r[3] for r in rows}) > 10 else sorted({r[3] for r in rows})
    grid = list(product(range(8), sorted({r[2] for r in rows}), reals))
    width = (7.0, max(r[2] for r in rows) - min(r[2] for r in rows), high - low)
    asked = {r["k"]: r for r in train.limit(40).collect()}
    for k, row in asked.items():
        own = (row["a"], row["kind"], row["real"])
        was = value(*own) >= 0.5
        flips = []
        for point in grid:
            changed = sum(x != y for x, y in zip(point, own))
            if changed and (value(*point) >= 0.5) != was:
                moved = sum(abs(x - y) / w for x, y, w in zip(point, own, width))
                flips.append((changed, round(moved, 9), *map(float, point)))
        found = got[got["k"] == k].sort_values("cf_rank")
        have = [(r.n_changed, round(r.distance, 9), r.a, r.kind, r.real) for r in found.itertuples()]
        assert have == sorted(flips)[:4]


def random_trees(rng, n_trees, depth, n_features):
    """Leaves of complete trees whose thresholds are real numbers."""
    leaves = []

    def grow(path, level, tree):
        if level == depth:
            leaves.append((dict(path), rng.normal(), tree))
            return
        f, cut = int(rng.integers(0, n_features)), float(rng.normal())
        low, high = path.get(f, (-np.inf, np.inf))
        grow({**path, f: (low, min(high, cut))}, level + 1, tree)
        grow({**path, f: (max(low, cut), high)}, level + 1, tree)

    for tree in range(n_trees):
        grow({}, 0, tree)
    feature = np.full((len(leaves), depth), -1)
    low, high = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf)
    for row, (path, _, _) in enumerate(leaves):
        for slot, (f, (lo, hi)) in enumerate(path.items()):
            feature[row, slot], low[row, slot], high[row, slot] = f, lo, hi
    return explain.LeafTables(feature, low, high, np.ones(feature.shape),
                              np.array([v for _, v, _ in leaves]), np.array([t for _, _, t in leaves]))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_flips_equal_brute_force_over_cells(seed):
    """Every combination of cells, the nearest point of each; feature 3 is a category, 4 fixed."""
    rng = np.random.default_rng(seed)
    leaf = random_trees(rng, 3, 3, 5)
    thresholds = np.concatenate([leaf.low, leaf.high], axis=1)
    owner = np.concatenate([leaf.feature, leaf.feature], axis=1)
    for _ in range(5):
        x = rng.normal(size=5)
        x[3] = rng.integers(0, 3)
        options = {}
        for f in range(3):
            cells = counterfactual.cells_between(thresholds[(owner == f) & np.isfinite(thresholds)], -2.0, 2.0)
            points = counterfactual.cell_points(cells, x[f])
            options[f] = points, np.abs(points - x[f]) / 4.0
        options[3] = (points := np.array([v for v in (0.0, 1.0, 2.0) if v != x[3]])), np.abs(points - x[3]) / 2.0
        options = {f: (p[o], a[o]) for f, (p, a) in options.items() for o in [np.lexsort((p, a))]}
        margin = lambda row: leaf.met(row[None], slice(None)).all(axis=0)[0] @ leaf.value
        was = margin(x) >= 0
        flips = []
        for point in itertools.product(*[[x[f], *options[f][0]] for f in range(4)]):
            row = np.array([*point, x[4]])
            changed = [f for f in range(4) if row[f] != x[f]]
            if changed and (margin(row) >= 0) != was:
                moved = sum(abs(row[f] - x[f]) / (2.0 if f == 3 else 4.0) for f in changed)
                flips.append((len(changed), round(moved, 9), point))
        for batch in (1, 256):
            got = counterfactual.nearest_flips(leaf, x, options, 6, 0.0, batch)
            assert [(n, round(d, 9), tuple(row[:4])) for n, d, _, row in got] == sorted(flips)[:6]
            # Real values: nothing between the row and the found point flips by this one change.
            for n, _, _, row in got:
                if n == 1:
                    f = int(np.flatnonzero(row != x)[0])
                    if f < 3:
                        between = np.repeat(x[None], 50, axis=0)
                        between[:, f] = np.linspace(x[f], row[f], 50)
                        same = (leaf.met(between[:-1], slice(None)).all(axis=0) @ leaf.value >= 0) == was
                        assert same.all() or any(d < abs(row[f] - x[f]) / 4.0 for m, d, _, _ in got if m == 1)


def test_cells_end_at_thresholds():
    cells = counterfactual.cells_between(np.array([1.0, 3.0, 9.0]), 0.0, 5.0)
    assert cells.tolist() == [[0.0, 1.0], [np.nextafter(1.0, 2), 3.0], [np.nextafter(3.0, 4), 5.0]]
    assert counterfactual.cell_points(cells, 1.0).tolist() == [np.nextafter(1.0, 2), np.nextafter(3.0, 4)]
    assert counterfactual.cell_points(cells, 4.0).tolist() == [1.0, 3.0]
    assert counterfactual.cell_points(cells, 7.0).tolist() == [1.0, 3.0, 5.0]
    assert counterfactual.cells_between(np.array([]), 2.0, 2.0).tolist() == [[2.0, 2.0]]


def test_cell_search_agrees_with_the_grid(spark, matrix, fitted):
    """Thresholds of whole-number features lie on the grid: the nearest flip of the cells is as
    near as the grid's, but for the half step that a whole number is past a threshold."""
    got = q.QUERIES["counterfactual_cells"](spark, SF_TINY).toPandas()
    grid = q.QUERIES["counterfactuals"](spark, SF_TINY).toPandas()
    assert (got["proba"] >= 0).all() and set(map(tuple, got[q.KEY].values)) == set(map(tuple, grid[q.KEY].values))
    first, other = (t[t["cf_rank"] == 1].set_index(q.KEY).sort_index() for t in (got, grid))
    assert (first["n_changed"] == other["n_changed"]).all()
    assert (first["distance"] <= other["distance"] + 1e-6).all()
    origin = model.score(fitted, matrix).toPandas().set_index(q.KEY)["proba"]
    rescored = model.score(fitted, q._cell_counterfactuals(spark, SF_TINY).withColumnRenamed("proba", "claimed"))
    for row in rescored.toPandas().itertuples():
        assert row.proba == pytest.approx(row.claimed, abs=1e-9)
        assert (row.proba >= 0.5) != (origin.loc[(row.caseid, row.bidx)] >= 0.5)


def test_in_distribution_keeps_training_rows(matrix):
    profile = counterfactual.Profile.collect(stats.column_profile(matrix, FEATURES))
    assert counterfactual.in_distribution(matrix, profile, FEATURES).count() == matrix.count()
    outside = matrix.limit(3).withColumn("v106", F.lit(77))
    rejected = counterfactual.out_of_distribution_counts(outside, profile, FEATURES).collect()
    assert [(r["feature"], r["n_rejected"]) for r in rejected] == [("v106", 3)]


def test_summary_leaves_out_what_is_absent(spark):
    table = spark.createDataFrame([(0.9,)], "roc_auc double")
    text = report.run_summary({"cv": table, "gone": None}, None, {"note": "n"}).first()["summary"]
    assert '"cv"' in text and '"gone"' not in text and "shap" not in text
    cells = report.formatted(spark.createDataFrame([(None, 3)], "auc double, n int")).first()
    assert cells.asDict() == {"auc": "nan", "n": "3"}


def test_verdict_ties_keep_method_order(spark):
    rows = [("class_weight", 0.8, 0.2, 0.5), ("smote", 0.8, 0.1, 0.6), ("none", 0.7, 0.1, 0.6)]
    table = spark.createDataFrame(rows, "method string, roc_auc double, brier_score double, f1 double")
    got = compare.imbalance_verdict(table).first()
    assert (got["best_auc"], got["best_brier"], got["best_f1"]) == ("class_weight", "smote", "smote")
    assert not got["auc_and_brier_agree"]


def test_neighbours_of_few_queries_come_from_one_pass(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 5, (5000, 4)).astype(float), columns=list("abcd")).assign(row_id=np.arange(5000))
    df = spark.createDataFrame(pdf).repartition(3)
    got = oversample.nearest_by_scan(df, pdf.iloc[::700], "row_id", list("abcd"), 2, 1.7, 6).toPandas()
    want = brute_neighbours(pdf[list("abcd")].to_numpy(), 6, 2, 1.7, range(0, 5000, 700))
    assert {q: rows.sort_values("place")["other"].tolist() for q, rows in got.groupby("row_id")} == want


@pytest.mark.parametrize("known", [False, True])
def test_own_shelf_is_searched_before_the_rest(spark, known, monkeypatch):
    """Neighbours are exact, and the last search sends back fewer rows than the bounds of single blocks let through."""
    monkeypatch.setattr(oversample, "_SHELF_ROWS", 300)
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.random((2000, 2)) * 20, rng.integers(0, 3, (2000, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(row_id=np.arange(2000)))
    args = ("row_id", list("abcde"), 2, 4.0, 5)
    tree = oversample.PivotTree(df, *args, block_rows=50)
    home = tree.home(df)
    before = tree.nearest_in_blocks(tree.searches(home, oversample.known_bounds(tree.nearest_in_blocks(home), "row_id", 5))).count()
    want = brute_neighbours(x, 5, 2, 4.0, range(2000))
    rows = [(q, float(oversample._distances(x[[q]], x[n[-1:]], 2, 4.0)[0, 0])) for q, n in want.items() if q % 2]
    bounds = spark.createDataFrame(rows, "row_id long, bound double") if known else None
    sent, search = [], oversample.PivotTree.nearest_in_blocks
    monkeypatch.setattr(oversample.PivotTree, "nearest_in_blocks", lambda *a: sent.append(search(*a)) or sent[-1])
    got = oversample.nearest_neighbours(df, df, *args, block_rows=50, bounds=bounds).toPandas()
    assert {q: r.sort_values("place")["other"].tolist() for q, r in got.groupby("row_id")} == want
    assert len(sent) == 3 and sent[-1].count() < 0.8 * before


class Asked(Exception):
    pass


def test_summary_and_study_fit_all_published_rounds(spark, matrix, fitted, monkeypatch):
    """500 rounds at 0.03, not the few of the other queries."""
    asked = []

    def watched(result=None):
        def fit(rows, features, p, *args, **more):
            asked.append((p.tree.trees, p.tree.rate))
            if result is None:
                raise Asked
            return result
        return fit

    once = q._once
    monkeypatch.setattr(q, "_once", lambda s, d, name, build: once(s, d, name, build) if name == "matrix" else build())
    monkeypatch.setattr(model, "fit_final", watched(fitted))
    monkeypatch.setattr(model, "cluster_cv", watched())
    monkeypatch.setattr(compare, "imbalance_study", watched())
    for name in ("fitted_summary", "summary_keys", "imbalance_compare", "imbalance_folds", "imbalance_calibration"):
        with pytest.raises(Asked):
            q.QUERIES[name](spark, SF_TINY)
    assert len(asked) >= 7 and set(asked) == {(500, 0.03)}


def test_small_tables_have_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(model, "_PART_ROWS", 100)
    assert [model.layout_partitions(spark.range(n)) for n in (0, 100, 101, 100_000)] == [1, 1, 2, 8]


@pytest.mark.parametrize("case", ["crowded", "far", "real", "wide", "few"])
def test_nearest_in_boxes_equal_brute_force(spark, case, monkeypatch):
    """Several pieces, groups and slabs; categories beyond the screen; copies at equal distances."""
    for name, size in (("_BLOCK_ROWS", 20), ("_PIECE_ROWS", 150), ("_GROUP_ROWS", 200), ("_SLAB_ROWS", 30), ("_MOST_WIDTH", 12)):
        monkeypatch.setattr(boxes, name, size)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (900, 5)).astype(float)
    if case == "crowded":
        x[:300, 0] = 1.0
    elif case == "far":
        x[:, :2] = 1e7 + rng.random((900, 2))
        x[:300, 0] *= -1e3
    elif case == "real":
        x[:, :2] = rng.random((900, 2)) * 40 - 20
    elif case == "wide":
        x[:, 3] = rng.integers(0, 300, 900) / 7
    else:
        x = x[:4]
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(row_id=rng.permutation(len(x)))
    ordered = pdf.sort_values("row_id")[list("abcde")].to_numpy()
    got = boxes.nearest_in_boxes(spark.createDataFrame(pdf).repartition(3), F.col("row_id") % 3 == 0, "row_id", list("abcde"), 2, 1.7, 5).toPandas()
    want = brute_neighbours(ordered, 5, 2, 1.7, range(0, len(x), 3))
    assert {q: rows.sort_values("place")["other"].tolist() for q, rows in got.groupby("row_id")} == want
    i, j = got["row_id"].to_numpy(), got["other"].to_numpy()
    assert np.allclose(got["squared"], ((ordered[i, :2] - ordered[j, :2]) ** 2).sum(axis=1))
    assert got["differ"].tolist() == (ordered[i, 2:] != ordered[j, 2:]).sum(axis=1).tolist()
    assert np.allclose(got["distance"] ** 2, got["squared"] + 1.7 * got["differ"])


def test_oversampling_searches_once(spark, monkeypatch):
    """The lists are written before they are read, so that no search is left in the plan."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"age": rng.random(400) * 30, "kind": rng.integers(0, 3, 400) * 1.0, "y": (rng.random(400) < 0.3) * 1})
    made = oversample.smotenc(spark.createDataFrame(pdf), ["age", "kind"], "y", ["age"], 5, 42)
    assert "FlatMapCoGroups" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_meet_in_few_wide_groups(spark, monkeypatch):
    """Blocks travel packed, next to each group of the other side: no list of blocks or pairs a query."""
    for name, size in (("_BLOCK_ROWS", 50), ("_PIECE_ROWS", 400), ("_GROUP_ROWS", 2000)):
        monkeypatch.setattr(boxes, name, size)
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 40, (4000, 2)), rng.integers(0, 4, (4000, 8))]).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdefghij")).assign(row_id=np.arange(4000)))
    written, write = [], boxes.cut
    monkeypatch.setattr(boxes, "cut", lambda df: written.append(write(df)) or written[-1])
    found = boxes.nearest_in_boxes(df, F.lit(True), "row_id", list("abcdefghij"), 2, 9.0, 5)
    assert found.count() == 20_000
    blocks = written[0].toPandas()
    width = sum(blocks[c].map(len).sum() for c in ("ids", "rows", "asked", "bounds")) / 4000
    assert len(written) == 1 and blocks["n"].sum() == 4000 and width < 8 + 10 + 1 + 8 + 1
    assert boxes._groups(np.full(10, 400)).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 0, 1]
    assert boxes._groups(np.full(100, 400)).max() + 1 == 20


@pytest.mark.parametrize(("limit", "wanted"), [(8_000_000, 5), (10, 3), (7, 2), (1, 1)])
def test_fits_of_a_study_run_side_by_side_within_the_rows(matrix, monkeypatch, limit, wanted):
    """All folds of three methods on a small table; fewer where all their rows together are too many."""
    asked = []

    def watched(pool, features, p, method, parallelism, *shared):
        asked.append(parallelism)
        raise Asked

    rows = splits.train_rows(matrix).count()
    monkeypatch.setattr(model, "_ROWS_AT_ONCE", limit if wanted == 5 else limit * rows)
    monkeypatch.setattr(compare, "cluster_cv", watched)
    with pytest.raises(Asked):
        compare.imbalance_study(matrix, FEATURES, q.MODEL, ("none", "class_weight"), parallelism=3)
    assert set(asked) == {wanted}
