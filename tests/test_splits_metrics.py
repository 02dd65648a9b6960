"""Splits against brute force, metrics against numpy, and skewed inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import bootstrap, metrics, splits
from surveyspark.operators.prefix import hash_rank, interpolated_quantiles, prefix_sum
from surveyspark.operators.splits import _fold_phases


@pytest.mark.parametrize("seed", range(40))
def test_fold_phases_equal_the_greedy_rule(seed):
    rng = np.random.default_rng(seed)
    folds = int(rng.integers(2, 7))
    sizes = rng.integers(1, rng.integers(2, 30), int(rng.integers(1, 60)))
    if seed % 2:
        sizes[0] = sizes.sum()  # one cluster with about half of all rows
    load, expected = [0] * folds, []
    for size in sorted(sizes.tolist(), reverse=True):
        lightest = int(np.argmin(load))
        expected.append(lightest)
        load[lightest] += size
    unique, counts = np.unique(sizes, return_counts=True)
    phases = _fold_phases(unique[::-1], counts[::-1], folds)
    got = []
    for size, count in zip(unique[::-1].tolist(), counts[::-1].tolist()):
        own = [p for p in phases if p[0] == size]
        assert len(own) <= folds
        for rank in range(count):
            _, start, turn = [p for p in own if p[1] <= rank][-1]
            got.append(turn[(rank - start) % len(turn)])
    assert got == expected


def clustered(spark, n=6000, clusters=90, hot=0.33):
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(n) < hot, 7, rng.integers(0, clusters, n))
    y = rng.integers(0, 2, n)
    proba = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    pdf = pd.DataFrame({"v021": ids, "y": y, "proba": proba, "g": rng.integers(1, 4, n)})
    return spark.createDataFrame(pdf), pdf


def test_no_cluster_crosses_a_split(spark):
    df, pdf = clustered(spark)
    folded = splits.geographic_holdout(splits.group_folds(df, "v021", 5, 42), "v021", 0.2, 42)
    got = folded.toPandas()
    assert len(got) == len(pdf)
    assert (got.groupby("v021")["cv_fold"].nunique() == 1).all()
    assert (got.groupby("v021")["geo_holdout"].nunique() == 1).all()
    held = got[got["geo_holdout"]]["v021"].nunique()
    assert held == max(1, round(pdf["v021"].nunique() * 0.2))
    split = splits.group_shuffle_split(df, "v021", 0.2, 42).toPandas()
    assert split[split["is_test"]]["v021"].nunique() == int(np.ceil(pdf["v021"].nunique() * 0.2))
    kept, held_rows = splits.train_rows(folded).count(), splits.holdout_rows(folded).count()
    assert kept + held_rows == len(pdf)


def test_prefix_sums_per_part_with_a_dominant_part(spark):
    rng = np.random.default_rng(0)
    part = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 5, 3000))
    pdf = pd.DataFrame({"p": part, "k": rng.random(3000), "v": rng.integers(0, 9, 3000)})
    got = prefix_sum(spark.createDataFrame(pdf), ["p"], "k", ["v"], previous=True).toPandas()
    got = got.sort_values(["p", "k"])
    want = pdf.sort_values(["p", "k"])
    assert (got["cum_v"].to_numpy() == want.groupby("p")["v"].cumsum().to_numpy()).all()
    previous = want.groupby("p")["v"].shift().to_numpy()
    assert np.array_equal(got["prev_v"].to_numpy(dtype=float), previous, equal_nan=True)
    assert (got["total_v"].to_numpy() == want.groupby("p")["v"].transform("sum").to_numpy()).all()


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    got = hash_rank(df, "h").toPandas().sort_values("h")
    assert got["rank"].tolist() == list(range(500)) and set(got["n_keys"]) == {500}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.0, 1.0, 2000), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).groupBy("x").count()
    probabilities = [0.0, 0.025, 0.1, 0.5, 0.975, 1.0]
    got = interpolated_quantiles(df, [], "x", "count", probabilities).first()["quantiles"]
    assert np.allclose(got, np.quantile(values, probabilities))


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    total, previous = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - previous) * y[hit].mean()
        previous = recall
    return total


def test_ranking_metrics_equal_brute_force(spark):
    df, pdf = clustered(spark)
    got = metrics.ranking_metrics(metrics.score_counts(df)).first()
    y, p = pdf["y"].to_numpy(), pdf["proba"].to_numpy()
    assert got["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert got["average_precision"] == pytest.approx(brute_ap(y, p))
    per_group = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    for g, rows in pdf.groupby("g"):
        assert per_group[g] == pytest.approx(brute_auc(rows["y"].to_numpy(), rows["proba"].to_numpy()))


def test_ties_and_single_class(spark):
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, proba double")
    assert metrics.roc_auc(tied).first()["roc_auc"] == 0.5
    single = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, proba double")
    assert metrics.roc_auc(single).first()["roc_auc"] is None
    none_predicted = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, proba double")
    assert metrics.threshold_metrics(none_predicted).first().asDict() == {
        "precision": 0.0, "recall": 0.0, "f1": 0.0
    }
    equity = metrics.equity_table(single.withColumn("g", F.lit(1)), "g").first()
    assert equity["auc"] is None and equity["fpr"] is None and equity["tpr"] == 1.0


def test_constant_scores_fall_into_one_bin(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(20)], "y int, proba double")
    curve = metrics.calibration_curve(df).collect()
    assert len(curve) == 1 and curve[0]["frac_pos"] == 0.5


def test_published_hold_out_cells(spark):
    cells = [(1, 0.9, 670), (0, 0.9, 118), (1, 0.1, 168), (0, 0.1, 368)]
    df = spark.createDataFrame(cells, "y int, proba double, n int").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n")))
    )
    got = metrics.threshold_metrics(df).first()
    assert [round(got[c], 6) for c in ("precision", "recall", "f1")] == [0.850254, 0.799523, 0.824108]
    assert {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()} == {
        (1, 1): 670, (0, 1): 118, (1, 0): 168, (0, 0): 368
    }


def test_gaps_need_two_groups_and_full_cells(spark):
    rows = [(1, 0.9, "a")] * 6 + [(0, 0.1, "a")] * 6 + [(1, 0.1, "b")] * 4 + [(0, 0.9, "b")] * 6
    df = spark.createDataFrame(rows, "y int, proba double, g string")
    assert metrics.equity_gaps(df, "g").first().asDict() == {"tpr_gap": 1.0, "fpr_gap": 1.0}
    assert metrics.equity_gaps_min_cell(df, "g").first()["tpr_gap"] is None


def test_bootstrap_draws_every_slot(spark):
    df, pdf = clustered(spark)
    draws = bootstrap.cluster_draws(df, "v021", 12, 42).toPandas()
    clusters = pdf["v021"].nunique()
    drawn = pd.Series(np.concatenate(draws["replicates"].to_numpy())).value_counts()
    assert (drawn == clusters).all() and len(drawn) == 12
    ci = bootstrap.bootstrap_intervals(df, "v021", ["g"], 12, 42).toPandas().set_index("metric")
    assert (ci["lower"] <= ci["upper"]).all()
    assert ci.loc["roc_auc", "lower"] - 0.05 <= ci.loc["roc_auc", "estimate"] <= ci.loc["roc_auc", "upper"] + 0.05


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 20, "block_replicates": 4}])
@pytest.mark.parametrize("buckets", [2000, 5])
def test_bootstrap_equals_copied_rows(spark, distinct, limits, buckets, monkeypatch):
    """Every replicate equals the metrics of rows copied as often as their cluster was drawn;
    all scores distinct, and ties across many clusters and buckets."""
    monkeypatch.setattr(bootstrap, "_MOST_BUCKETS", buckets)
    rng = np.random.default_rng(11)
    n = 400
    proba = rng.random(n) if distinct else rng.integers(0, 6, n) / 5
    pdf = pd.DataFrame({
        "v021": rng.integers(0, 25, n), "g": rng.choice(["a", "b", None], n), "proba": proba,
        "y": (rng.random(n) < 0.2 + 0.6 * proba).astype(int),
    })
    df = spark.createDataFrame(pdf)
    got = bootstrap.bootstrap_statistics(df, "v021", ["g"], 9, 42, **limits).toPandas().sort_values("b")
    draws = bootstrap.cluster_draws(df, "v021", 9, 42)
    copied = df.join(draws, "v021").select("g", "y", "proba", F.explode("replicates").alias("b"))
    histogram = metrics.score_histogram(copied, ["b", "g"])
    want = metrics.statistic_vector(histogram, ["b"], ["g"]).toPandas().sort_values("b")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False, rtol=1e-9)


def test_bootstrap_of_many_clusters(spark):
    """100,000 clusters: nothing of their number goes through the driver or a broadcast."""
    n = 100_000
    df = spark.range(4 * n).select(
        F.pmod("id", F.lit(n)).alias("v021"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("y"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_003)) / 100_003).alias("proba"), F.lit("a").alias("g"),
    )
    got = bootstrap.bootstrap_statistics(df, "v021", ["g"], 6, 42).toPandas()
    assert sorted(got["b"]) == list(range(6))
    assert got["roc_auc"].between(0.49, 0.51).all() and got["brier_score"].between(0.32, 0.35).all()
    draws = bootstrap.cluster_draws(df, "v021", 6, 42)
    copied = df.join(draws, "v021").select("g", "y", "proba", F.explode("replicates").alias("b"))
    want = metrics.statistic_vector(metrics.score_histogram(copied, ["b", "g"]), ["b"], ["g"]).toPandas()
    pd.testing.assert_frame_equal(
        got.sort_values("b").reset_index(drop=True), want.sort_values("b").reset_index(drop=True), check_dtype=False, rtol=1e-9)
