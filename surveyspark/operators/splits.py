"""Cluster-safe folds, hold-outs and samples.

Each split is decided on the table of distinct clusters and joined back. Ranks
over clusters come from hash buckets (see ``prefix``), so no window ever spans
all clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.hashing import hash_key
from surveyspark.operators.prefix import hash_rank
from surveyspark.operators.quality import null_counts


def _fold_phases(sizes: np.ndarray, counts: np.ndarray, folds: int) -> list[tuple]:
    """Balanced assignment of a size histogram, largest size first.

    Each cluster goes to the fold with the fewest rows so far (lowest index on
    ties). While one size is being placed, the folds that lag behind take turns
    in a fixed order until they catch up with the next fold, which then joins
    the turn. One size therefore needs at most ``folds`` phases, however many
    clusters have it. Each phase is (size, first rank, order of folds).
    """
    load = np.zeros(folds, dtype=np.int64)
    phases = []
    for size, count in zip(sizes.tolist(), counts.tolist()):
        placed = 0
        while placed < count:
            turn = [int(i) for i in np.argsort(load, kind="stable") if load[i] - load.min() < size]
            ahead = [int(v) for i, v in enumerate(load) if i not in turn]
            phases.append((size, placed, turn))
            left = count - placed
            rounds = -(-(min(ahead) - int(load[turn].max())) // size) if ahead else left
            taken = min(left, rounds * len(turn))
            whole, extra = divmod(taken, len(turn))
            load[turn] += whole * size
            load[turn[:extra]] += size
            placed += taken
    return phases


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, count) for non-null clusters: what every split is decided on."""
    return df.filter(F.col(cluster).isNotNull()).groupBy(cluster).count()


def null_cluster_rows(df: DataFrame, clusters: Sequence[str]) -> DataFrame:
    """(column, n_null): rows without a cluster, which no split can place."""
    return null_counts(df, clusters)


def group_folds(
    df: DataFrame, cluster: str, folds: int, seed: int, name: str = "cv_fold",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Assign whole clusters to folds; rows without a cluster get a null fold.

    ``sizes`` may give the ``cluster_sizes`` table where it is already at hand.
    """
    sizes = sizes if sizes is not None else cluster_sizes(df, cluster)
    return df.join(fold_table(sizes, cluster, folds, seed, name), cluster, "left")


def fold_table(sizes: DataFrame, cluster: str, folds: int, seed: int, name: str = "cv_fold") -> DataFrame:
    """(cluster, fold), balanced by number of rows.

    Clusters are taken largest first (equal sizes in hash order), each to the
    currently lightest fold. That rule is sequential, but it depends only on how
    many clusters have each size. The sequence therefore runs over the size
    histogram, which has at most about sqrt(2 x rows) entries, and each
    cluster looks its fold up from its rank within its size.
    """
    sizes = sizes.withColumn("_hash", hash_key(cluster, seed))
    ranked = hash_rank(sizes, "_hash", parts=["count"], rank="_rank", count="_same")
    histogram = sizes.groupBy("count").agg(F.count(F.lit(1)).alias("n"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        rows = _fold_phases(pdf["size"].to_numpy(), pdf["n"].to_numpy(), folds)
        return pd.DataFrame(rows, columns=["size", "start", "turn"])

    phases = (
        histogram.select(F.col("count").alias("size"), "n")
        .groupBy()
        .applyInPandas(assign, "size long, start long, turn array<int>")
        .groupBy("size")
        .agg(F.sort_array(F.collect_list(F.struct("start", "turn"))).alias("_phases"))
    )
    reached = F.filter("_phases", lambda p: p["start"] <= F.col("_rank"))
    return (
        ranked.join(phases, F.col("count") == F.col("size"))
        .withColumn("_phase", F.element_at(reached, -1))
        .select(
            cluster,
            F.element_at(
                "_phase.turn",
                ((F.col("_rank") - F.col("_phase.start")) % F.size("_phase.turn") + 1).cast("int"),
            ).alias(name),
        )
    )


def _share_table(sizes: DataFrame, cluster: str, seed: int, quota: Column, flag: str) -> DataFrame:
    """(cluster, flag): the first ``quota`` clusters in hash order; ``n_keys`` is their number."""
    keys = sizes.select(cluster, hash_key(cluster, seed).alias("_hash"))
    return hash_rank(keys, "_hash").select(cluster, (F.col("rank") < quota).alias(flag))


def holdout_table(
    sizes: DataFrame, cluster: str, fraction: float, seed: int, name: str = "geo_holdout"
) -> DataFrame:
    """(cluster, flag): max(1, round(n * fraction)) whole clusters, rounding half to even."""
    quota = F.greatest(F.lit(1), F.bround(F.col("n_keys") * F.lit(fraction), 0).cast("long"))
    return _share_table(sizes, cluster, seed, quota, name)


def geographic_holdout(
    df: DataFrame, cluster: str, fraction: float, seed: int, name: str = "geo_holdout",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Hold out whole clusters; rows without a cluster get a null flag."""
    sizes = sizes if sizes is not None else cluster_sizes(df, cluster)
    return df.join(holdout_table(sizes, cluster, fraction, seed, name), cluster, "left")


def group_shuffle_split(
    df: DataFrame, cluster: str, fraction: float, seed: int, name: str = "is_test",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Put ceil(n * fraction) whole clusters in the test set; without a cluster, null."""
    quota = F.ceil(F.col("n_keys") * F.lit(fraction)).cast("long")
    sizes = sizes if sizes is not None else cluster_sizes(df, cluster)
    return df.join(_share_table(sizes, cluster, seed, quota, name), cluster, "left")


def train_rows(df: DataFrame, flag: str = "geo_holdout") -> DataFrame:
    return df.filter(~F.col(flag))


def holdout_rows(df: DataFrame, flag: str = "geo_holdout") -> DataFrame:
    return df.filter(F.col(flag))


def stratum_sample(
    df: DataFrame, stratum: str, outcome: str, key: Sequence[str], n: int, seed: int
) -> DataFrame:
    """Up to ``n`` rows with outcome 0 per stratum, in hash order of the row key.

    The rank filter is evaluated before the shuffle as well as after it: each
    task sends at most ``n`` rows per stratum, so a huge stratum is no problem.
    """
    hashed = hash_key(*key, seed)
    order = Window.partitionBy(stratum).orderBy("_hash", *key)
    return (
        df.filter((F.col(outcome) == 0) & F.col(stratum).isNotNull())
        .withColumn("_hash", hashed)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .drop("_hash", "_n")
    )
