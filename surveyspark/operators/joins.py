"""Validated m:1 join, unmatched report, and the cluster/region linkage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.recode import normalised, with_labels
from surveyspark.params import SAMPLING_COLUMNS, UNLABELLED_REGION


def _keys_are_unique(df: DataFrame, key: str) -> Column:
    """Scalar subquery: true, or a job failure if a key repeats.

    It reads only the key column and combines on the map side. Keeping it out
    of the join's inputs leaves both join sides as plain shuffles, which is what
    adaptive skew handling needs to split a hot key.
    """
    repeated = df.groupBy(key).count().agg(F.max("count").alias("most"))
    return repeated.select(
        F.when(F.col("most") > 1, F.raise_error(F.lit(f"m:1 join: {key} repeats on the right")).cast("boolean"))
        .otherwise(True)
    ).scalar()


def merge_many_to_one(
    births: DataFrame, women: DataFrame, key: str = "caseid", validate: bool = True
) -> DataFrame:
    """Inner join of births to their woman, checking that women are unique.

    The sampling columns of ``women`` are dropped: the births' copies win.
    """
    slim = women.drop(*SAMPLING_COLUMNS)
    left = births.filter(_keys_are_unique(women, key)) if validate else births
    return left.join(slim, key, "inner")


def unmatched_left(births: DataFrame, women: DataFrame, key: str = "caseid") -> DataFrame:
    """Births whose woman is absent."""
    return births.join(women.select(key), key, "left_anti")


def cluster_region_pairs(
    merged: DataFrame, geography: DataFrame, cluster: str = "v001", code: str = "v024"
) -> DataFrame:
    """Distinct (cluster, code) pairs with the geography of the cluster, if any."""
    pairs = merged.select(cluster, code).distinct()
    return pairs.join(geography, F.col(cluster) == F.col("DHSCLUST"), "left")


def _same_name(label: Column, name: Column) -> Column:
    """Equal after trimming and lower-casing; a null on either side is a mismatch."""
    return F.coalesce(normalised(label) == normalised(name), F.lit(False))


def linkage_check(
    pairs: DataFrame, labels: DataFrame, key: str, label: str,
    code: str = "v024", tolerance: float = 0.05,
) -> DataFrame:
    """Share of clusters whose configured region name differs from geography's."""
    named = with_labels(pairs, code, labels, key, label)
    mismatch = (~_same_name(F.col(label), F.col("ADM1NAME"))).cast("double")
    row = named.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.count_if(F.col(label).isNull()).alias("n_unmapped"),
        F.avg(mismatch).alias("mismatch_rate"),
    )
    return row.withColumn("passed", F.col("mismatch_rate") <= tolerance)


def region_crosswalk(
    pairs: DataFrame, labels: DataFrame, key: str, label: str, code: str = "v024"
) -> DataFrame:
    """Per region code: clusters, majority name and share, all names seen, and
    whether the configured label agrees with the majority.

    Pairs are first reduced to one row per (code, name). The names of one code
    are then few, however many clusters it has.
    """
    counts = pairs.filter(F.col(code).isNotNull()).groupBy(code, "ADM1NAME").count()
    # Most frequent first; equal counts by name, an unknown name last.
    ranked = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("count")).alias("order"),
                F.col("ADM1NAME").isNull().alias("unknown"),
                F.col("ADM1NAME").alias("name"),
                F.col("count").alias("n"),
            )
        )
    )
    per_code = counts.groupBy(code).agg(ranked.alias("names"), F.sum("count").alias("n_clusters"))
    majority = F.col("names")[0]
    listed = F.transform(
        "names",
        lambda x: F.format_string("%s (%d)", F.coalesce(x["name"], F.lit("nan")), x["n"]),
    )
    labelled = with_labels(per_code, code, labels, key, label)
    return labelled.select(
        F.col(code).alias("v024_code"),
        "n_clusters",
        majority["name"].alias("adm1name_majority"),
        F.round(majority["n"] / F.col("n_clusters"), 3).alias("adm1name_majority_share"),
        F.array_join(listed, ", ").alias("adm1name_all_seen"),
        F.coalesce(F.col(label), F.lit(UNLABELLED_REGION)).alias(
            "config_region_labels_says"
        ),
        _same_name(F.col(label), majority["name"]).alias("config_matches_majority"),
    )


def crosswalk_errors(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.agg(
        F.count_if(~F.col("config_matches_majority")).alias("n_wrong"),
        F.count(F.lit(1)).alias("n_codes"),
    )
