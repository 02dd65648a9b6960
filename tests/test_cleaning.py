"""Edge frames for cleaning, derivations, joins and sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surveyspark.functions import recode
from surveyspark.operators import joins, quality, stats
from surveyspark.params import CANONICAL_STRATUM_CODES, round_2016, round_2024
from surveyspark.sources import extracts, stages


def column(df, name):
    return [r[name] for r in df.collect()]


def test_plausibility_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 25), ("b", None), ("c", 5)], "caseid string, m14 int")
    assert sorted(column(quality.plausible(df, "m14", 20), "caseid")) == ["b", "c"]
    assert column(quality.implausible(df, "m14", 20), "caseid") == ["a"]


def test_outcome_is_tri_state(spark):
    rows = [(1, 0, 0, 0), (0, None, 0, 0), (None,) * 4, (None, 1, None, None)]
    df = spark.createDataFrame(rows, "m3a int, m3b int, m3c int, m3d int")
    got = column(recode.with_outcome(df, ["m3a", "m3b", "m3c", "m3d"], 1, "y"), "y")
    assert got == [1, 0, None, 1]


def test_missing_columns_are_named(spark):
    df = spark.range(1)
    with pytest.raises(KeyError, match="m14"):
        quality.complete_case(df, ["m14"], "births")
    with pytest.raises(KeyError, match="m3a"):
        recode.with_outcome(df, ["m3a"], 1, "y")


def test_complete_case_guard_fails_when_nothing_is_left(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a int, b int")
    with pytest.raises(Exception, match="removed ALL rows"):
        quality.guarded_complete_case(df, ["a", "b"], "births").collect()
    assert quality.guarded_complete_case(df.limit(0), ["a", "b"], "births").collect() == []


def test_duplicate_right_key_fails_the_join(spark):
    births = spark.createDataFrame([("a", 1), ("b", 1)], "caseid string, bidx int")
    women = spark.createDataFrame([("a", 30), ("a", 31)], "caseid string, v012 int")
    with pytest.raises(Exception, match="repeats on the right"):
        joins.merge_many_to_one(births, women).collect()
    good = joins.merge_many_to_one(births, women.limit(1))
    assert column(good, "v012") == [30]
    assert column(joins.unmatched_left(births, women), "caseid") == ["b"]


def test_bins_and_their_outside_values(spark):
    df = spark.createDataFrame([(14,), (15,), (19,), (49,), (50,), (None,)], "v012 int")
    bins = round_2024().age_bins
    got = column(df.select(recode.bin_text(bins, outside="nan").alias("g")), "g")
    assert got == ["nan", "[15, 20)", "[15, 20)", "[45, 50)", "nan", "nan"]
    parity = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (100,)], "v218 int")
    got = column(parity.select(recode.bin_labels(round_2024().parity_bins).alias("g")), "g")
    assert got == [None, "1", "2-3", "2-3", "4+", None]


def test_category_text_round_trip_and_rejection(spark):
    df = spark.createDataFrame([("1",), (" 2.0 ",), ("urban",)], "c string")
    assert column(df.select(recode.canonical_category("c").alias("c")), "c") == ["1.0", "2.0", "urban"]
    for bad in ("nan", "  ", None):
        frame = spark.createDataFrame([(bad,)], "c string")
        with pytest.raises(PySparkException, match="missing category"):
            frame.select(recode.canonical_category("c")).collect()
    with pytest.raises(PySparkException):
        df.select(recode.category_to_double("c")).collect()


def test_category_codes_ignore_the_subset(spark):
    full = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    codes = recode.category_codes(full, "s")
    part = recode.encode(spark.createDataFrame([("c",), ("z",), (None,)], "s string"), "s", codes)
    assert sorted(column(part, "s"), key=str) == [2, None, None]
    back = recode.decode(part, "s", codes, "label")
    assert {r["s"]: r["label"] for r in back.collect()}[2] == "c"


def test_canonical_encoding_drops_unknown_strata(spark):
    df = spark.createDataFrame([("Urban/Peri-urban",), ("Elsewhere",), (None,)], "s string")
    assert column(recode.canonical_encode(df, "s", CANONICAL_STRATUM_CODES), "s") == [2]
    assert column(recode.outside_canonical_count(df, "s", CANONICAL_STRATUM_CODES), "n_dropped") == [2]


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), (None, 1, 1.0)], "g string, sba int, weight double")
    row = stats.weighted_prevalence(df, "g").collect()
    assert len(row) == 1 and row[0]["n"] == 2
    assert row[0]["weighted_sba_prevalence"] == pytest.approx(2 / 3)


def test_single_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert stats.spread(df, "g", "v").first()["std"] is None


def test_majority_ties_take_the_smaller_value(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "g string, v string")
    assert {r["g"]: r["v"] for r in stats.majority(df, "g", "v").collect()} == {"x": "a", "y": "c"}


def test_feature_list_and_rounds():
    new, old = round_2024(), round_2016()
    assert len(new.features) == 25 and new.features[-1] == "region_stratum"
    assert "v131" not in new.features and new.features == old.features
    assert (old.recency_max, new.recency_max) == (35, 59)
    assert "b6" not in new.birth_required and "v511" not in new.women_required


def test_sources(spark, tmp_path):
    root = str(tmp_path / "data")
    df = spark.createDataFrame([("a", 1, 3), ("b", 2, None)], "caseid string, bidx int, extra int")
    extracts.write_stage(df, f"{root}/deep/extract.parquet")
    scanned = extracts.scan_extract(spark, root, ["caseid", "bidx"], pattern="*.parquet")
    assert scanned.columns == ["caseid", "bidx"] and scanned.count() == 2
    with pytest.raises(KeyError, match="v012"):
        extracts.scan_extract(spark, root, ["v012"], pattern="*.parquet")
    with pytest.raises(FileNotFoundError):
        extracts.read_stage(spark, f"{root}/absent")
    assert extracts.scan_clusters(spark, f"{root}/absent") is None
    extracts.write_csv(df, f"{root}/csv")
    extracts.write_json(df, f"{root}/json")
    again = spark.read.schema(df.schema).option("header", True).csv(f"{root}/csv")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert spark.read.json(f"{root}/json").filter("extra IS NULL").count() == 1


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kept = quality.complete_case(df, ["l_partkey"]).select("l_orderkey")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(l_partkey)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_matrix_with_nulls_is_refused(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "v012 int, m14 int")
    assert [tuple(r) for r in quality.matrix_nulls(df, ["v012", "m14"]).collect()] == [("v012", 1)]
    with pytest.raises(Exception, match="missing values"):
        quality.assert_no_nulls(df, ["v012", "m14"]).collect()
    assert quality.assert_no_nulls(df.limit(1), ["v012", "m14"]).count() == 1


def test_result_columns_take_labels(spark):
    df = spark.createDataFrame([(1, 2)], "m14 int, other int")
    got = recode.relabel_columns(df, {"m14": "Visits", "v012": "Age"})
    assert got.columns == ["Visits", "other"]


def test_stages_are_committed_used_again_and_removed(spark, tmp_path):
    root = f"{tmp_path}/store"
    made = []

    def build(n):
        made.append(n)
        return spark.range(n).withColumn("part", F.col("id") % 2)

    with stages.StageStore(spark, root) as store:
        with pytest.raises(stages.UnfinishedStage, match="matrix"):
            store.read("matrix")
        assert store.once("matrix", lambda: build(5), {"year": 2024, "files": ["a", "b"]}).count() == 5
        assert store.once("matrix", lambda: build(6), {"files": ["a", "b"], "year": 2024}).count() == 5
        assert made == [5]
        first = store.read("matrix")
        assert store.once("matrix", lambda: build(6), {"year": 2016, "files": ["a", "b"]}).count() == 6
        # A reader of the earlier version keeps it, and the new one counts from now on.
        assert (first.count(), store.read("matrix").count(), made) == (5, 6, [5, 6])
        assert store.read("matrix").schema == first.schema and store.names() == ["matrix"]
        # A writer that dies leaves no record: the stage is refused, whatever files there are.
        spark.range(3).write.parquet(f"{root}/half/0123")
        with pytest.raises(stages.UnfinishedStage):
            store.read("half")

        def fail():
            return spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

        with pytest.raises(Exception, match="lost"):
            store.write("matrix", fail())
        assert store.read("matrix").count() == 6
    assert not (tmp_path / "store").exists()


def test_training_profile_keeps_bounded_states(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "many": rng.normal(size=500), "eleven": np.arange(500) % 11, "ten": np.arange(500) % 10,
        "named": np.arange(500) % 40, "holes": np.where(np.arange(500) % 3 == 0, np.nan, 2.0),
    })
    df = spark.createDataFrame(pdf).withColumn("holes", F.when(~F.isnan("holes"), F.col("holes")))
    df = df.withColumn("odd", F.when(F.col("ten") == 3, float("nan")).when(F.col("ten") > 3, 1.0)).withColumn(
        "none", F.lit(None).cast("double"))
    columns = ["many", "eleven", "ten", "named", "holes", "odd", "none"]
    for parts in (1, 7):
        got = {r["column"]: r for r in stats.training_profile(df.repartition(parts), columns, ("named",)).collect()}
        assert set(got) == set(columns) - {"none"}
        assert [got[c]["is_continuous"] for c in columns[:5]] == [True, True, False, False, False]
        assert got["many"]["values"] is None and got["eleven"]["values"] is None
        assert (got["many"]["min_value"], got["many"]["max_value"]) == (pdf["many"].min(), pdf["many"].max())
        assert got["ten"]["values"] == list(range(10)) and got["named"]["values"] == list(range(40))
        assert got["holes"]["values"] == [2.0] and np.isnan(got["odd"]["max_value"]) and len(got["odd"]["values"]) == 2
    # No task keeps more than its extremes and a few values of a continuous column.
    states = stats.value_states(df.repartition(7), ["many"], (), 10).collect()
    assert {len(r["values"]) for r in states} == {11}
    full = stats.column_profile(df, columns, ("named",)).collect()
    assert {r["column"]: r["n_distinct"] for r in full} == {
        "many": 500, "eleven": 11, "ten": 10, "named": 40, "holes": 1, "odd": 2}
    assert stats.training_profile(df.limit(0), columns).count() == 0


def test_funnel_is_read_off_the_job(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 5), (3, 9)], "a int, b int")
    stages_ = [("a", F.col("a").isNotNull()), ("b", F.col("b") > 4)]
    funnel = quality.Funnel("test")
    funnel.watch(df, stages_).filter("a > 1").write.format("noop").mode("overwrite").save()
    assert funnel.table(spark).collect() == quality.stage_funnel(df, stages_).collect()
