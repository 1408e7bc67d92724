"""Literal cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampledger.functions.columns import haversine_m, sorted_median
from ampledger.operators import features as X
from ampledger.operators import quality as Q
from ampledger.operators import reshape as D
from ampledger.operators import risk as R
from ampledger.operators import runs as H
from ampledger.operators import scoring as C
from ampledger.operators.impute import impute, imputation_stats
from ampledger.operators.scaling import outlier_bounds, preprocess, treat_outliers
from ampledger.sources import readers, writers


def series(spark, values, meter="m"):
    rows = [(meter, "t", dt.date(2024, i + 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "meter_id string, transformer_id string, month date, kwh double")


def test_series_statistics(spark):
    row = X.meter_statistics(series(spark, [100.0, 110.0, 120.0, 130.0])).first()
    assert (row["mean"], row["min"], row["max"], row["range"]) == (115, 100, 130, 30)
    assert row["trend"] == pytest.approx(10)


def test_zero_series(spark):
    row = X.meter_statistics(series(spark, [0.0] * 4)).first()
    assert (row["mean"], row["trend"], row["zero_ratio"]) == (0, 0, 1)
    assert row["skewness"] is None


def test_month_mean_and_zero_fill(spark):
    rows = [("a", 100.0), ("b", 200.0), ("c", None)]
    df = spark.createDataFrame(rows, "meter_id string, kwh double").withColumn("month", F.lit(dt.date(2024, 1, 1)))
    filled = {r.meter_id: r.kwh_filled for r in impute(df, "mean").collect()}
    assert filled["c"] == 150
    assert {r.meter_id: r.kwh_filled for r in impute(df, "zero").collect()}["c"] == 0
    stats = imputation_stats(impute(df, "mean"), "mean").first()
    assert (stats.missing_before, stats.missing_after, stats.imputed) == (1, 0, 1)


def test_interpolation_and_edges(spark):
    df = series(spark, [None, 10.0, None, None, 40.0, None])
    got = [r.kwh_filled for r in impute(df, "interpolate").orderBy("month").collect()]
    assert got == [10, 10, 20, 30, 40, 40]
    back = [r.kwh_filled for r in impute(df, "backward_fill").orderBy("month").collect()]
    assert back == [10, 10, 40, 40, 40, 40]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        impute(series(spark, [1.0]), "guess")


def test_trend_methods(spark):
    df = series(spark, [500.0, 1.0, 10.0, 20.0, 30.0, 40.0, 500.0])
    assert X.meter_trend(df).first().trend == pytest.approx(10)  # the outlier does not matter
    assert X.meter_trend(df, "difference").first().trend == 499
    assert X.meter_trend(df, "percent_change").first().trend == pytest.approx(49_900)
    few = series(spark, [0.0, 0.0, 0.0, 0.0, 5.0, 6.0])
    assert X.meter_trend(few).first().trend is None
    assert X.meter_trend(few, include_zeros=True).first().trend is not None


def test_one_hot_and_labels(spark):
    df = spark.createDataFrame([("residential",), ("commercial",), ("industrial",)], "customer_class string")
    hot = D.one_hot(df, "customer_class", Q.CUSTOMER_CLASSES)
    assert hot.columns == [f"customer_class_{c}" for c in Q.CUSTOMER_CLASSES]
    assert [sum(r) for r in hot.collect()] == [1, 1, 1]
    codes = {r.customer_class: r.customer_class_encoded for r in D.label_encode(df, "customer_class").collect()}
    assert codes == {"commercial": 0, "industrial": 1, "residential": 2}


def test_months_are_found_in_order(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "meter_id string, monthly_consumption_202402 double, monthly_consumption_202401 double")
    assert D.month_columns(df) == ["monthly_consumption_202401", "monthly_consumption_202402"]
    long = D.to_long(df, ["meter_id"]).orderBy("month").collect()
    assert [(r.month.month, r.kwh) for r in long] == [(1, 2.0), (2, 1.0)]
    assert D.to_wide(D.to_long(df, ["meter_id"]), ["meter_id"]).first()[1:] == (2.0, 1.0)
    with pytest.raises(ValueError):
        D.month_columns(df.select("meter_id"))


def test_outliers_need_three_values(spark):
    two = series(spark, [1.0, 1000.0])
    assert outlier_bounds(two).count() == 0
    treated = treat_outliers(two, outlier_bounds(two)).collect()
    assert [r.kwh_capped for r in treated] == [r.kwh for r in treated]
    assert not any(r.is_outlier for r in treated)


def test_preprocess_invariants(spark):
    df = series(spark, [None, 5.0, 7.0, 6.0, None, 900.0]).unionByName(series(spark, [5.0] * 6, "n"))
    out = preprocess(df)
    assert out.where("kwh_filled is null or kwh_norm is null").count() == 0
    assert out.where("kwh_norm < 0 or kwh_norm > 1").count() == 0


def test_exactly_three_extreme_low_meters(spark):
    rows = [(i, r, 0.3) for i, r in enumerate([0.05, 0.10, 0.15, 0.8, 1.0])]
    df = spark.createDataFrame(rows, "meter_id int, ratio double, composite_score double")
    out = R.assess(df, flag=None).where("risk_level = 'high'").collect()
    assert len(out) == 3 and {r.risk_reason for r in out} == {"extreme_low_consumption"}


def test_boost_needs_three_flagged(spark):
    df = spark.createDataFrame([(i, 0.65, int(i < 2)) for i in range(6)], "meter_id int, composite_score double, spatial_anomaly int")
    assert R.spatial_boost(df).agg(F.max("spatial_boost")).first()[0] == 0
    more = df.withColumn("spatial_anomaly", F.lit(1))
    levels = {r.risk_reason for r in R.assess(more, ratio=None).collect()}
    assert levels == {"spatial_cluster_boost"}


def test_missing_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, 5.0)], "meter_id int, s double")
    got = [r.s for r in C.fill_missing(df, "s", "mean").orderBy("meter_id").collect()]
    assert got == [1, 3, 3, 5]
    with pytest.raises(ValueError):
        C.fill_missing(df, "s", "drop")
    constant = df.withColumn("s", F.lit(2.0))
    for method in ("minmax", "zscore", "robust"):
        assert {r.score for r in C.normalise_scores(constant, "s", method).collect()} == {0.5}


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        C.fuse({"iso": F.lit(1.0)}, {"iso": 0.5, "ratio": 0.3})


def test_confidence_warning_uses_the_raw_value(spark):
    df = spark.createDataFrame([("high",)] * 10, "risk_level string")
    row = R.confidence(df).first()
    assert (row.confidence, row.confidence_level, row.warning) == (0, "very_low", "rate_above_baseline")


def test_missing_prediction_columns(spark):
    df = spark.createDataFrame([("M001", 0.85), ("M002", 0.35)], "meter_id string, anomaly_score double")
    rows = R.complete_predictions(df).orderBy("meter_id").collect()
    assert [r.risk_level for r in rows] == ["HIGH", "LOW"]
    assert rows[0].confidence == pytest.approx(0.7)
    bare = R.complete_predictions(df.select("meter_id")).first()
    assert (bare.risk_level, bare.anomaly_score, bare.confidence) == ("UNKNOWN", 0.5, 0.5)


def test_serialised_arrays(spark):
    rows = [("[1, 2, 3]",), ("1,2,x",), ("4 5 6",), (None,), ("",), ("[1,-2,3]",), ("(1,2)",), (" [7, 8, 9] ",)]
    df = spark.createDataFrame(rows, "s string").select(F.monotonically_increasing_id().alias("id"), Q.parse_array("s").alias("v"))
    issues = {r.rule: r.n_bad for r in Q.check(df, Q.array_rules("v", length=3), "id").collect()}
    assert issues == {"array_format": 3, "array_length": 1, "array_values": 1}


def test_strict_validation_raises(spark):
    df = spark.createDataFrame([("a", 500.0)], "meter_id string, lat double")
    with pytest.raises(Q.ValidationError):
        Q.validate(df, [Q.in_range("lat", -90.0, 90.0)], "meter_id", strict=True)
    assert Q.verdict(Q.validate(df, [Q.not_null("lat")], "meter_id", strict=True)).first().is_valid


def test_sample_is_the_smallest_ids(spark):
    df = spark.range(1000).select(F.col("id").alias("meter_id"), F.lit(-1.0).alias("v"))
    row = Q.check(df.repartition(8), [Q.in_range("v", 0.0, 1.0)], "meter_id").first()
    assert row.n_bad == 1000 and row["sample"] == ["0", "1", "2", "3", "4"]


def test_upload_checks_and_padding(spark):
    months = ", ".join(f"monthly_consumption_20241{i} double" for i in range(3))
    df = spark.createDataFrame([("m", "t", 1.0, 2, 1.0, 2.0, 3.0)], f"meter_id string, transformer_id string, kVA double, barangay_id int, {months}")
    with pytest.raises(ValueError):
        readers.check_upload(df)
    with pytest.raises(ValueError):
        readers.check_upload(df.drop("kVA"))
    padded = readers.pad_months(df)
    assert D.month_columns(padded)[3] == "monthly_consumption_202501"
    assert len(D.month_columns(padded)) == 12 and padded.first()[-1] == 3.0


def test_csv_round_trip_is_stable(spark, tmp_path):
    path = str(tmp_path / "meters.csv")
    with open(path, "w") as out:
        out.write("meter_id,transformer_id,customer_class,lat,lon,monthly_consumption_202401,kVA\n")
        out.write("007,T1,Residential,14.5,NaN,,5\n008,T1,commercial,oops,121,12.5,6\n")
    first, second = (sorted(map(tuple, readers.read_meters(spark, path).collect())) for _ in range(2))
    assert first == second
    assert first[0] == ("007", "T1", "residential", 14.5, None, None, 5.0)
    assert first[1][3] is None


def test_runs_are_listed_read_and_deleted(spark, tmp_path):
    folder = str(tmp_path / "runs")
    df = spark.createDataFrame([("m", 0.5)], "meter_id string, anomaly_score double")
    for run in ("r1", "r2"):
        writers.save_run(run, {"meters": df}, folder)
    assert [r.run_id for r in H.list_runs(writers.run_log(spark, folder), 5).collect()] == ["r2", "r1"]
    assert writers.latest_run_id(spark, folder) == "r2"
    writers.delete_run(spark, folder, "r2")
    assert writers.latest_run_id(spark, folder) == "r1"
    assert writers.read_run(spark, folder, "meters", "r2").count() == 0
    assert writers.read_run(spark, folder, "meters", "r1").count() == 1
    with pytest.raises(ValueError):
        H.list_runs(writers.run_log(spark, folder), 0)


def test_distance_and_median(spark):
    df = spark.range(1).select(
        haversine_m(F.lit(14.5995), F.lit(120.9842), F.lit(14.6760), F.lit(121.0437)).alias("d"),
        sorted_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(10.0))).alias("m"),
    ).first()
    assert 10_000 < df.d < 11_000 and df.m == 2.5


def test_feature_collection_is_valid_json(spark):
    import json

    df = spark.createDataFrame([("t1", 121.0, 14.5, "B", 3, 1, 0.5, None)],
        "transformer_id string, lon double, lat double, barangay string, total_meters int, suspicious_meter_count int, avg_anomaly_score double, risk_level string")
    doc = json.loads(writers.feature_collection(writers.transformer_features(df)).first().geojson)
    assert doc["features"][0]["geometry"]["coordinates"] == [121.0, 14.5]
    assert doc["features"][0]["properties"]["risk_level"] is None
