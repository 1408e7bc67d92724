"""One answer whatever the size, the same features in training and scoring, stored models."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ampledger.operators import detectors as M
from ampledger.operators import grouped, risk
from ampledger.operators.forest import IsolationForest
from ampledger.operators.rollup import run_summary
from ampledger.operators.scaling import outlier_bounds
from ampledger.operators.features import transformer_baseline, transformer_spread
from ampledger.plans import pipelines as P
from ampledger.session import stored
from ampledger.sources import writers

LONG = "meter_id string, transformer_id string, month date, kwh double"


def readings(spark, odd=True):
    rows = [
        (f"M{m:03d}", f"T{m % 4}", 100.0 + m % 7 + (m * k * 31) % 23 + (5000.0 if m == 8 and k == 5 else 0.0), k)
        for m in range(60)
        for k in range(12)
    ]
    if odd:
        rows += [("X1", None, 50.0, k) for k in range(12)]
    frame = spark.createDataFrame(rows, "meter_id string, transformer_id string, kwh double, k int")
    return frame.select("meter_id", "transformer_id", F.make_date(F.lit(2024), F.col("k") + 1, F.lit(1)).alias("month"), "kwh")


def table(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(grouped, "EXACT_ROWS", -1)
        monkeypatch.setattr(grouped, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(grouped, "HOT_ROWS", 100)
    return request.param


def test_rows_without_a_group_belong_to_none(spark, size):
    long = stored(readings(spark))
    want = {"T0", "T1", "T2", "T3"}
    found = [transformer_baseline(long, s) for s in ("median", "mean", "trimmed_mean")]
    found += [transformer_spread(long, s) for s in ("mad", "iqr", "std")]
    found += [outlier_bounds(long, m) for m in ("sigma", "iqr", "percentile")]
    found += [outlier_bounds(long, "sigma", with_median=False)]
    for df in found:
        assert {r.transformer_id for r in df.collect()} == want
    totals = grouped.running_total(long, ["meter_id", "month"], keys=["transformer_id"])
    assert totals.count() == 720


def test_tied_hot_key_has_exact_quantiles(spark, size):
    rows = stored(spark.range(3000).select(F.lit("a").alias("k"), F.when(F.col("id") < 2900, 0.0).otherwise(F.col("id") * 1.0).alias("v")))
    got = grouped.group_quantiles(rows, ["k"], "v", {"low": 0.5, "high": 0.99}, accuracy=50).first()
    assert got.low == 0.0 and got.high == pytest.approx(2969.01)


def test_rows_without_a_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(grouped, "HOT_ROWS", 10)
    rows = spark.range(400).select("id", F.when(F.col("id") < 20, 1).alias("k"))
    side = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = grouped.salted_join(rows, side, ["k"])
    assert joined.count() == 400 and joined.where("v = 'x'").count() == 20


def test_text_ids_and_unreadable_districts_in_an_upload(spark):
    months = [f"2024{m:02d}" for m in range(1, 8)]
    rows = [(f"M{i}", f"TX_{i % 5:04d}", "77" if i % 6 == 0 else ("n/a" if i % 6 == 1 else str(i % 3 + 1)), 5.0, *[100.0 + i + k for k in range(7)]) for i in range(40)]
    names = ["meter_id", "transformer_id", "barangay_id", "kVA", *[f"monthly_consumption_{m}" for m in months]]
    upload = spark.createDataFrame(rows, names)
    tables = P.run_upload(upload, M.ZScoreDetector())
    assert tables["meters"].count() == 40 and tables["transformers"].count() == 5
    assert tables["meters"].where("city_id = 'unknown'").count() > 0
    summary = tables["summary"].first()
    best = max(tables["transformers"].collect(), key=lambda r: (r.avg_anomaly_score, [-ord(c) for c in r.transformer_id]))
    assert summary.most_anomalous_transformer == best.transformer_id
    trained = P.train(readings(spark), M.ZScoreDetector())
    scored = P.run_upload(upload, trained=trained)
    assert scored["meters"].where("anomaly_score is null").count() == 0


def test_ties_go_to_the_smallest_name(spark):
    level = F.lit("LOW").alias("risk_level")
    ts = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "transformer_id string, avg_anomaly_score double").select("*", level)
    bs = spark.createDataFrame([("y", 0.1), ("x", 0.1)], "barangay string, avg_risk_score double")
    cs = spark.createDataFrame([("q", 0.1), ("p", 0.1)], "city_name string, avg_risk_score double")
    row = run_summary(ts.select("risk_level"), ts, bs, cs).first()
    assert (row.most_anomalous_transformer, row.most_anomalous_barangay, row.most_anomalous_city) == ("a", "x", "p")


def test_unknown_ratio_is_not_high_risk(spark):
    trained = P.train(readings(spark), M.ZScoreDetector())
    row = trained.assessment.where("meter_id = 'X1'").first()
    assert row.ratio is None and row.risk_reason != "extreme_low_consumption"


@pytest.mark.parametrize("detector", [M.ZScoreDetector(), M.MahalanobisDetector(), IsolationForest(n_trees=20, sample_size=32)])
def test_training_rows_scored_again_are_equal(spark, detector):
    long = readings(spark)
    trained = P.train(long, detector)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    P.save_model(trained, folder)
    again = P.load_model(spark, folder)
    assert again.options == trained.options
    columns = ["meter_id", P.RATIO, P.TREND, P.BASELINE, P.SPREAD, "raw_score"]
    want = table(trained.fitted.training.where("transformer_id is not null").select(*columns))
    for model in (trained, again):
        got = P.score_new_meters(long, model).where("transformer_id is not null").select(*columns)
        assert table(got) == want


def test_file_in_predictions_out(spark):
    trained = P.train(readings(spark, odd=False), M.ZScoreDetector(), options=P.Options(contamination=0.05, outlier_method="iqr"))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    P.save_model(trained, f"{folder}/model")
    months = ",".join(f"monthly_consumption_2024{m:02d}" for m in range(1, 13))
    with open(f"{folder}/meters.csv", "w") as file:
        file.write(f"meter_id,transformer_id,customer_class,barangay,lat,lon,{months},kVA\n")
        file.write("N1,T1,residential,b,1.0,2.0," + ",".join("110" for _ in range(12)) + ",10\n")
        file.write("N2,nowhere,residential,b,1.0,2.0," + ",".join("5" for _ in range(12)) + ",10\n")
    got = P.predict_csv(spark, f"{folder}/meters.csv", f"{folder}/model", f"{folder}/out")
    assert sorted(r.meter_id for r in got.collect()) == ["N1", "N2"]
    assert spark.read.option("header", True).csv(f"{folder}/out").count() == 2
    with pytest.raises(ValueError):
        P.save_model(P.Trained(M.Fitted(M.UserModel(["x"], None, len), 0, 1, 0, 1, None), trained.baselines, P.Options()), folder)


def test_missing_scores_rank_last_with_ties(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", None), ("c", None)], "meter_id string, composite_score double")
    for n, want in ((1, {"a"}), (2, {"a", "b", "c"}), (3, {"a", "b", "c"})):
        got = risk.top_suspicious(df, n, include_ties=True).collect()
        assert {r.meter_id for r in got} == want
        assert all(r.priority_rank == (1 if r.meter_id == "a" else 2) for r in got)


def test_unknown_score_has_no_level(spark):
    df = spark.createDataFrame([(None,), (0.9,)], "s double").select(risk.level_of(F.col("s")).alias("l"))
    assert [r.l for r in df.collect()] == ["UNKNOWN", "HIGH"]


def test_cluster_quality_of_many_and_equal_labels(spark):
    rows = [(k, float(10 * k + i), float(i)) for k in range(150) for i in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "k int, u double, v double")
    got = M.cluster_quality(df, "k", ["u", "v"]).first()
    assert 0.9 < got.silhouette_sq <= 1 and got.davies_bouldin < 0.3
    same = spark.createDataFrame([(k, float(i)) for k in (0, 1) for i in (-1, 1)], "k int, u double")
    assert M.cluster_quality(same, "k", ["u"]).first().davies_bouldin == 0.0


def test_geojson_in_parts_is_one_document(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.range(500).select(
        F.concat(F.lit("T"), "id").alias("transformer_id"), F.to_json(F.struct("id")).alias("feature")
    )
    writers.write_feature_collection(df, f"{folder}/map")
    text = ""
    for name in sorted(os.listdir(f"{folder}/map")):
        if name.startswith("part-"):
            with open(f"{folder}/map/{name}") as file:
                text += file.read()
    doc = json.loads(text)
    assert len(doc["features"]) == 500 and doc["features"][0] == {"id": 0}
    writers.write_feature_collection(df.where("false"), f"{folder}/none")


def test_folds_are_the_same_elsewhere(spark):
    import hashlib

    got = spark.range(50).select("id", M.fold_of("id", 5).alias("f")).collect()
    assert all(r.f == int(hashlib.md5(f"42|{r.id}".encode()).hexdigest()[:8], 16) % 5 for r in got)


def test_undeclared_categories_are_an_error(spark):
    from pyspark.errors import PySparkException

    from ampledger.operators.reshape import one_hot, to_wide

    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert sorted(tuple(r) for r in one_hot(df, "c").collect()) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(PySparkException):
        one_hot(df, "c", ["a"]).collect()
    assert sorted(tuple(r) for r in one_hot(df, "c", ["a"], others="ignore").collect()) == [(0,), (0,), (1,)]
    twice = spark.createDataFrame([("m", "2024-01-01", 1.0), ("m", "2024-01-01", 2.0)], "meter_id string, d string, kwh double")
    assert to_wide(twice.withColumn("month", F.to_date("d")), ["meter_id"]).first()[1] == 3.0
    stray = spark.createDataFrame([("m", "1024-01-01", 1.0), ("m", "2024-01-01", 2.0)], "meter_id string, d string, kwh double")
    with pytest.raises(ValueError):
        to_wide(stray.withColumn("month", F.to_date("d")), ["meter_id"])
