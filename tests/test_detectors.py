"""Detectors: invariants, stability, and the whole pipelines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.operators import detectors as M
from ampledger.operators.components import connected_components
from ampledger.operators.forest import IsolationForest, average_path, feature_importance, permuted
from ampledger.plans import pipelines as P
from ampledger.plans.tables import Tables

SCHEMA = "meter_id long, a double, b double"


def cloud(spark, n=600, far=6):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (n, 2)))]
    rows += [(n + i, 9.0 + i, -9.0) for i in range(far)]
    return spark.createDataFrame(rows, SCHEMA)


def test_outliers_come_first_and_partitions_do_not_matter(spark):
    df = cloud(spark)
    forest = IsolationForest(n_trees=60, seed=7)
    one = forest.fit(df.coalesce(1), ["a", "b"]).score(df)
    two = forest.fit(df.repartition(11), ["a", "b"]).score(df.repartition(3))
    scores = {r.meter_id: r.raw_score for r in one.collect()}
    again = {r.meter_id: r.raw_score for r in two.collect()}
    assert scores == pytest.approx(again)
    top = sorted(scores, key=scores.get)[-6:]
    assert set(top) == set(range(600, 606))
    assert all(-0.5 <= s <= 0.5 for s in scores.values())
    assert len(scores) == 606


def test_forest_options(spark):
    df = cloud(spark, 200)
    for forest in (
        IsolationForest(20, 32, max_features=0.5),
        IsolationForest(20, 64, bootstrap=True),
        IsolationForest(20, 1000),
    ):
        model = forest.fit(df, ["a", "b"])
        assert model.nodes.tree.nunique() == 20
        assert model.sample_size == min(forest.sample_size, 206)
    flipped = IsolationForest(20, invert=False).fit(df, ["a", "b"]).score(df)
    assert flipped.orderBy("raw_score").first().meter_id >= 200


def test_average_path_values():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_permutation_keeps_the_values(spark):
    df = cloud(spark, 100, 0)
    after = permuted(df, ["a", "b"], "meter_id", 3).collect()
    for c in ("a", "b"):
        before = {r.meter_id: r[c] for r in df.collect()}
        assert {r.meter_id: r[c] for r in after} == before
        assert sorted(r[f"{c}@"] for r in after) == sorted(before.values())
        assert {r.meter_id: r[f"{c}@"] for r in after} != before
    one = permuted(df.where("meter_id = 1"), ["a"], "meter_id").collect()
    assert len(one) == 1 and one[0].a == one[0]["a@"]
    assert permuted(df.where("false"), ["a"], "meter_id").count() == 0


def test_importance_sums_to_one(spark):
    df = cloud(spark, 150).withColumn("flat", F.lit(1.0))
    model = IsolationForest(20).fit(df, ["a", "b", "flat"])
    rows = {r.feature: r.importance for r in feature_importance(model, df).collect()}
    assert sum(rows.values()) == pytest.approx(1) and rows["a"] > rows["flat"]


def test_input_contract(spark):
    df = cloud(spark, 50)
    with pytest.raises(ValueError):
        M.check_input(df.limit(5), ["a"])
    with pytest.raises(ValueError):
        M.check_input(df.withColumn("a", F.when(F.col("b") < 0, F.col("a"))), ["a"])
    with pytest.raises(ValueError):
        M.check_input(df.withColumn("a", F.lit(float("inf"))), ["a"])
    with pytest.raises(ValueError):
        M.check_input(df.withColumn("a", F.lit("x")), ["a"])


def test_threshold_flags_the_contaminated_share(spark):
    df = cloud(spark, 300, 0)
    fitted = M.fit(M.ZScoreDetector(), df, ["a", "b"], contamination=0.1)
    assert fitted.scores(df).agg(F.avg("flag")).first()[0] == pytest.approx(0.1, abs=0.01)
    batch = fitted.scores(df, batch=True)
    assert batch.agg(F.avg("flag")).first()[0] == pytest.approx(0.1, abs=0.01)
    single = fitted.scores(df.limit(1)).first()
    assert 0 <= single.score <= 1 and single.score != 0.5


def test_folds_partition_the_rows(spark):
    df = cloud(spark, 300, 0)
    parts = M.folds(df, "meter_id", 5)
    assert all(a.count() + b.count() == 300 for a, b in parts)
    assert sum(b.count() for _, b in parts) == 300
    train, rest = M.train_validation(df, "meter_id", 0.25)
    assert train.count() + rest.count() == 300 and 40 < rest.count() < 110


def test_grid_draws_and_patience():
    assert M.grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert M.draws({"a": range(100)}, 4) == M.draws({"a": range(100)}, 4)
    seen = []
    tuned = M.tune([{"x": v} for v in (3, 5, 1, 1, 9)], lambda p: seen.append(p) or p["x"], patience=2)
    assert tuned.best == {"x": 5} and len(seen) == 4


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (20, 2))])
    label = np.array([0] * 30 + [1] * 20)
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(label, x)], "k int, a double, b double")
    got = M.cluster_quality(df, "k", ["a", "b"]).first()
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    values = []
    for i in range(50):
        inner = d2[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        outer = d2[i, label != label[i]].mean()
        values.append((outer - inner) / max(inner, outer))
    assert got.silhouette_sq == pytest.approx(np.mean(values))
    alone = M.cluster_quality(df.where("k = 0"), "k", ["a", "b"]).first()
    assert (alone.davies_bouldin, alone.calinski_harabasz, alone.silhouette_sq) == (float("inf"), 0, -1)


def test_components_of_a_chain_and_a_star(spark):
    rng = np.random.default_rng(4)
    names = rng.permutation(300)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(99)] + [(int(names[100]), int(names[i])) for i in range(101, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in connected_components(df).collect()}
    assert len(roots) == 300
    assert {roots[int(n)] for n in names[:100]} == {int(names[:100].min())}
    assert {roots[int(n)] for n in names[100:]} == {int(names[100:].min())}
    assert connected_components(df.where("a < 0")).count() == 0


def test_training_and_single_meter(spark):
    trained = P.train(Tables(spark, "/root/testdata/sf0.001").dense(), IsolationForest(n_trees=20))
    row = trained.metrics.first()
    assert row.total_meters == trained.assessment.count() > 0
    months = {f"2024{m:02d}": 3.0 for m in range(1, 13)}
    one = P.one_meter(spark, "new", trained.baselines.first().transformer_id, months, trained).collect()
    assert len(one) == 1 and one[0].risk_level in ("HIGH", "MEDIUM", "LOW")


def test_dbscan_tuning_prefers_the_real_scale(spark):
    rows = [(i, 14.5 + (i % 6) * 1e-4, 121.0 + (i // 6) * 1e-4) for i in range(36)] + [(36, 14.6, 121.2), (37, 14.61, 121.3)]
    points = spark.createDataFrame(rows, "meter_id long, lat double, lon double")
    tuned = P.tune_dbscan(points, M.grid({"eps": [2.0, 20.0], "min_samples": [4]}))
    assert tuned.best["eps"] == 20.0 and len(tuned.trials) == 2


def test_upload_run_is_stored(spark, tmp_path):
    from ampledger.plans.intake import weekday_upload
    from ampledger.sources.writers import read_run

    folder = str(tmp_path / "runs")
    upload = weekday_upload(Tables(spark, "/root/testdata/sf0.001"))
    tables = P.run_upload(upload, M.ZScoreDetector(), folder, "first")
    stored = read_run(spark, folder, "meters", "first")
    assert stored.count() == upload.count() == tables["meters"].count()
    assert read_run(spark, folder, "summary", "first").first().total_meters == upload.count()
