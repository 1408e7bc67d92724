"""Cross-validated tuning: metrics and forests against plain NumPy, registration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampledger.operators import tuning as U
from ampledger.operators.detectors import fold_of
from ampledger.operators.forest import HASH_RANGE, IsolationForest, average_path, grow
from ampledger.plans import pipelines as P
from ampledger.sources.models import load_fitted


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (260, 2)), rng.normal(6, 1, (40, 2))])
    rows = [(i, i % 5, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "meter_id long, transformer_id long, u double, v double")


def measured(x, raw, metric, share):
    """One fold's metric, rows against rows."""
    if metric == "separation":
        high = raw >= np.quantile(raw, 0.9)
        return raw[high].mean() - (raw[~high].mean() if (~high).any() else 0.0)
    label = raw > np.quantile(raw, 1 - share)
    if label.all() or not label.any():
        return U.METRICS[metric][1]
    c = np.array([x[label == k].mean(axis=0) for k in (False, True)])
    own = ((x - c[label.astype(int)]) ** 2).sum(axis=1)
    n = np.array([(~label).sum(), label.sum()])
    gap = ((c[0] - c[1]) ** 2).sum()
    if metric == "davies_bouldin":
        return sum(np.sqrt(own[label == k]).mean() for k in (False, True)) / np.sqrt(gap)
    if metric == "calinski_harabasz":
        return (n[0] * n[1] / n.sum() * gap) / (own.sum() / (n.sum() - 2))
    far = ((x[:, None] - x) ** 2).sum(axis=2)
    far = np.sqrt(far) if metric == "silhouette" else far
    values = []
    for i, k in enumerate(label):
        if (label == k).sum() == 1:
            values.append(0.0)
            continue
        a, b = far[i, label == k].sum() / ((label == k).sum() - 1), far[i, label != k].mean()
        values.append((b - a) / max(a, b))
    return float(np.mean(values))


@pytest.mark.parametrize("metric", sorted(U.METRICS))
def test_metrics_of_all_trials_and_folds(spark, metric):
    rng = np.random.default_rng(3)
    contamination = {0: 0.1, 1: 0.3, 2: 0.1}
    rows = []
    for trial in contamination:
        for fold in range(2):
            for _ in range(60):
                u, v = rng.normal(0, 2, 2)
                rows.append((trial, fold, float(np.hypot(u, v) + rng.normal(0, 0.3)) if trial < 2 else 1.0, float(u), float(v)))
    df = spark.createDataFrame(rows, "trial int, fold int, raw_score double, u double, v double")
    got = {(r.trial, r.fold): r.value for r in U.fold_metrics(df, ["u", "v"], metric, contamination).collect()}
    for (trial, fold), part in pd.DataFrame(rows, columns=["t", "f", "raw", "u", "v"]).groupby(["t", "f"]):
        want = measured(part[["u", "v"]].to_numpy(), part["raw"].to_numpy(), metric, contamination[trial])
        assert got[trial, fold] == pytest.approx(want, rel=1e-6), (trial, fold)


def plain_forest(frame, hashes, held_out, option, seed, fold):
    """Scores of the rows of one fold by trees grown one after the other on the others."""
    x = frame[["u", "v"]].to_numpy()
    mine, others = np.flatnonzero(held_out), np.flatnonzero(~held_out)
    total = np.zeros(len(mine))
    for tree in range(option["n_trees"]):
        rows = others[np.lexsort((frame["meter_id"].to_numpy()[others], hashes[others, tree]))][: option["sample_size"]]
        rng = np.random.default_rng([seed, tree, fold, option["sample_size"]])
        used = np.sort(rng.permutation(2)[:2])
        nodes = grow(x[rows], used, max(1, int(np.ceil(np.log2(len(rows))))), rng)
        for i, row in enumerate(x[mine]):
            at = nodes[0]
            while at[1] >= 0:
                at = nodes[at[3] if row[at[1]] <= at[2] else at[4]]
            total[i] += at[5]
    return mine, np.exp2(-total / option["n_trees"] / average_path(len(rows))) - 0.5


def test_forests_of_all_folds_equal_plain_ones(spark, table, monkeypatch):
    seen = []
    scored = U._scored
    monkeypatch.setattr(U, "_scored", lambda *a: seen.append(scored(*a)) or seen[-1])
    options = [{"n_trees": 5, "sample_size": 32}, {"n_trees": 3, "sample_size": 64}, {"n_trees": 4, "sample_size": 32}]
    got = U.tune_forest(table, ["u", "v"], options, folds=3, rounds=1, seed=9)
    assert len(got.trials) == 3 and got.best in options and got.folds.count() == 9
    every = [F.pmod(F.xxhash64(F.lit(9), F.lit(t), F.col("meter_id")), F.lit(HASH_RANGE)).alias(f"h{t}") for t in range(5)]
    frame = table.select("*", fold_of("meter_id", 3, 9).alias("fold"), *every).orderBy("meter_id").toPandas()
    hashes = frame[[f"h{t}" for t in range(5)]].to_numpy()
    rows = seen[0].toPandas()
    for trial, option in enumerate(options):
        for fold in range(3):
            mine, raw = plain_forest(frame, hashes, (frame["fold"] == fold).to_numpy(), option, 9, fold)
            part = rows[(rows.trial == trial) & (rows.fold == fold)].sort_values(["u", "v"])
            want = frame.iloc[mine].assign(raw=raw).sort_values(["u", "v"])
            assert np.allclose(part["raw_score"], want["raw"]) and len(part) == len(want)


def test_a_fitted_forest_equals_a_plain_one(table):
    """The detector itself: scores of a sequential forest on the same samples."""
    model = IsolationForest(n_trees=4, sample_size=50, seed=3).fit(table, ["u", "v"])
    every = [F.pmod(F.xxhash64(F.lit(3), F.lit(t), F.col("meter_id")), F.lit(HASH_RANGE)).alias(f"h{t}") for t in range(4)]
    frame = table.select("*", *every).orderBy("meter_id").toPandas()
    x = frame[["u", "v"]].to_numpy()
    total = np.zeros(len(x))
    for t in range(4):
        rows = np.lexsort((frame["meter_id"], frame[f"h{t}"]))[:50]
        rng = np.random.default_rng([3, t])
        nodes = grow(x[rows], np.sort(rng.permutation(2)[:2]), 6, rng)
        for i, row in enumerate(x):
            at = nodes[0]
            while at[1] >= 0:
                at = nodes[at[3] if row[at[1]] <= at[2] else at[4]]
            total[i] += at[5]
    want = np.exp2(-total / 4 / average_path(50)) - 0.5
    got = model.score(table).orderBy("meter_id").toPandas()["raw_score"]
    assert np.allclose(got, want)


def test_portions_give_the_same_answer(table, monkeypatch):
    options = [{"n_trees": t, "sample_size": s} for t in (4, 8) for s in (16, 32)]
    whole = U.tune_forest(table, ["u", "v"], options, folds=2, rounds=1, metric="calinski_harabasz")
    assert len(whole.trials) == 4 and [v for v, _ in whole.trials] == sorted((v for v, _ in whole.trials), reverse=True)
    halved = U.tune_forest(table, ["u", "v"], options, folds=2, rounds=2, metric="davies_bouldin")
    assert sorted(map(str, (p for _, p in halved.trials))) == sorted(map(str, options))
    assert halved.folds.select("trial").distinct().count() == 2
    monkeypatch.setattr(U, "MAX_NODES", 1)
    parts = U.tune_forest(table, ["u", "v"], options, folds=2, rounds=1, metric="calinski_harabasz")
    assert [(pytest.approx(v), p) for v, p in whole.trials] == parts.trials
    assert len(U._portions([0, 1, 2, 3], {i: U.FOREST_OPTIONS | o for i, o in enumerate(options)}, 2, 1)) == 4


def test_best_model_becomes_a_version(spark, table, tmp_path):
    folder = str(tmp_path / "registry")
    assert U.versions(spark, folder).count() == 0
    for _ in range(2):
        tuned = P.tune_isolation_forest(
            table, ["u", "v"], [{"n_trees": 4}, {"n_trees": 8, "contamination": 0.2}], folds=2, metric="silhouette_sq", registry=folder
        )
    rows = U.versions(spark, folder).orderBy("version").collect()
    assert [r.version for r in rows] == [1, 2] and {r.model_type for r in rows} == {"isolation_forest"}
    assert rows[1].performance_metrics == {"silhouette_sq_score": pytest.approx(tuned.trials[0][0])}
    fitted, _ = load_fitted(spark, f"{folder}/models/{rows[1].model_id}")
    assert fitted.scores(table).count() == 300


def test_wrong_arguments(table):
    with pytest.raises(ValueError, match="unknown metric"):
        U.tune_forest(table, ["u", "v"], [{"n_trees": 2}], metric="accuracy")
    with pytest.raises(ValueError, match="unknown options"):
        U.tune_forest(table, ["u", "v"], [{"trees": 2}])
    with pytest.raises(ValueError, match="two folds"):
        U.tune_forest(table, ["u", "v"], [{"n_trees": 2}], folds=1)
