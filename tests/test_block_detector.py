"""Detectors that learn block by block with plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.operators import detectors as M
from ampledger.plans.detection import add_moments, inverse_covariance, join_moments, mahalanobis, no_moments


def detector():
    return M.BlockDetector(no_moments, add_moments, join_moments, mahalanobis, inverse_covariance)


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_equals_the_built_in_distance(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(1e4, 3, (500, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(partitions, "id")
    want = {r.id: r.raw_score for r in M.MahalanobisDetector().fit(df, ["a", "b"]).score(df).collect()}
    got = {r.id: r.raw_score for r in detector().fit(df, ["a", "b"]).score(df).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_states_are_merged_in_levels_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(M, "MERGE_FAN", 3)
    df = spark.range(0, 40, 1, 20).select(F.col("id").cast("double").alias("v"))
    collect = M.BlockDetector(list, lambda s, x: s + x[:, 0].tolist(), lambda a, b: a + b, lambda s, x: x[:, 0])
    assert collect.fit(df, ["v"]).state == list(map(float, range(40)))


def test_quantiles_by_a_mergeable_histogram(spark):
    edges = np.linspace(0, 1, 101)
    count = M.BlockDetector(
        lambda: np.zeros(100, int),
        lambda s, x: s + np.histogram(x[:, 0], edges)[0],
        lambda a, b: a + b,
        lambda median, x: np.abs(x[:, 0] - median),
        lambda s: edges[np.searchsorted(s.cumsum(), s.sum() / 2) + 1],
    )
    df = spark.range(1000).select((F.col("id") / 1000).alias("v"))
    fitted = M.fit(count, df, ["v"])
    assert fitted.model.state == pytest.approx(0.5, abs=0.011)
    assert fitted.high == pytest.approx(0.5, abs=0.02)


def test_an_empty_table_gives_the_first_state(spark):
    kept = M.BlockDetector(lambda: 7, lambda s, x: s, lambda a, b: a, lambda s, x: x[:, 0])
    assert kept.fit(spark.createDataFrame([], "a double"), ["a"]).state == 7
