"""Separation of labels against all pairs of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.operators import separation as S


@pytest.mark.parametrize("d, order", [(1, 8), (2, 8), (3, 6), (5, 4), (8, 2)])
def test_series_keeps_its_bound_and_moments_move(d, order):
    rng = np.random.default_rng(d)
    v, w = rng.normal(0, 1, (60, d)), rng.integers(1, 4, 60).astype(float)
    v *= rng.uniform(0, 0.3, 60)[:, None] / np.linalg.norm(v, axis=1)[:, None]
    u = rng.normal(0, 1, (20, d))
    far = np.linalg.norm(u, axis=1)
    u *= np.maximum(far, 1.0)[:, None] / far[:, None]
    far = np.linalg.norm(u, axis=1)
    exact = np.sqrt(((u[:, None] - v) ** 2).sum(axis=2)) @ w
    s = 0.3 / far
    bound = 2 / (2 * order + 1) * s ** (order + 1) / (1 - s) * far * w.sum() + 1e-9
    sums = S.moments(v, w, order)
    assert (np.abs(S.series(u, order) @ sums - exact) <= bound).all()
    middle = np.full(d, 0.25)
    about_middle = S.moments(v - middle, w, order)
    assert S.shifted(sums, -middle, order) == pytest.approx(about_middle, abs=1e-9)


def all_pairs(x, label):
    far = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    names = sorted(set(label))
    values = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, label == k].mean() for k in names if k != label[i])
        values.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(values))


def squared_and_davies(x, label):
    names = sorted(set(label))
    c = np.array([x[label == k].mean(axis=0) for k in names])
    q = np.array([((x[label == k] - m) ** 2).sum(axis=1).mean() for k, m in zip(names, c)])
    s = np.array([np.sqrt(((x[label == k] - m) ** 2).sum(axis=1)).mean() for k, m in zip(names, c)])
    n = np.array([(label == k).sum() for k in names])
    far = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2))
    worst = np.divide(s[:, None] + s, far, out=np.zeros_like(far), where=far > 0).max(axis=1)
    values = []
    for row, k in zip(x, np.searchsorted(names, label)):
        mean = ((row - c) ** 2).sum(axis=1) + q
        a, mean[k] = mean[k] * n[k] / max(n[k] - 1, 1), np.inf
        values.append((mean.min() - a) / max(mean.min(), a) if n[k] > 1 and max(mean.min(), a) > 0 else 0.0)
    return float(worst.mean()), float(np.mean(values))


def frame(spark, x, label):
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = [(int(k), *map(float, r)) for k, r in zip(label, x)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in columns)), columns


@pytest.mark.parametrize("n, k, d, spread", [(1500, 3, 2, 5.0), (900, 60, 2, 3.0), (900, 5, 3, 4.0)])
def test_against_all_pairs(spark, monkeypatch, n, k, d, spread):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "FAN", 4)
    rng = np.random.default_rng(n + k)
    label = rng.integers(0, k, n)
    label[:4] = (k, k + 1, k + 1, k + 1)  # one row alone, and equal rows
    x = rng.normal(0, spread, (k + 2, d))[label] + rng.normal(0, 0.3, (n, d))
    x[1:4] = 1.5
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-7)
    got = S.cluster_quality(df, "k", columns).first()
    worst, squared = squared_and_davies(x, label)
    assert got.davies_bouldin == pytest.approx(worst, rel=1e-9)
    assert got.silhouette_sq == pytest.approx(squared, abs=1e-9)


def test_far_nodes_are_not_opened(spark, monkeypatch):
    """Two distant labels: the blocks of one meet the other as a whole, not row by row."""
    monkeypatch.setattr(S, "BLOCK", 16)
    met = []
    walk = S.walk
    monkeypatch.setattr(S, "walk", lambda *a: met.append(walk(*a)) or met[-1])
    rng = np.random.default_rng(1)
    label = np.repeat([0, 1], 800)
    x = rng.normal(0, 1, (1600, 2)) + label[:, None] * 200.0
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-7)
    other = S._union(met[-1]).where(F.col("_l") != F.col("t"))
    assert other.count() == other.where("far").count() == 100


def test_labels_that_count_as_large(spark, staged, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(8)
    label = np.where(rng.random(400) < 0.4, 0, rng.integers(1, 50, 400))
    x = rng.normal(0, 3, (50, 2))[label] + rng.normal(0, 0.5, (400, 2))
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-7)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(None, 0.0), (None, 1.0), (2, 10.0), (2, 11.0), (2, None), (3, float("nan")), (2, float("inf"))], "k int, u double"
    )
    want = all_pairs(np.array([[0.0], [1.0], [10.0], [11.0]]), np.array([0, 0, 1, 1]))
    assert S.silhouette(df, "k", ["u"]).first()[0] == pytest.approx(want)
    assert S.silhouette(df.where("k = 2"), "k", ["u"]).first()[0] == -1.0
    assert S.silhouette(df.where("u < 0"), "k", ["u"]).first()[0] == -1.0
    same = spark.createDataFrame([(i % 2, 5.0) for i in range(6)], "k int, u double")
    assert S.silhouette(same, "k", ["u"]).first()[0] == 0.0


def met_by_groups(monkeypatch, group):
    """Small groups, and the rows of the last walk."""
    for name, value in {"BLOCK": 16, "FAN": 4, "GROUP": group, "HALF": 16}.items():
        monkeypatch.setattr(S, name, value, raising=False)
    met = []
    walk = S.walk
    monkeypatch.setattr(S, "walk", lambda *a: met.append(walk(*a)) or met[-1])
    return met


def test_nodes_are_met_by_groups_of_rows(spark, monkeypatch):
    """Two labels in one place: a group meets nodes once for all its rows, not block by block."""
    met = met_by_groups(monkeypatch, 256)
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 2000)
    x = rng.normal(0, 1, (2000, 2)) + label[:, None] * 0.1
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-8)
    assert S._union(met[-1]).count() <= 8 * 2 * 100


def test_the_series_travels_by_value():
    import subprocess
    import sys

    from pyspark import cloudpickle

    load = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
    for function in (S.series, S.moments, S.shifted):
        subprocess.run([sys.executable, "-I", "-c", load], input=cloudpickle.dumps(function), cwd="/", check=True)


def test_labels_in_one_place_are_summed_together(spark, monkeypatch):
    """Many labels over the same rows: neighbours of all labels meet in one group."""
    met = met_by_groups(monkeypatch, 512)
    monkeypatch.setattr(S, "COLUMNS", 7, raising=False)
    rng = np.random.default_rng(4)
    label = rng.integers(0, 30, 2000)
    x = rng.normal(0, 1, (2000, 2))
    x[::50] = x[0]
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-8)
    assert S._union(met[-1]).count() <= 4 * 30 * 6


def test_a_group_of_many_labels_is_shared(spark, monkeypatch):
    """Tasks share a group by its labels, so it is larger and blocks are sent to fewer groups."""
    met = met_by_groups(monkeypatch, 256)
    monkeypatch.setattr(S, "COLUMNS", 8)
    rng = np.random.default_rng(6)
    label = rng.integers(0, 30, 2000)
    x = rng.normal(0, 1, (2000, 2))
    label[:2], x[:40] = (30, 31), x[0]  # labels of one row, and equal rows of several labels
    df, columns = frame(spark, x, label)
    assert S.silhouette(df, "k", columns).first()[0] == pytest.approx(all_pairs(x, label), abs=1e-8)
    near = S._union(met[-1]).where("not far")
    assert near.select("ti").distinct().count() == 2
    assert near.count() <= 2 * 32 * 6


def test_a_short_table_is_dealt_into_blocks_once(spark, monkeypatch):
    """The number of rows is known, so rows are numbered without a stored copy of them."""
    from ampledger.session import row_bound

    bounds = {}
    numbered = S.running_total
    monkeypatch.setattr(S, "running_total", lambda df, order, **k: bounds.update({tuple(order): row_bound(df)}) or numbered(df, order, **k))
    df, columns = frame(spark, np.random.default_rng(2).normal(0, 1, (300, 2)), np.arange(300) % 3)
    S.Labelled(df, "k", columns, 2)
    assert bounds[("_m", "x", "id")] == 300
