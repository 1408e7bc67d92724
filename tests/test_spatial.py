"""Density clustering against a sequential scan over all pairs."""

import math

import numpy as np
import pytest

from ampledger.operators import spatial as G

R = 6_371_000.0


def pairwise(points, metric):
    y, x = points[:, 0], points[:, 1]
    dy, dx = np.abs(y[:, None] - y), np.abs(x[:, None] - x)
    if metric == "haversine":
        a = np.sin(np.radians(dy) / 2) ** 2
        b = np.cos(np.radians(y))[:, None] * np.cos(np.radians(y)) * np.sin(np.radians(dx) / 2) ** 2
        return 2 * R * np.arcsin(np.minimum(1, np.sqrt(a + b)))
    return {"euclidean": np.hypot(dy, dx), "manhattan": dy + dx, "chebyshev": np.maximum(dy, dx)}[metric]


def scan(points, eps, min_samples, metric):
    near = pairwise(points, metric) <= eps
    core = near.sum(axis=1) >= min_samples
    labels = np.full(len(points), -1)
    number = 0
    for i in range(len(points)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], queue = number, [i]
        while queue:
            p = queue.pop(0)
            if core[p]:
                for q in np.flatnonzero(near[p]):
                    if labels[q] < 0:
                        labels[q] = number
                        queue.append(q)
        number += 1
    return labels, core


def layout(kind, metric):
    rng = np.random.default_rng(len(kind) + len(metric))
    unit = 1 / 111_195 if metric == "haversine" else 1.0
    if kind == "random":
        points = rng.uniform(0, 800, (400, 2))
    elif kind == "copies":  # a third of all points share one position
        points = np.vstack([np.full((150, 2), 300.0), np.round(rng.uniform(0, 600, (300, 2)) / 40) * 40])
    elif kind == "blocks":  # crowded blocks, some just within reach of each other, some not
        centres = [(0, 0), (0, 88), (0, 200), (300, 0), (300, 62), (500, 500)]
        points = np.vstack([rng.normal(c, 12, (70, 2)) for c in centres])
    elif kind == "line":  # a long chain needs several rounds to be joined
        order = rng.permutation(160)
        points = np.column_stack([order * 45.0, np.zeros(160)])
    else:
        points = rng.uniform(0, 800, (1, 2))
    lat0, lon0 = (14.5, 121.0) if metric == "haversine" else (-300.0, -300.0)
    return np.column_stack([lat0 + points[:, 0] * unit, lon0 + points[:, 1] * unit])


@pytest.mark.parametrize(
    "kind,metric",
    [(k, "haversine") for k in ("random", "copies", "blocks", "line", "single")]
    + [("random", "euclidean"), ("random", "manhattan"), ("blocks", "chebyshev")],
)
def test_equals_sequential_scan(spark, kind, metric):
    points = layout(kind, metric)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "meter_id long, lat double, lon double").repartition(5)
    got = {r.meter_id: (r.cluster, r.is_core) for r in G.dbscan(df, 50.0, 5, metric=metric).collect()}
    labels, core = scan(points, 50.0, 5, metric)
    assert [got[i] for i in range(len(points))] == list(zip(labels.tolist(), core.tolist()))


def test_split_cells_and_staged_joins(spark, staged, monkeypatch):
    monkeypatch.setattr(G, "CELL_SPLIT", 3)
    points = layout("blocks", "haversine")
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "meter_id long, lat double, lon double")
    labels, _ = scan(points, 50.0, 40, "haversine")
    got = {r.meter_id: r.cluster for r in G.dbscan(df, 50.0, 40).collect()}
    assert [got[i] for i in range(len(points))] == labels.tolist()


def test_far_north_and_missing_positions(spark):
    rows = [(i, 69.6 + (i % 7) * 1e-4, 18.9 + (i // 7) * 3e-4) for i in range(49)] + [(99, None, 18.9)]
    df = spark.createDataFrame(rows, "meter_id long, lat double, lon double")
    points = np.array([r[1:] for r in rows[:-1]], float)
    labels, _ = scan(points, 14.0, 4, "haversine")
    got = {r.meter_id: r.cluster for r in G.dbscan(df, 14.0, 4).collect()}
    assert [got[i] for i in range(49)] == labels.tolist() and got[99] == -1


def test_known_groups(spark):
    def group(start, n, lat):
        return [(start + i, lat + (i % 4) * 5e-5, 121.0 + (i // 4) * 5e-5) for i in range(n)]

    rows = group(0, 15, 14.50) + group(15, 8, 14.52) + group(23, 4, 14.54) + [(27, 14.7, 121.0), (28, 14.8, 121.0)]
    df = spark.createDataFrame(rows, "meter_id long, lat double, lon double")
    labelled = G.dbscan(df)
    stats = G.cluster_statistics(labelled).first()
    assert (stats.n_clusters, stats.n_noise, stats.n_small_clusters, stats.n_small_members) == (2, 6, 1, 8)
    new = spark.createDataFrame([(1, 14.5, 121.0), (2, 14.52, 121.0), (3, 10.0, 121.0), (4, None, None)], df.schema)
    table = G.cluster_table(labelled)
    found = {r.meter_id: (r.cluster, r.spatial_anomaly) for r in G.assign_clusters(new, table, 50.0).collect()}
    assert found == {1: (0, 0), 2: (1, 1), 3: (-1, 1), 4: (-1, 0)}
    marked = G.assign_clusters(new, table, 50.0, missing="mark_anomaly").where("meter_id = 4").first()
    assert marked.spatial_anomaly == 1
    with pytest.raises(ValueError):
        G.assign_clusters(new, table, 50.0, missing="error")


def test_bad_radius():
    with pytest.raises(ValueError):
        G.Grid(0.0)
    assert math.isclose(G.Grid(10.0, "manhattan").side, 4.995)
