"""Nearest places against all pairs."""

import numpy as np
import pytest

from ampledger.operators import separation as S
from ampledger.operators.nearest import nearest_place


def metres(a, b):
    la, lb = np.radians(a), np.radians(b)
    h = np.sin((la[:, None, 0] - lb[:, 0]) / 2) ** 2
    h = h + np.cos(la[:, None, 0]) * np.cos(lb[:, 0]) * np.sin((la[:, None, 1] - lb[:, 1]) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def frame(spark, x, name):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], f"{name} long, lat double, lon double")


@pytest.mark.parametrize("spread", [0.05, 20.0, 180.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "LABEL_BLOCK", 4)
    monkeypatch.setattr(S, "FAN", 4)
    rng = np.random.default_rng(int(spread))

    def some(n):
        lon = 180 + rng.uniform(-spread, spread, n)
        return np.column_stack([np.clip(80 + rng.uniform(-spread, spread, n), -90, 90), np.where(lon > 180, lon - 360, lon)])

    points, places = some(300), some(120)
    places[5] = places[40]
    points[:3] = places[40]
    far = metres(points, places)
    got = nearest_place(frame(spark, points, "meter_id"), frame(spark, places, "place_id")).orderBy("meter_id").collect()
    assert [r.distance_m for r in got] == pytest.approx(far.min(axis=1).tolist(), abs=1e-6)
    # Places at a pole differ in longitude alone: which of them is named is a matter of rounding.
    assert far[np.arange(300), [r.nearest for r in got]] == pytest.approx(far.min(axis=1), abs=1e-6)
    clear = np.sort(far, axis=1)[:, 1] > far.min(axis=1) + 1e-6
    assert [r.nearest for r, c in zip(got, clear) if c] == far.argmin(axis=1)[clear].tolist() and clear.sum() > 100
    assert [r.nearest for r in got[:3]] == [5, 5, 5]


def test_missing_positions_and_empty_tables(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (1, 10.0, 10.0), (2, None, 3.0), (3, float("nan"), 3.0)], "meter_id long, lat double, lon double")
    places = spark.createDataFrame([(7, 10.0, 10.5), (8, None, 1.0)], "place_id long, lat double, lon double")
    got = sorted((r.meter_id, r.nearest) for r in nearest_place(points, places).collect())
    assert got == [(1, 7), (1, 7), (2, None), (3, None)]
    assert {r.nearest for r in nearest_place(points, places.where("place_id > 7")).collect()} == {None}
    assert nearest_place(points.where("meter_id > 5"), places).count() == 0
