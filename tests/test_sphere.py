"""Clusters across the antimeridian and over the poles, and rules that fail while running."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.operators import quality as Q
from ampledger.operators import spatial as G


def metres(a, b):
    la, lb = np.radians(a), np.radians(b)
    h = np.sin((la[:, None, 0] - lb[:, 0]) / 2) ** 2
    h = h + np.cos(la[:, None, 0]) * np.cos(lb[:, 0]) * np.sin((la[:, None, 1] - lb[:, 1]) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def scan(points, eps, least):
    """Labels of a sequential scan in key order."""
    near = metres(points, points) <= eps
    core = near.sum(axis=1) >= least
    label, n = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = n
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                label[j] = n
                stack.append(j)
        n += 1
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min(initial=n) if len(reached) else -1
    return label


@pytest.mark.parametrize("place", ["meridian", "north", "south", "both sides"])
def test_clusters_anywhere(spark, place):
    rng = np.random.default_rng(len(place))
    if place in ("meridian", "both sides"):
        lon = 180 + rng.normal(0, 0.02, 150)
        points = np.column_stack([rng.normal(60, 0.01, 150), np.where(lon > 180, lon - 360, lon)])
        if place == "both sides":
            points[:20, 1] = rng.choice([180.0, -180.0], 20)
    else:
        points = np.column_stack([90 - np.abs(rng.normal(0, 0.01, 150)), rng.uniform(-180, 180, 150)])
        points[0] = (90.0, 33.0)
        points[:, 0] *= 1 if place == "north" else -1
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "meter_id long, lat double, lon double")
    for eps, least in ((150.0, 4), (400.0, 3), (60.0, 2)):
        got = G.dbscan(df, eps, least).orderBy("meter_id").collect()
        assert [r.cluster for r in got] == scan(points, eps, least).tolist()


def test_two_sides_of_the_antimeridian(spark):
    rows = [(i, 0.0, 179.9999 if i % 2 else -179.9999) for i in range(10)]
    df = spark.createDataFrame(rows, "meter_id long, lat double, lon double")
    assert {r.cluster for r in G.dbscan(df, 100.0, 3).collect()} == {0}


def test_failing_rules_stand_alone(spark):
    df = spark.range(40).withColumn("text", F.when(F.col("id") == 7, "x").otherwise(F.col("id").cast("string")))
    good = [Q.in_range("id", 0, 30 + i) for i in range(5)]
    bad = [
        Q.Rule("cast", F.expr("CAST(text AS INT) > 5") if ansi(spark) else F.raise_error("x").cast("boolean"), "text"),
        Q.Rule("raised", F.when(F.col("id") == 3, F.raise_error("no").cast("boolean")), "id"),
    ]
    rules = [good[0], bad[0], *good[1:4], bad[1], good[4]]
    got = {(r.rule, r.field, r.n_bad, tuple(r["sample"])) for r in Q.evaluated(df, rules, "id").collect()}
    plain = {(r.rule, r.field, r.n_bad, tuple(r["sample"])) for r in Q.check(df, good, "id").collect()}
    assert plain < got and {g[0] for g in got - plain} == {"cast", "raised"}
    assert all(g[2] == 1 and g[3] for g in got - plain)
    with pytest.raises(Q.ValidationError):
        Q.validate(df, rules, "id", strict=True).collect()
    assert Q.evaluated(df, [], "id").count() == 0


def ansi(spark):
    return spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_a_table_that_can_not_be_read_fails(spark):
    from pyspark.errors import PySparkException

    broken = spark.range(5).where(F.when(F.col("id") == 2, F.raise_error("lost").cast("boolean")).otherwise(F.lit(True)))
    with pytest.raises(PySparkException):
        Q.evaluated(broken, [Q.in_range("id", 0, 3)], "id")
