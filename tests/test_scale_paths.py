"""The paths for large tables, forced onto small ones, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.operators.features import transformer_baseline, transformer_spread
from ampledger.operators.grouped import attach, group_quantiles, running_total
from ampledger.operators.impute import impute
from ampledger.operators.scaling import normalise, scale_params
from ampledger.operators.scoring import normalise_scores

PROBS = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}


def frame(spark, groups, values):
    rows = [(int(g), float(v)) for g, v in zip(groups, values)]
    return spark.createDataFrame(rows, "g int, v double").repartition(7)


def samples(kind, n, rng):
    return {
        "uniform": rng.uniform(0, 100, n),
        "heavy": np.exp(rng.normal(0, 4, n)),
        "ties": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 7.0),
        "outlier": np.append(rng.normal(0, 1, n - 1), 1e12),
    }[kind]


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "constant", "outlier"])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_sketch_narrowed_quantiles_are_exact(spark, staged, kind, accuracy):
    rng = np.random.default_rng(len(kind))
    # group 0 owns a third of all rows, and is longer than the sketch resolution of 50
    groups = np.concatenate([np.zeros(1500), rng.integers(1, 30, 3000)])
    values = samples(kind, len(groups), rng)
    got = {r.g: r for r in group_quantiles(frame(spark, groups, values), ["g"], "v", PROBS, accuracy).collect()}
    assert set(got) == set(groups.astype(int))
    for g in got:
        for name, p in PROBS.items():
            want = np.percentile(values[groups == g], 100 * p)
            assert got[g][name] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_global_quantiles_are_exact(spark, staged):
    values = np.random.default_rng(1).normal(0, 1, 4000)
    row = group_quantiles(frame(spark, np.zeros(4000), values), [], "v", PROBS, 100).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(values, 100 * p))


def test_both_quantile_paths_agree_on_nulls(spark, staged, monkeypatch):
    from ampledger.session import stored

    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (3, 5.0), (3, 7.0)], "g int, v double")
    long_way = sorted(map(tuple, group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()))
    monkeypatch.setattr(staged, "EXACT_ROWS", 1000)
    short = sorted(map(tuple, group_quantiles(stored(df), ["g"], "v", {"m": 0.5}).collect()))
    assert long_way == short == [(1, 2.0), (3, 6.0)]


def test_salted_attach_keeps_every_row(spark, staged):
    g = F.when(F.col("id") < 1700, 0).when(F.col("id") < 2500, None).otherwise(F.col("id") % 500)
    rows = spark.range(5000).select(g.alias("g"), "id")
    stats = rows.where("g is not null and g != 7").groupBy("g").agg(F.count("*").alias("n"))
    joined = attach(rows, stats, ["g"])
    assert "_salt" in joined._jdf.queryExecution().toString()
    got = {r.id: (r.g, r.n) for r in joined.collect()}
    size = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    assert len(got) == 5000
    for key, n in got.values():
        assert n == (None if key is None or key == 7 else size[key])
    assert attach(rows, stats, ["g"], "inner").count() == 5000 - 800 - size[7]


def test_running_total_over_ranges(spark, staged):
    rng = np.random.default_rng(3)
    values = rng.permutation(3000)
    df = spark.createDataFrame([(int(v % 3 == 0), int(v), int(v % 5)) for v in values], "k int, v int, w int")
    got = running_total(df.repartition(9), ["v"], F.col("w"), ["k"], "s").collect()
    for k in (0, 1):
        mine = sorted((r.v, r.w, r.s) for r in got if r.k == k)
        assert [m[2] for m in mine] == list(np.cumsum([m[1] for m in mine]))


def test_staged_operators_equal_direct_ones(spark, staged, monkeypatch):
    from ampledger.session import stored

    rng = np.random.default_rng(5)
    rows = [
        (m, int(m > 20) * int(m % 4), f"2024-{k:02d}-01", None if rng.random() < 0.1 else float(rng.integers(0, 60)))
        for m in range(60)
        for k in range(1, 13)
    ]
    long = spark.createDataFrame(rows, "meter_id int, transformer_id int, month string, kwh double")
    long = long.withColumn("month", F.to_date("month"))

    def everything(df):
        parts = [
            transformer_baseline(df),
            transformer_baseline(df, "trimmed_mean"),
            transformer_spread(df, "mad"),
            transformer_spread(df, "iqr"),
            impute(df, "median"),
            impute(df, "mean"),
            impute(df, "transformer_median", group="transformer_id"),
            normalise(df, scale_params(df, "robust"), "robust"),
            normalise_scores(impute(df, "zero"), "kwh_filled", "percentile"),
        ]
        return [sorted(str(tuple(sorted(r.asDict().items()))) for r in p.collect()) for p in parts]

    slow = everything(long)
    monkeypatch.setattr(staged, "EXACT_ROWS", 10_000)
    monkeypatch.setattr(staged, "BROADCAST_ROWS", 10_000)
    assert everything(stored(long)) == slow
