"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from ampledger.operators import quality as Q
from ampledger.operators.features import meter_statistics, meter_trend, transformer_baseline
from ampledger.operators.risk import top_suspicious
from ampledger.operators.scaling import normalise, scale_params
from ampledger.plans import load_all
from ampledger.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.mark.parametrize(
    "name", ["i8_transformer_month_median_fill", "n2_robust", "f10_engineer_features", "c5_percentile", "r2_risk_level",
             "k3_top_with_ties", "g5_assign_clusters", "g8_resolve_city", "a1_transformer_rollup", "flagship_low_consumers"]
)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(REGISTRY[name].build(spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas", text)


def test_scans_are_pruned_and_filtered(spark, tables):
    text = meter_trend(tables.dense())._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp" in text
    labels = plan(tables.label_table())
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThan(c_acctbal,0.0)]" in labels


def test_normalising_does_not_shuffle_the_readings(spark, tables):
    long = tables.dense(keep=True)
    text = plan(normalise(long, scale_params(long)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning(transformer_id") == 1  # of the statistics


def test_group_statistics_combine_before_the_shuffle(spark, tables):
    for df in (meter_statistics(tables.gaps()), transformer_baseline(tables.dense(), "mean")):
        assert "partial_avg" in plan(df)


def test_offending_ids_are_cut_before_the_shuffle(spark, tables):
    rules = [Q.in_range("kwh", 0.0, 1.0), Q.not_null("kwh")]
    text = plan(Q.offending_ids(tables.dense(), rules, "meter_id"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_n_keeps_n_rows_per_task(spark, tables):
    scored = tables.sparse_meters().withColumn("composite_score", F.col("raw_score"))
    assert "TakeOrderedAndProject(limit=5" in plan(top_suspicious(scored, 5))


def test_missing_checkpoint_folder_is_an_error_on_a_cluster():
    from ampledger.session import checkpoint_root

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpoint_root(Session())
