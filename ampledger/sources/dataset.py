"""A data set in one folder: meters, transformers and labels as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.operators import quality as Q
from ampledger.operators.impute import impute
from ampledger.operators.reshape import to_long
from ampledger.sources.readers import dataset_metadata, label_meters, read_labels, read_meters, read_transformers

METERS, TRANSFORMERS, LABELS = "meter_consumption.csv", "transformers.csv", "anomaly_labels.csv"


def load_dataset(spark: SparkSession, folder: str, impute_strategy: str = "zero") -> dict[str, DataFrame]:
    """``meters`` with flags, ``transformers``, ``labels``, filled long ``readings`` and one
    row of ``metadata``. The labels may be absent."""
    labels = read_labels(spark, f"{folder}/{LABELS}")
    meters = label_meters(read_meters(spark, f"{folder}/{METERS}"), labels)
    long = to_long(meters, ["meter_id", "transformer_id"])
    return {
        "meters": meters,
        "transformers": read_transformers(spark, f"{folder}/{TRANSFORMERS}"),
        "labels": labels,
        "readings": impute(long, impute_strategy, group="transformer_id"),
        "metadata": dataset_metadata(meters),
    }


def validate_dataset(
    spark: SparkSession,
    folder: str,
    constraints: dict | None = None,
    classes: Sequence[str] = tuple(Q.CUSTOMER_CLASSES),
) -> DataFrame:
    """Issues of all three tables and of the references between them, with ``table``.

    Critical: types, required columns, allowed values, ranges, duplicate keys, references.
    Warnings: months that one reading dominates, meters whose readings never change, and a
    table of meters of which more than a tenth is empty.
    """
    meters = read_meters(spark, f"{folder}/{METERS}")
    stations = read_transformers(spark, f"{folder}/{TRANSFORMERS}")
    labels = read_labels(spark, f"{folder}/{LABELS}")
    limits = Q.DEFAULT_CONSTRAINTS | (constraints or {})
    long = to_long(meters, ["meter_id"])
    found = [
        ("meters", Q.validate(meters, Q.meter_rules(constraints, classes), "meter_id", Q.REQUIRED_METER)),
        ("meters", Q.check(long, [Q.in_range("kwh", *limits["consumption"])], "meter_id")),
        ("meters", Q.schema_issues(meters, [], ["lat", "lon", "kVA"], ["transformer_id", "customer_class"])),
        ("meters", Q.issue(Q.duplicate_keys(meters, "meter_id"), "duplicate_key", Q.CRITICAL, "meter_id")),
        ("meters", Q.issue(Q.dominant_values(long).agg(F.count("*").alias("n_bad")), "dominant_value", Q.WARNING, "kwh")),
        ("meters", Q.check(Q.zero_variance(long), [Q.Rule("zero_variance", F.lit(True), "kwh", Q.WARNING)], "meter_id")),
        (
            "meters",
            Q.issue(Q.completeness(meters).where("too_many_nulls"), "completeness", Q.WARNING, "*", n_bad="null_cells"),
        ),
        ("transformers", Q.validate(stations, Q.transformer_rules(constraints), "transformer_id", ["feeder_id"])),
        (
            "transformers",
            Q.issue(Q.duplicate_keys(stations, "transformer_id"), "duplicate_key", Q.CRITICAL, "transformer_id"),
        ),
        ("labels", Q.validate(labels, Q.label_rules(), "meter_id")),
    ]
    for table, child, parent, key in (
        ("labels", labels, meters, "meter_id"),
        ("meters", meters, stations, "transformer_id"),
    ):
        lost = Q.orphans(child, parent, key).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_bad"))
        found.append((table, Q.issue(lost, "orphan", Q.CRITICAL, key)))
    parts = [issues.select(F.lit(table).alias("table"), "*") for table, issues in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
