"""Validation: rules over columns, gathered in one aggregate pass per table.

A rule counts the rows that break it and keeps a few of their ids. All rules of one
table share a single aggregate, so a table is read once however many rules apply.
Every check returns rows of ``rule, severity, field, n_bad, sample``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.functions.columns import total
from ampledger.operators.grouped import with_scalars
from ampledger.session import stored

CRITICAL, WARNING = "critical", "warning"
SAMPLE = 5
ISSUES = "rule string, severity string, field string, n_bad bigint, sample array<string>"

# Allowed values and default constraints.
CUSTOMER_CLASSES = ["residential", "commercial", "industrial"]
RISK_BANDS = ["Low", "Medium", "High"]
DEFAULT_CONSTRAINTS = {
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
    "kVA": (0.0, 10_000.0),
    "capacity_kVA": (25.0, 1_000.0),
    "consumption": (0.0, 10_000.0),
    "max_null_ratio": 0.1,
}
REQUIRED_METER = ["meter_id", "transformer_id", "customer_class", "barangay", "lat", "lon", "kVA"]


@dataclass(frozen=True)
class Rule:
    """A named condition that bad rows satisfy; user rules are built the same way."""

    name: str
    bad: Column
    field: str = ""
    severity: str = CRITICAL


def in_set(column: str, allowed: Sequence, severity: str = CRITICAL) -> Rule:
    """NULL is not in any set."""
    c = F.col(column)
    return Rule("allowed_values", c.isNull() | ~c.isin(*allowed), column, severity)


def in_range(column: str, low: float, high: float, severity: str = CRITICAL) -> Rule:
    """NULL passes."""
    return Rule("range", F.coalesce(~F.col(column).between(low, high), F.lit(False)), column, severity)


def not_null(column: str, severity: str = CRITICAL) -> Rule:
    return Rule("not_null", F.col(column).isNull(), column, severity)


def gps_rules(lat: str = "lat", lon: str = "lon", allow_missing: bool = False) -> list[Rule]:
    """Both coordinates in range; missing ones are errors unless allowed."""
    rules = [in_range(lat, -90.0, 90.0), in_range(lon, -180.0, 180.0)]
    return rules if allow_missing else rules + [not_null(lat), not_null(lon)]


def check(df: DataFrame, rules: Sequence[Rule], row_id: str) -> DataFrame:
    """Evaluate all rules; one row per broken rule."""
    counts = df.agg(
        *[F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"n{i}") for i, r in enumerate(rules)]
    )
    verdicts = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.field).alias("field"),
                F.col(f"n{i}").alias("n_bad"),
            )
            for i, r in enumerate(rules)
        ]
    )
    found = counts.select(F.explode(verdicts).alias("r")).select("r.*").where("n_bad > 0")
    joined = found.join(offending_ids(df, rules, row_id), "i", "left")
    return joined.select("rule", "severity", "field", "n_bad", "sample")


def offending_ids(df: DataFrame, rules: Sequence[Rule], row_id: str) -> DataFrame:
    """The smallest few ids that break each rule. The rank filter is a group limit, so
    each task passes on no more than ``SAMPLE`` rows per rule."""
    hits = F.array(*[F.when(F.coalesce(r.bad, F.lit(False)), F.lit(i)) for i, r in enumerate(rules)])
    broken = df.select(F.col(row_id).alias("id"), F.explode(F.array_compact(hits)).alias("i"))
    ranked = broken.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("id")))
    return (
        ranked.where(F.col("rn") <= SAMPLE)
        .groupBy("i")
        .agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("sample"))
    )


def issue(counted: DataFrame, rule: str, severity: str, field: str, n_bad: str = "n_bad") -> DataFrame:
    """Shape a computed count as an issue row; a count of 0 gives none."""
    sample = F.col("sample") if "sample" in counted.columns else F.array().cast("array<string>")
    return counted.select(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(field).alias("field"),
        F.col(n_bad).cast("bigint").alias("n_bad"),
        sample.alias("sample"),
    ).where("n_bad > 0")


# ---- schema checks --------------------------------------------------------------


def schema_issues(df: DataFrame, required: Sequence[str], doubles: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Missing columns and unsuitable types. The schema decides; a finding concerns every
    row of the table, so the rows are counted only if there is one.

    A column that must be a number and is not is critical; one that should be text and
    is not is a warning.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = [("required_column", CRITICAL, c, []) for c in required if c not in types]
    for severity, columns, wanted in ((CRITICAL, doubles, T.NumericType), (WARNING, texts, T.StringType)):
        found += [
            ("column_type", severity, c, [types[c].simpleString()])
            for c in columns
            if c in types and not isinstance(types[c], wanted)
        ]
    n = df.count() if found else 0
    return df.sparkSession.createDataFrame([(*f[:3], n, f[3]) for f in found], ISSUES)


# ---- table checks ---------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: rows that share their key (all copies), extra copies, keys affected."""
    counts = df.groupBy(key).agg(F.count("*").alias("k")).where("k > 1")
    return counts.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra_copies"),
        F.count("*").alias("keys"),
    )


def dominant_values(long: DataFrame, month: str = "month", value: str = "kwh", min_values: int = 10, share: float = 0.5) -> DataFrame:
    """Months in which one reading makes up more than ``share`` of more than ``min_values``."""
    counts = long.where(F.col(value).isNotNull()).groupBy(month, value).agg(F.count("*").alias("k"))
    per_month = counts.groupBy(month).agg(F.sum("k").alias("n_values"), F.max("k").alias("n_top"))
    top_share = F.col("n_top") / F.col("n_values")
    return per_month.where((F.col("n_values") > min_values) & (top_share > share)).withColumn("top_share", top_share)


def zero_variance(long: DataFrame, meter: str = "meter_id", value: str = "kwh") -> DataFrame:
    """Meters whose readings never change."""
    flat = long.groupBy(meter).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n_months"))
    return flat.where("lo = hi").select(meter, "n_months")


def completeness(df: DataFrame, max_null_ratio: float = 0.1) -> DataFrame:
    """One row: cells, empty cells, their ratio, rows without any value, verdicts."""
    nulls = [F.col(c).isNull() for c in df.columns]
    empty_cells = total([n.cast("int") for n in nulls])
    stats = df.agg(
        (F.count("*") * len(nulls)).alias("total_cells"),
        F.coalesce(F.sum(empty_cells), F.lit(0)).alias("null_cells"),
        F.count_if(empty_cells == len(nulls)).alias("empty_rows"),
    )
    ratio = F.coalesce(F.try_divide(F.col("null_cells").cast("double"), F.col("total_cells")), F.lit(0.0))
    return stats.select(
        "*",
        ratio.alias("null_ratio"),
        (ratio > max_null_ratio).alias("too_many_nulls"),
        (F.col("empty_rows") > 0).alias("has_empty_rows"),
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` per key that ``parent`` does not have. The child is counted per
    key before the anti join, so a hot missing key is one row."""
    counted = child.groupBy(F.col(key).alias("orphan_id")).agg(F.count("*").alias("n_rows"))
    keys = parent.select(F.col(parent_key or key).alias("orphan_id"))
    return counted.join(keys, "orphan_id", "left_anti")


def parse_array(text: str) -> Column:
    """``"[1, 2]"``, ``"1,2"`` or ``"1 2"`` as array of doubles; NULL if any part is no number."""
    bare = F.expr(f"btrim(btrim({text}, ' \\t\\n\\r'), '[](){{}}')")
    parts = F.when(F.contains(bare, F.lit(",")), F.split(bare, ",")).otherwise(F.split(bare, r"\s+"))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    parsed = F.when(F.exists(numbers, lambda x: x.isNull()), F.lit(None)).otherwise(numbers)
    return F.when(F.col(text) != "", parsed)


def array_rules(values: str, length: int = 12, low: float = 0.0, high: float = 1e6) -> list[Rule]:
    """Format, length, value range of a parsed array column; the first failure counts."""
    v = F.col(values)
    parsed = v.isNotNull()
    right_length = parsed & (F.size(v) == length)
    outside = F.exists(v, lambda x: F.isnan(x) | ~x.between(low, high))
    return [
        Rule("array_format", ~parsed, values),
        Rule("array_length", parsed & (F.size(v) != length), values),
        Rule("array_values", right_length & outside, values),
    ]


def verdict(issues: DataFrame) -> DataFrame:
    """One row: valid iff there is no critical issue; counts by severity."""
    return issues.agg(
        (F.count_if(F.col("severity") == CRITICAL) == 0).alias("is_valid"),
        F.count_if(F.col("severity") == CRITICAL).alias("n_critical"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
    )


class ValidationError(ValueError):
    """Raised in strict mode when a table has critical issues."""


def evaluated(df: DataFrame, rules: Sequence[Rule], row_id: str) -> DataFrame:
    """Like :func:`check`, but a rule that fails on some row becomes a critical issue of its
    own, named by the error, and the other rules keep their results.

    All rules share one pass. Only if that pass fails are the rules halved and tried again
    until the guilty ones stand alone: about 2 log2(rules) passes for each. A table that can
    not be read at all fails as a whole.
    """
    failed: list[tuple] = []
    parts: list[DataFrame] = []

    def attempt(some: Sequence[Rule], whole: bool) -> None:
        try:
            parts.append(stored(check(df, some, row_id)))
        except (PySparkException, Py4JError) as error:
            if whole:
                df.agg(F.count("*")).collect()  # the table, not a rule
            if len(some) == 1:
                name = getattr(error, "getCondition", lambda: None)() or type(error).__name__
                failed.append((some[0].name, CRITICAL, some[0].field, 1, [name]))
            else:
                attempt(some[: len(some) // 2], False)
                attempt(some[len(some) // 2 :], False)

    if rules:
        attempt(rules, True)
    out = df.sparkSession.createDataFrame(failed, ISSUES)
    for part in parts:
        out = out.unionByName(part)
    return out


def validate(df: DataFrame, rules: Sequence[Rule], row_id: str, required: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Issues of schema and rows. A rule that can not be evaluated on this table, or fails on
    one of its rows, is itself a critical issue. Strict mode raises on critical issues."""
    found = schema_issues(df, required)
    usable, broken = [], []
    for rule in rules:
        try:
            df.select(rule.bad)
            usable.append(rule)
        except Exception as error:  # any user rule
            broken.append((rule.name, CRITICAL, rule.field, 1, [type(error).__name__]))
    if broken:
        found = found.unionByName(df.sparkSession.createDataFrame(broken, ISSUES))
    if usable:
        found = found.unionByName(evaluated(df, usable, row_id))
    if strict:
        first = found.where(F.col("severity") == CRITICAL).orderBy("rule", "field").first()
        if first is not None:
            raise ValidationError(f"{first.rule} on {first.field}: {first.n_bad}")
    return found


def meter_rules(constraints: dict | None = None, classes: Sequence[str] = tuple(CUSTOMER_CLASSES)) -> list[Rule]:
    """Default rules of the meters table; ``constraints`` override single ranges."""
    limits = DEFAULT_CONSTRAINTS | (constraints or {})
    return [
        not_null("meter_id"),
        not_null("transformer_id"),
        in_set("customer_class", classes),
        in_range("lat", *limits["lat"]),
        in_range("lon", *limits["lon"]),
        in_range("kVA", *limits["kVA"]),
    ]


def transformer_rules(constraints: dict | None = None) -> list[Rule]:
    limits = DEFAULT_CONSTRAINTS | (constraints or {})
    return [
        not_null("transformer_id"),
        in_range("lat", *limits["lat"]),
        in_range("lon", *limits["lon"]),
        in_range("capacity_kVA", *limits["capacity_kVA"]),
    ]


def label_rules() -> list[Rule]:
    return [in_set("anomaly_flag", [0, 1]), in_set("risk_band", RISK_BANDS)]


def quality_report(meters: DataFrame, transformers: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sizes, empty cells, extra id copies and anomaly rate of a data set."""

    def of(df: DataFrame, name: str, key: str) -> DataFrame:
        empty = total([F.col(c).isNull().cast("int") for c in df.columns])
        per_key = df.groupBy(key).agg(F.count("*").alias("k"), F.sum(empty).alias("e"))
        return per_key.agg(
            F.coalesce(F.sum("k"), F.lit(0)).alias(f"{name}_rows"),
            F.lit(len(df.columns)).alias(f"{name}_columns"),
            F.coalesce(F.sum("e"), F.lit(0)).alias(f"{name}_null_cells"),
            F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias(f"{name}_duplicate_ids"),
        )

    flagged = labels.agg(F.count_if(F.col("anomaly_flag") == 1).alias("anomalies"))
    report = with_scalars(of(meters, "meter", "meter_id"), of(transformers, "transformer", "transformer_id"), "_t")
    report = with_scalars(report, flagged, "_f").select("*", "_t.*", "_f.*").drop("_t", "_f")
    return report.select("*", (F.col("anomalies") / F.col("meter_rows")).alias("anomaly_rate"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share`` of one column."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("rows"))
    return with_scalars(counts, n).select("value", "n", (F.col("n") / F.col("_g.rows")).alias("share"))


def acceptance(
    meters: DataFrame,
    transformers: DataFrame,
    labels: DataFrame,
    expected: dict[str, float],
    tolerance: float = 0.02,
) -> DataFrame:
    """One row of checks on a finished data set: row counts, months, anomaly rate, no empty
    cell, every transformer known. ``expected``: meters, transformers, months, anomaly_rate."""
    empty = total([F.col(c).isNull().cast("int") for c in meters.columns])
    months = sum(c.startswith("monthly_consumption_") for c in meters.columns)
    stats = meters.agg(F.count("*").alias("n_meters"), F.coalesce(F.sum(empty), F.lit(0)).alias("null_cells"))
    stats = with_scalars(stats, transformers.agg(F.count("*").alias("n_transformers")), "_t")
    stats = with_scalars(stats, labels.agg(F.count("*").alias("n_labels")), "_l")
    unknown = orphans(meters, transformers, "transformer_id").agg(F.count("*").alias("n"))
    stats = with_scalars(stats, unknown, "_o")
    rate = F.col("_l.n_labels") / F.col("n_meters")
    return stats.select(
        (F.col("n_meters") == expected["meters"]).alias("meters_ok"),
        (F.col("_t.n_transformers") == expected["transformers"]).alias("transformers_ok"),
        F.lit(months == expected["months"]).alias("months_ok"),
        F.abs(rate - expected["anomaly_rate"]).between(0.0, tolerance).alias("anomaly_rate_ok"),
        (F.col("null_cells") == 0).alias("no_nulls"),
        (F.col("_o.n") == 0).alias("transformers_known"),
    )
