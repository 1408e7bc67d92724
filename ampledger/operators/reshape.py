"""Wide and long forms of the meter table, encodings, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.functions.columns import any_of, finite
from ampledger.operators.grouped import attach, running_total

MONTH_PREFIX = "monthly_consumption_"
#: Columns that never enter a feature matrix.
NOT_FEATURES = {
    "meter_id",
    "transformer_id",
    "anomaly_flag",
    "barangay",
    "barangay_id",
    "customer_class",
}


def month_columns(df: DataFrame, prefix: str = MONTH_PREFIX) -> list[str]:
    """Month columns in time order, found by prefix; an error if there are none."""
    found = sorted(c for c in df.columns if c.startswith(prefix))
    if not found:
        raise ValueError(f"no column starts with {prefix!r}")
    return found


def to_long(wide: DataFrame, ids: list[str], prefix: str = MONTH_PREFIX) -> DataFrame:
    """One row per meter and month: ``ids, month, kwh``; missing months stay as NULL."""
    months = month_columns(wide, prefix)
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in months]).unpivot(
        ids, months, "_name", "kwh"
    ).select(
        *ids,
        F.to_date(F.substring("_name", len(prefix) + 1, 6), "yyyyMM").alias("month"),
        "kwh",
    )


#: Month columns that are built without being asked for by name.
MAX_MONTHS = 600


def to_wide(
    long: DataFrame, ids: list[str], months: list[str] | None = None, prefix: str = MONTH_PREFIX
) -> DataFrame:
    """One column per month. ``months`` (``yyyyMM``) are read from the calendar span
    of the data when not given: a two-value aggregate, not the rows. A span of more than
    ``MAX_MONTHS`` months is an error: give the months if a stray date made it. Readings of
    the same meter and month are summed."""
    if months is None:
        span = long.agg(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month")))
        months = [d.strftime("%Y%m") for d in (span.first()[0] or [])]
        if len(months) > MAX_MONTHS:
            raise ValueError(f"the readings span {len(months)} months; give the wanted ones")
    name = F.date_format("month", "yyyyMM")
    pivoted = long.withColumn("_m", name).groupBy(*ids).pivot("_m", months).agg(F.sum("kwh"))
    return pivoted.select(*ids, *[F.col(m).alias(prefix + m) for m in months])


def monthly_series(wide: DataFrame, prefix: str = MONTH_PREFIX) -> DataFrame:
    """Month columns folded into ``monthly_consumptions``, without missing months."""
    months = month_columns(wide, prefix)
    rest = [c for c in wide.columns if c not in months]
    values = F.filter(F.array(*months), lambda x: x.isNotNull())
    return wide.select(*rest, values.alias("monthly_consumptions"))


#: Chart axis labels.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
POWER_FACTOR = 0.9


def chart_points(meters: DataFrame, values: str = "monthly_consumptions") -> DataFrame:
    """One row per point of a meter's chart; labels run through the year from January."""
    labels = F.array(*[F.lit(m) for m in MONTH_LABELS])
    rest = [c for c in meters.columns if c != values]
    return meters.select(*rest, F.posexplode(values).alias("position", "kwh")).select(
        *rest,
        "position",
        F.element_at(labels, (F.col("position") % 12 + 1).cast("int")).alias("month_label"),
        "kwh",
        (F.col("kwh") / POWER_FACTOR).alias("kva"),
    )


#: Columns that discovered categories may become.
MAX_CATEGORIES = 1000


def one_hot(df: DataFrame, column: str, categories: list[str] | None = None, others: str = "error") -> DataFrame:
    """``column_<category>`` 0/1 columns; a NULL has 0 everywhere.

    Without a list the categories are the values of the table, in order; more than
    ``MAX_CATEGORIES`` are an error before anything is built. A value that a given list
    lacks fails the job, or has 0 everywhere with ``others="ignore"``.
    """
    if others not in ("error", "ignore"):
        raise ValueError(f"others are an error or ignored, not {others!r}")
    c = F.col(column)
    if categories is None:
        found = df.where(c.isNotNull()).select(column).distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{column} has more than {MAX_CATEGORIES} values")
        categories = sorted(r[0] for r in found)
    elif others == "error":
        message = F.concat(F.lit(f"undeclared value of {column}: "), c.cast("string"))
        c = F.when(c.isNull() | c.isin(*categories), c).otherwise(F.raise_error(message))
    flags = [F.coalesce((c == k).cast("int"), F.lit(0)).alias(f"{column}_{k}") for k in categories]
    return df.select("*", *flags).drop(column)


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Code = position of the value in sorted order, from 0; NULL stays NULL."""
    output = output or f"{column}_encoded"
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = running_total(distinct, [column], name=output).withColumn(
        output, (F.col(output) - 1).cast("int")
    )
    return attach(df, codes, [column])


def feature_columns(df: DataFrame, exclude: set[str] | None = None) -> list[str]:
    """Numeric columns that are not ids, labels or categories."""
    skip = NOT_FEATURES | (exclude or set())
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def check_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, cells that are missing (warning) and cells that are infinite (error)."""
    absent = [c for c in columns if c not in df.columns]
    if absent or not columns:
        raise ValueError(f"missing feature columns: {absent}")
    doubles = [F.col(c).cast("double") for c in columns]
    null_cells = sum((F.coalesce((d.isNull() | F.isnan(d)).cast("int"), F.lit(1)) for d in doubles), F.lit(0))
    inf_cells = sum((F.coalesce((F.abs(d) == float("inf")).cast("int"), F.lit(0)) for d in doubles), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(null_cells), F.lit(0)).alias("null_cells"),
        F.coalesce(F.sum(inf_cells), F.lit(0)).alias("inf_cells"),
    ).select(
        "*",
        ((F.col("n_rows") > 0) & (F.col("inf_cells") == 0)).alias("usable"),
        (F.col("null_cells") > 0).alias("has_missing"),
    )


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing or infinite feature."""
    return df.where(~any_of([finite(F.col(c).cast("double")).isNull() for c in columns]))


def filter_meters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; ``None`` or ``'all'`` does not filter."""
    for column, value in wanted.items():
        if value is not None and value != "all":
            df = df.where(F.col(column) == value)
    return df


def filter_options(df: DataFrame, column: str, city: str | None = None) -> DataFrame:
    """Distinct sorted non-blank values of a column, optionally within one city."""
    if city is not None:
        df = df.where(F.lower("city_id") == city.lower())
    options = df.select(F.col(column).cast("string").alias("option"))
    return options.where(F.trim("option") != "").distinct().orderBy("option")
