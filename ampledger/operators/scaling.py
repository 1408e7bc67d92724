"""Outlier bounds and normalisation per transformer over all its meter-months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.functions.columns import clip
from ampledger.operators.grouped import attach, group_quantiles, with_scalars
from ampledger.operators.impute import impute
from ampledger.session import no_larger, stored

MIN_VALID_VALUES = 3


def _valid(long: DataFrame, group: str, value: str, include_zeros: bool) -> DataFrame:
    """Readings that count for their group; rows without a group belong to none."""
    v = F.col(value)
    return no_larger(long.where((v.isNotNull() if include_zeros else v > 0) & F.col(group).isNotNull()), long)


def outlier_bounds(
    long: DataFrame,
    method: str = "sigma",
    threshold: float = 3.0,
    central_share: float = 95.0,
    group: str = "transformer_id",
    value: str = "kwh",
    include_zeros: bool = False,
    with_median: bool = True,
) -> DataFrame:
    """``group, lower_bound, upper_bound, median, n_valid``; groups with fewer than
    three valid values have no bounds. Consumption cannot be negative, so the lower
    bound is at least 0. ``central_share`` is the percentage kept by ``percentile``.
    Sigma bounds without the median are a single aggregate.
    """
    valid = _valid(long, group, value, include_zeros)
    counts = valid.groupBy(group).agg(
        F.count("*").alias("n_valid"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")
    )
    probs = {"median": 0.5} if with_median else {}
    if method == "iqr":
        probs |= {"_q1": 0.25, "_q3": 0.75}
    elif method == "percentile":
        tail = (100.0 - central_share) / 200.0
        probs |= {"_q1": tail, "_q3": 1.0 - tail}
    elif method != "sigma":
        raise ValueError(f"unknown outlier method {method!r}")
    stats = counts.where(F.col("n_valid") >= MIN_VALID_VALUES)
    if probs:
        stats = stats.join(group_quantiles(valid, [group], value, probs), group)
    if method == "sigma":
        low, high = F.col("_m") - threshold * F.col("_s"), F.col("_m") + threshold * F.col("_s")
    elif method == "iqr":
        reach = threshold * (F.col("_q3") - F.col("_q1"))
        low, high = F.col("_q1") - reach, F.col("_q3") + reach
    else:
        low, high = F.col("_q1"), F.col("_q3")
    bounds = stats.select(
        group,
        F.greatest(F.lit(0.0), low).alias("lower_bound"),
        high.alias("upper_bound"),
        *(["median"] if with_median else []),
        "n_valid",
    )
    return no_larger(bounds, long)


def treat_outliers(
    long: DataFrame,
    bounds: DataFrame,
    cap: bool = True,
    group: str = "transformer_id",
    value: str = "kwh",
    output: str = "kwh_capped",
) -> DataFrame:
    """Add ``output``, ``is_outlier`` and ``has_bounds``. With ``cap=False`` values are only marked."""
    v, low, high = F.col(value), F.col("lower_bound"), F.col("upper_bound")
    limits = no_larger(bounds.select(group, "lower_bound", "upper_bound"), bounds)
    joined = attach(long, limits, [group])
    outside = F.coalesce((v < low) | (v > high), F.lit(False))
    capped = F.when(v < low, low).when(v > high, high).otherwise(v) if cap else v
    treated = joined.select(
        *long.columns,
        capped.alias(output),
        outside.alias("is_outlier"),
        high.isNotNull().alias("has_bounds"),
    )
    return no_larger(treated, long)


def outlier_summary(treated: DataFrame, value: str = "kwh") -> DataFrame:
    """One row: outliers, values inspected (of groups with bounds), ratio."""
    totals = treated.where("has_bounds").agg(
        F.count_if("is_outlier").alias("outliers_treated"), F.count(value).alias("total_values")
    )
    return totals.select(
        "*",
        F.coalesce(
            F.try_divide(F.col("outliers_treated").cast("double"), F.col("total_values")), F.lit(0.0)
        ).alias("outlier_ratio"),
    )


def scale_params(
    long: DataFrame, method: str = "minmax", group: str = "transformer_id", value: str = "kwh"
) -> DataFrame:
    """``group, centre, spread`` of each normalisation; a spread of 0 becomes 1."""
    if method == "minmax":
        stats = long.groupBy(group).agg(
            F.min(value).alias("centre"), (F.max(value) - F.min(value)).alias("spread")
        )
    elif method == "standard":
        stats = long.groupBy(group).agg(
            F.avg(value).alias("centre"), F.stddev_samp(value).alias("spread")
        )
    elif method == "robust":
        q = group_quantiles(long, [group], value, {"_q1": 0.25, "centre": 0.5, "_q3": 0.75})
        stats = q.select(group, "centre", (F.col("_q3") - F.col("_q1")).alias("spread"))
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0))
    return no_larger(stats.withColumn("spread", spread), long)


def normalise(
    long: DataFrame,
    params: DataFrame,
    method: str = "minmax",
    group: str = "transformer_id",
    value: str = "kwh",
    output: str = "kwh_norm",
) -> DataFrame:
    joined = attach(long, params, [group])
    scaled = (F.col(value) - F.col("centre")) / F.col("spread")
    if method == "minmax":
        scaled = clip(scaled, 0.0, 1.0)
    return no_larger(joined.select(*long.columns, scaled.alias(output)), long)


def denormalise(
    normalised: DataFrame,
    params: DataFrame,
    group: str = "transformer_id",
    value: str = "kwh_norm",
    output: str = "kwh_restored",
) -> DataFrame:
    """Inverse of :func:`normalise` from the stored parameters."""
    joined = attach(normalised, params, [group])
    restored = F.col(value) * F.col("spread") + F.col("centre")
    return no_larger(joined.select(*normalised.columns, restored.alias(output)), normalised)


def preprocess(
    long: DataFrame,
    impute_strategy: str = "forward_fill",
    outlier_method: str = "sigma",
    outlier_threshold: float = 3.0,
    normalisation: str = "minmax",
) -> DataFrame:
    """Impute, cap outliers, normalise: adds ``kwh_filled, kwh_capped, is_outlier, kwh_norm``.

    The filled table is written once, since bounds, ranges and the result all read it.
    """
    filled = stored(impute(long, impute_strategy, group="transformer_id"))
    bounds = outlier_bounds(
        filled, outlier_method, outlier_threshold, value="kwh_filled", with_median=False
    )
    capped = treat_outliers(filled, bounds, value="kwh_filled")
    params = scale_params(capped, normalisation, value="kwh_capped")
    return normalise(capped, params, normalisation, value="kwh_capped")


def preprocess_summary(processed: DataFrame, min_valid_months: int = 6) -> DataFrame:
    """One row: meters, cells, missing before and after, capped, meters with few readings."""
    per_meter = processed.groupBy("meter_id").agg(
        F.count("*").alias("cells"),
        F.count("kwh").alias("valid"),
        F.count("kwh_filled").alias("filled"),
        F.count_if("is_outlier").alias("outliers"),
        F.min("kwh_norm").alias("low"),
        F.max("kwh_norm").alias("high"),
    )
    return per_meter.agg(
        F.count("*").alias("n_meters"),
        F.sum("cells").alias("n_cells"),
        (F.sum("cells") - F.sum("valid")).alias("missing_before"),
        (F.sum("cells") - F.sum("filled")).alias("missing_after"),
        F.sum("outliers").alias("outliers_treated"),
        F.count_if(F.col("valid") < min_valid_months).alias("meters_below_min_months"),
        F.min("low").alias("norm_min"),
        F.max("high").alias("norm_max"),
    )


def standardise(df: DataFrame, columns: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population std over the whole table; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    )

    def z(c: str) -> Column:
        s = F.col(f"_g.s_{c}")
        return (F.col(c) - F.col(f"_g.m_{c}")) / F.when(s > 0, s).otherwise(F.lit(1.0))

    scaled = with_scalars(df, stats)
    return scaled.select(*df.columns, *[z(c).alias(c + suffix) for c in columns])
