"""Features per meter and baselines per transformer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.functions.columns import month_index, ols_slope, safe_ratio, sorted_median
from ampledger.operators.grouped import (
    attach,
    group_median,
    group_quantiles,
    running_total,
    with_scalars,
)
from ampledger.session import bounded, no_larger, row_bound, stored

EPS = 1e-6
#: Fixed value: scales the median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.4826
TRIM_SHARE = 0.1
TREND_MONTHS = 6
MIN_TREND_MONTHS = 3


def meter_statistics(long: DataFrame, meter: str = "meter_id", month: str = "month", value: str = "kwh") -> DataFrame:
    """Fourteen statistics of each meter's series in one grouped pass.

    A meter has one row per month, so its exact percentiles are small.
    """
    v = F.col(value)
    stats = long.where(v.isNotNull()).groupBy(meter).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        ols_slope(v, month_index(F.col(month)).cast("double")).alias("_slope"),
        (F.count_if(v == 0) / F.count("*")).alias("zero_ratio"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
    )
    q25, q50, q75 = (F.col("_q")[i] for i in range(3))
    return stats.select(
        meter,
        "mean",
        q50.alias("median"),
        "std",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("std") / (F.col("mean") + EPS)).alias("cv"),
        q25.alias("p25"),
        q75.alias("p75"),
        (q75 - q25).alias("iqr"),
        F.when(F.col("zero_ratio") == 1, F.lit(0.0)).otherwise(F.col("_slope")).alias("trend"),
        "zero_ratio",
        "skewness",
        "kurtosis",
    )


def _valid(long: DataFrame, group: str, value: str, include_zeros: bool) -> DataFrame:
    """Readings that count for their group; rows without a group belong to none."""
    v = F.col(value)
    return no_larger(long.where((v.isNotNull() if include_zeros else v > 0) & F.col(group).isNotNull()), long)


def transformer_baseline(
    long: DataFrame,
    statistic: str = "median",
    group: str = "transformer_id",
    value: str = "kwh",
    include_zeros: bool = False,
    output: str = "baseline",
) -> DataFrame:
    """Central value of each transformer's readings. Zeros are left out by default."""
    valid = _valid(long, group, value, include_zeros)
    if statistic == "median":
        return group_median(valid, [group], value, output)
    if statistic == "mean":
        return no_larger(valid.groupBy(group).agg(F.avg(value).alias(output)), valid)
    if statistic == "trimmed_mean":
        return _trimmed_mean(valid, group, value, output)
    raise ValueError(f"unknown statistic {statistic!r}")


def _trimmed_mean(valid: DataFrame, group: str, value: str, output: str) -> DataFrame:
    """Mean without the lowest and highest tenth of the ranks.

    Equal values are one counted row; each contributes the part of its rank span that
    lies between the cuts, so a hot transformer is spread over range partitions.
    """
    counted = valid.groupBy(group, value).agg(F.count("*").alias("_k"))
    ranked = running_total(counted, [value], F.col("_k"), [group], "_to")
    sizes = no_larger(valid.groupBy(group).agg(F.count("*").alias("_n")), valid)
    ranked = attach(ranked, sizes, [group])
    cut = F.floor(F.lit(TRIM_SHARE) * F.col("_n"))
    first = F.greatest(F.col("_to") - F.col("_k"), cut)
    last = F.least(F.col("_to"), F.col("_n") - cut)
    kept = F.greatest(last - first, F.lit(0))
    means = ranked.groupBy(group).agg((F.sum(F.col(value) * kept) / F.sum(kept)).alias(output))
    return no_larger(means, valid)


def transformer_spread(
    long: DataFrame,
    statistic: str = "mad",
    group: str = "transformer_id",
    value: str = "kwh",
    include_zeros: bool = False,
    output: str = "spread",
    centre: DataFrame | None = None,
) -> DataFrame:
    """Spread of each transformer's readings; ``mad`` takes its medians from ``centre``
    (``group, _m``) if they are known already."""
    valid = _valid(long, group, value, include_zeros)
    if statistic == "variance":
        return no_larger(valid.groupBy(group).agg(F.var_samp(value).alias(output)), valid)
    if statistic == "std":
        return no_larger(valid.groupBy(group).agg(F.stddev_samp(value).alias(output)), valid)
    if statistic == "iqr":
        q = group_quantiles(valid, [group], value, {"_a": 0.25, "_b": 0.75})
        return no_larger(q.select(group, (F.col("_b") - F.col("_a")).alias(output)), valid)
    if statistic == "mad":
        values = no_larger(valid.select(group, value), valid)
        medians = group_median(valid, [group], value, "_m")
        centred = attach(values, medians if centre is None else centre, [group])
        deviation = F.abs(F.col(value) - F.col("_m"))
        mad = group_median(centred, [group], deviation, output)
        return no_larger(mad.withColumn(output, F.col(output) * MAD_SCALE), valid)
    raise ValueError(f"unknown statistic {statistic!r}")


def theil_sen(points: Column) -> Column:
    """Median slope over all pairs of a short array of ``struct(x, y)`` sorted by x."""
    slopes = F.flatten(
        F.transform(
            points,
            lambda p: F.transform(
                F.filter(points, lambda q: q["x"] > p["x"]),
                lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"]),
            ),
        )
    )
    return sorted_median(slopes)


def meter_trend(
    long: DataFrame,
    method: str = "theil_sen",
    months: int = TREND_MONTHS,
    min_months: int = MIN_TREND_MONTHS,
    include_zeros: bool = False,
    meter: str = "meter_id",
    month: str = "month",
    value: str = "kwh",
    output: str = "trend",
) -> DataFrame:
    """Trend over the last ``months`` months of the table, NULL below ``min_months`` valid ones.

    Missing months keep their position. Every meter of the table has a row. The
    last month is a scalar subquery and the window is cut before the grouping, so at
    most ``months`` readings per meter are shuffled, already aggregated map-side.
    """
    x = month_index(F.col(month))
    last = long.agg(F.max(month_index(F.col(month))).alias("last"))
    v = F.col(value)
    usable = (v.isNotNull() if include_zeros else v > 0) & (x > F.col("_g.last") - months)
    y, pos = F.when(usable, v), F.when(usable, x)
    grouped = with_scalars(long, last).groupBy(meter)
    point = F.when(usable, F.struct(x.alias("x"), v.alias("y")))
    first_y, last_y = F.col("_ends.first.y"), F.col("_ends.last.y")
    if method == "ols":
        stats = grouped.agg(F.count(y).alias("_n"), ols_slope(y, pos.cast("double")).alias("_t"))
        trend = F.col("_t")
    elif method == "theil_sen":
        stats = grouped.agg(F.count(y).alias("_n"), F.collect_list(point).alias("_p"))
        trend = theil_sen(F.col("_p"))
    elif method in ("difference", "percent_change"):
        ends = F.struct(F.min(point).alias("first"), F.max(point).alias("last"))
        stats = grouped.agg(F.count(y).alias("_n"), ends.alias("_ends"))
        trend = last_y - first_y
        if method == "percent_change":
            trend = F.try_divide(trend, first_y) * 100
    else:
        raise ValueError(f"unknown trend method {method!r}")
    trends = stats.select(meter, F.when(F.col("_n") >= min_months, trend).alias(output))
    return no_larger(trends, long)


def consumption_ratio(
    long: DataFrame,
    baseline: DataFrame,
    meter: str = "meter_id",
    group: str = "transformer_id",
    value: str = "kwh",
    baseline_column: str = "baseline",
    output: str = "ratio",
) -> DataFrame:
    """``meter, group, mean_kwh, baseline, ratio``: a meter against its transformer."""
    meters = no_larger(long.groupBy(meter, group).agg(F.avg(value).alias("mean_kwh")), long)
    joined = attach(meters, baseline, [group])
    ratio = safe_ratio(F.col("mean_kwh"), F.col(baseline_column))
    return no_larger(joined.select(meter, group, "mean_kwh", baseline_column, ratio.alias(output)), long)


def trend_statistics(trends: DataFrame, trend: str = "trend") -> DataFrame:
    t = F.col(trend)
    moments = trends.agg(
        F.count(t).alias("n"),
        F.avg(t).alias("mean"),
        F.stddev_pop(t).alias("std"),
        (F.count_if(t < 0) / F.count(t)).alias("share_declining"),
    )
    median = group_median(trends, [], trend, "median")
    return with_scalars(moments, median).select("*", "_g.median").drop("_g")


def ratio_statistics(ratios: DataFrame, ratio: str = "ratio") -> DataFrame:
    r = F.col(ratio)
    moments = ratios.agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        (F.count_if(r < 0.5) / F.count(r)).alias("share_below_half"),
        (F.count_if(r > 2.0) / F.count(r)).alias("share_above_double"),
    )
    median = group_median(ratios, [], ratio, "median")
    return with_scalars(moments, median).select("*", "_g.median").drop("_g")


#: Names of the four engineered features.
ENGINEERED = [
    "transformer_baseline_median",
    "transformer_baseline_variance",
    "meter_consumption_trend",
    "consumption_ratio_to_transformer_median",
]


def engineer_features(
    long: DataFrame,
    baseline_statistic: str = "median",
    spread_statistic: str = "mad",
    trend_method: str = "theil_sen",
    include_zeros: bool = False,
) -> DataFrame:
    """``meter_id, transformer_id`` and the four engineered features, one row per meter.

    ``long`` is read by every feature: hand in a stored table, not a long plan. The
    baseline is computed once and serves the ratio and, as centre, the spread.
    """
    base, spread, trend, ratio = ENGINEERED
    baseline = stored(
        transformer_baseline(long, baseline_statistic, include_zeros=include_zeros, output=base)
    )
    centre = None
    if baseline_statistic == "median":
        centre = no_larger(baseline.withColumnRenamed(base, "_m"), baseline)
    spreads = transformer_spread(
        long, spread_statistic, include_zeros=include_zeros, output=spread, centre=centre
    )
    trends = meter_trend(long, trend_method, include_zeros=include_zeros, output=trend)
    ratios = consumption_ratio(long, baseline, baseline_column=base, output=ratio)
    with_spread = attach(ratios, spreads, ["transformer_id"])
    features = with_spread.join(trends, "meter_id", "left")
    return no_larger(features.select("meter_id", "transformer_id", *ENGINEERED), long)


def feature_coverage(features: DataFrame, columns: list[str], warn_below: float = 0.8) -> DataFrame:
    """One row per feature: valid count, share, warning flag, and the number of transformers."""
    counts = features.agg(
        F.count("*").alias("_rows"),
        F.countDistinct("transformer_id").alias("n_transformers"),
        *[F.count(c).alias(c) for c in columns],
    )
    long = counts.unpivot(["_rows", "n_transformers"], columns, "feature", "n_valid")
    share = F.col("n_valid") / F.col("_rows")
    return long.select(
        "feature", "n_valid", share.alias("share"), (share < warn_below).alias("low"), "n_transformers"
    )


def dispersion(long: DataFrame, meter: str = "meter_id", value: str = "kwh") -> DataFrame:
    """Median, population variance and variance / median of each meter."""
    stats = long.groupBy(meter).agg(F.median(value).alias("median"), F.var_pop(value).alias("variance"))
    return stats.withColumn("variance_ratio", F.col("variance") / (F.col("median") + EPS))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max; one row per column."""
    stacked = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value"
    )
    stacked = bounded(stacked, None if row_bound(df) is None else row_bound(df) * len(columns))
    moments = stacked.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = group_quantiles(stacked, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return attach(moments, quartiles, ["feature"])
