"""Normalising raw anomaly scores, scoring ratios, and fusing both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.functions.columns import (
    clip,
    finite,
    greatest_of,
    is_close,
    least_of,
    sigmoid,
    total,
)
from ampledger.operators.grouped import attach, group_quantiles, running_total, with_scalars
from ampledger.session import bounded, no_larger, row_bound, stored

#: Default fusion weights and ratio band.
WEIGHTS = {"iso": 0.7, "ratio": 0.3}
RATIO_LOW, RATIO_HIGH = 0.5, 2.0
NORMAL_SCORE = 0.3
FLAG_THRESHOLD = 0.5


def fill_missing(df: DataFrame, column: str, policy: str = "median", output: str | None = None) -> DataFrame:
    """NaN, infinite and NULL scores become 0, the mean or the median of the others."""
    output = output or column
    clean = finite(column)
    if policy == "zero":
        return no_larger(df.withColumn(output, F.coalesce(clean, F.lit(0.0))), df)
    if policy == "mean":
        stats = df.agg(F.avg(clean).alias("fill"))
    elif policy == "median":
        stats = group_quantiles(df, [], clean, {"fill": 0.5})
    else:
        raise ValueError(f"missing scores can not be handled by {policy!r}")
    filled = F.coalesce(clean, F.col("_g.fill"), F.lit(0.0))
    return no_larger(with_scalars(df, stats).withColumn(output, filled).drop("_g"), df)


def normalise_scores(df: DataFrame, column: str, method: str = "minmax", output: str = "score") -> DataFrame:
    """Bring ``column`` (no missing values) to [0, 1]."""
    return no_larger(_normalise(df, column, method, output), df)


def _normalise(df: DataFrame, column: str, method: str, output: str) -> DataFrame:
    x = F.col(column)
    if method == "percentile":
        return _percentile(df, column, output)
    if method in ("minmax", "robust"):
        stats = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
    if method == "minmax":
        return with_scalars(df, stats).withColumn(output, _minmax(x)).drop("_g")
    if method == "zscore":
        stats = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
        z = (x - F.col("_g.mean")) / F.col("_g.std")
        score = F.when(is_close(F.col("_g.std"), F.lit(0.0)), F.lit(0.5)).otherwise(sigmoid(z))
        return with_scalars(df, stats).withColumn(output, score).drop("_g")
    if method == "robust":
        quartiles = group_quantiles(df, [], column, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        both = with_scalars(with_scalars(df, stats), quartiles, "_q")
        iqr = F.col("_q.q3") - F.col("_q.q1")
        score = F.when(is_close(iqr, F.lit(0.0)), _minmax(x)).otherwise(
            sigmoid((x - F.col("_q.q2")) / iqr)
        )
        return both.withColumn(output, score).drop("_g", "_q")
    if method == "sigmoid":
        median = group_quantiles(df, [], column, {"q2": 0.5})
        return with_scalars(df, median).withColumn(output, sigmoid(x - F.col("_g.q2"))).drop("_g")
    raise ValueError(f"unknown normalisation {method!r}")


def _minmax(x: Column) -> Column:
    low, high = F.col("_g.mn"), F.col("_g.mx")
    return F.when(is_close(high, low), F.lit(0.5)).otherwise((x - low) / (high - low))


def _percentile(df: DataFrame, column: str, output: str) -> DataFrame:
    """Average rank / n. Ranks are taken over distinct values, counted map-side, and
    joined back with a salt because one value may be shared by many rows."""
    counted = df.groupBy(column).agg(F.count("*").alias("_k"))
    ranked = running_total(counted, [column], F.col("_k"), name="_to")
    n = df.agg(F.count("*").alias("n"))
    average = F.col("_to") - (F.col("_k") - 1) / 2
    ranks = with_scalars(ranked, n).select(column, (average / F.col("_g.n")).alias(output))
    return attach(df, ranks, [column], "inner")


def ratio_score(
    ratio: Column | str,
    low: float = RATIO_LOW,
    high: float = RATIO_HIGH,
) -> Column:
    """Suspicion of a consumption ratio: rising to 1 below ``low``, flat inside the
    band, rising slowly by its logarithm above ``high``."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    above = F.lit(NORMAL_SCORE) + clip(F.log1p(r - high) / 10, 0.0, 0.5)
    return (
        F.when(r < low, F.lit(1.0) - r / low * 0.7)
        .when(r <= high, F.lit(NORMAL_SCORE))
        .when(r > high, above)
    )


def fuse(parts: dict[str, Column], weights: dict[str, float], method: str = "weighted_sum") -> Column:
    """Combine component scores in [0, 1]; the weights must sum to 1."""
    used = {k: w for k, w in weights.items() if k in parts}
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError(f"weights must sum to 1, got {weights}")
    scores = [parts[k] for k in used]
    if method == "weighted_sum":
        return total([F.lit(w) * parts[k] for k, w in used.items()])
    if method == "weighted_product":
        product = F.lit(1.0)
        for k, w in used.items():
            product = product * F.pow(parts[k], F.lit(w))
        return F.pow(product, F.lit(1.0 / sum(used.values())))
    if method == "max":
        return greatest_of(scores)
    if method == "min":
        return least_of(scores)
    if method == "harmonic":
        return F.lit(sum(used.values())) / total([F.lit(w) / (parts[k] + 1e-10) for k, w in used.items()])
    raise ValueError(f"unknown fusion {method!r}")


def score_meters(
    df: DataFrame,
    raw: str = "raw_score",
    ratio: str = "ratio",
    normalisation: str = "minmax",
    fusion: str = "weighted_sum",
    weights: dict[str, float] | None = None,
    missing: str = "median",
    threshold: float = FLAG_THRESHOLD,
) -> DataFrame:
    """Adds ``iso_score, ratio_score, composite_score, anomaly_flag`` to every meter.

    The scored table (one row per meter) is written once: what follows reads columns
    instead of carrying the whole score expression into every rule.
    """
    filled = fill_missing(df, raw, missing, "_raw")
    filled = fill_missing(filled, ratio, missing, "_ratio")
    scored = normalise_scores(filled, "_raw", normalisation, "iso_score")
    scored = no_larger(scored.withColumn("ratio_score", ratio_score("_ratio")), scored)
    parts = {"iso": F.col("iso_score"), "ratio": F.col("ratio_score")}
    composite = clip(fuse(parts, weights or WEIGHTS, fusion), 0.0, 1.0)
    return stored(
        scored.withColumn("composite_score", composite)
        .withColumn("anomaly_flag", (F.col("composite_score") >= threshold).cast("int"))
        .drop("_raw", "_ratio")
    )


def score_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, population std, min, max, quartiles of each score column."""
    stacked = df.select(*columns).unpivot([], columns, "score_name", "value")
    stacked = bounded(stacked, None if row_bound(df) is None else row_bound(df) * len(columns))
    moments = stacked.groupBy("score_name").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = group_quantiles(stacked, ["score_name"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return attach(moments, quartiles, ["score_name"])
