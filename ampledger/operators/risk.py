"""Risk levels with reasons, run metrics, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import clip
from ampledger.operators.grouped import group_median, with_scalars
from ampledger.session import no_larger

# Class defaults of the thresholds.
HIGH_SCORE, MEDIUM_SCORE = 0.8, 0.6
EXTREME_LOW_RATIO, SUSPICIOUS_LOW_RATIO = 0.2, 0.4
SPATIAL_BOOST, MIN_FLAGGED = 0.15, 3
INFERENCE_HIGH, INFERENCE_MEDIUM = 0.7, 0.4
BASELINE_HIGH_RATE = 0.20
CONFIDENCE_BANDS = [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]
MULTI_FACTOR_WEIGHTS = (0.5, 0.3, 0.2)
# Texts shown beside a level.
EXPLANATIONS = {
    "HIGH": "⚠️ High anomaly detected - Prioritize for field inspection",
    "MEDIUM": "⚡ Moderate anomaly - Monitor closely",
    "LOW": "✅ Normal consumption pattern",
}
DEFAULT_EXPLANATION = "Anomaly detection completed"


def spatial_boost(
    df: DataFrame,
    composite: str = "composite_score",
    flag: str = "spatial_anomaly",
    amount: float = SPATIAL_BOOST,
    min_flagged: int = MIN_FLAGGED,
) -> DataFrame:
    """Adds ``spatial_boost`` and ``risk_score``. No boost unless the whole table has at
    least ``min_flagged`` flagged meters."""
    flagged = df.agg(F.sum(F.col(flag)).alias("n"))
    boost = F.when((F.col("_g.n") >= min_flagged) & (F.col(flag) == 1), F.lit(amount)).otherwise(F.lit(0.0))
    return (
        with_scalars(df, flagged)
        .withColumn("spatial_boost", boost)
        .withColumn("risk_score", clip(F.col(composite) + F.col("spatial_boost"), 0.0, 1.0))
        .drop("_g")
    )


def risk_class(
    risk: Column,
    composite: Column,
    ratio: Column | None,
    high: float = HIGH_SCORE,
    medium: float = MEDIUM_SCORE,
    extreme_low: float = EXTREME_LOW_RATIO,
    suspicious_low: float = SUSPICIOUS_LOW_RATIO,
    override_rules: bool = True,
) -> Column:
    """``struct(risk_level, risk_reason)``; the first rule that holds decides."""

    def verdict(level: str, reason: str) -> Column:
        return F.struct(F.lit(level).alias("risk_level"), F.lit(reason).alias("risk_reason"))

    by_ratio = override_rules and ratio is not None
    never = F.lit(False)
    return (
        F.when(ratio < extreme_low if by_ratio else never, verdict("high", "extreme_low_consumption"))
        .when(risk > high, verdict("high", "high_composite_score"))
        .when((composite > medium) & (risk > composite), verdict("high", "spatial_cluster_boost"))
        .when(ratio < suspicious_low if by_ratio else never, verdict("medium", "suspicious_low_consumption"))
        .when(risk > medium, verdict("medium", "medium_composite_score"))
        .otherwise(verdict("low", "normal_behavior"))
    )


def assess(df: DataFrame, ratio: str | None = "ratio", flag: str | None = "spatial_anomaly", **thresholds) -> DataFrame:
    """Boost and classify: adds ``spatial_boost, risk_score, risk_level, risk_reason``."""
    if flag is None:
        boosted = df.withColumn("spatial_boost", F.lit(0.0)).withColumn("risk_score", F.col("composite_score"))
    else:
        boosted = spatial_boost(df, flag=flag)
    verdict = risk_class(
        F.col("risk_score"), F.col("composite_score"), F.col(ratio) if ratio else None, **thresholds
    )
    return no_larger(boosted.withColumn("_v", verdict).select(*boosted.columns, "_v.*"), df)


def risk_distribution(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """One row: meters per level and their percentages."""
    n = F.count("*")
    levels = ["high", "medium", "low"]
    return df.agg(
        n.alias("total"),
        *[F.count_if(F.col(level) == v).alias(f"n_{v}") for v in levels],
        *[(F.count_if(F.col(level) == v) * 100.0 / n).alias(f"pct_{v}") for v in levels],
    )


def level_of(score: Column, high: float = INFERENCE_HIGH, medium: float = INFERENCE_MEDIUM) -> Column:
    """HIGH / MEDIUM / LOW with inclusive cut-offs; UNKNOWN without a score."""
    return (
        F.when(score.isNull(), F.lit("UNKNOWN"))
        .when(score >= high, F.lit("HIGH"))
        .when(score >= medium, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def predictions(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Level, confidence, explanation and pattern of a score in [0, 1]."""
    s = F.col(score)
    level = F.col("risk_level")
    explanation = F.lit(None).cast("string")
    for name, text in EXPLANATIONS.items():
        explanation = F.when(level == name, F.lit(text)).otherwise(explanation)
    confidence = F.when(level == "HIGH", s).when(level == "MEDIUM", F.lit(0.7)).otherwise(1.0 - s)
    return (
        df.withColumn("risk_level", level_of(s))
        .withColumn("confidence", confidence)
        .withColumn("explanation", explanation)
        .withColumn("consumption_pattern", F.when(s > 0.5, F.lit("ANOMALOUS")).otherwise(F.lit("NORMAL")))
    )


def complete_predictions(df: DataFrame) -> DataFrame:
    """Fill prediction columns that a detector left out, from the schema alone."""
    if "meter_id" not in df.columns:
        raise ValueError("predictions need meter_id")
    have_score = "anomaly_score" in df.columns
    s = F.col("anomaly_score")
    defaults = {
        "risk_level": level_of(s) if have_score else F.lit("UNKNOWN"),
        "anomaly_score": F.lit(0.5),
        "confidence": F.abs(s - 0.5) * 2 if have_score else F.lit(0.5),
        "explanation": F.lit(DEFAULT_EXPLANATION),
    }
    return df.select("*", *[e.alias(c) for c, e in defaults.items() if c not in df.columns])


def declining_low_users(
    features: DataFrame, ratio: str, trend: str, max_ratio: float = 0.6, max_trend: float = -5.0
) -> DataFrame:
    """Meters that use far less than their peers and are falling; lower score is worse."""
    hit = features.where((F.col(ratio) < max_ratio) & (F.col(trend) < max_trend))
    return hit.withColumn("suspicion_score", F.col(ratio) + F.col(trend) / 100)


def risk_band(median: Column) -> Column:
    return F.when(median < 50, F.lit("High")).when(median < 100, F.lit("Medium")).otherwise(F.lit("Low"))


def display_labels(df: DataFrame) -> DataFrame:
    """Lower-case level, its label, and a note with the score in percent for high risk."""
    level = F.col("risk_level")
    name = F.when(level == "HIGH", F.lit("high")).when(level == "MEDIUM", F.lit("medium")).otherwise(F.lit("low"))
    note = F.format_string(
        "High anomaly score detected (%.1f%%). Recommend field inspection.", F.col("anomaly_score") * 100
    )
    return df.select(
        "*",
        name.alias("display_level"),
        F.concat(F.initcap(name), F.lit(" Risk")).alias("display_band"),
        F.when(level == "HIGH", note).alias("anomaly_note"),
    )


def confidence(df: DataFrame, level: str = "risk_level", baseline: float = BASELINE_HIGH_RATE, clipped: bool = True) -> DataFrame:
    """Confidence of the whole run in one row: 1 - high rate / baseline."""
    counts = df.agg(
        F.count("*").alias("total_samples"),
        *[F.count_if(F.lower(F.col(level)) == v).alias(f"{v}_risk_count") for v in ("high", "medium", "low")],
    )
    rate = F.col("high_risk_count") / F.col("total_samples")
    raw = 1.0 - rate / baseline
    value = clip(raw, 0.0, 1.0) if clipped else raw
    band = F.lit("very_low")
    for floor, name in reversed(CONFIDENCE_BANDS):
        band = F.when(value >= floor, F.lit(name)).otherwise(band)
    return counts.select(
        "*",
        value.alias("confidence"),
        band.alias("confidence_level"),
        rate.alias("high_risk_rate"),
        F.lit(baseline).alias("baseline_rate"),
        (rate - baseline).alias("deviation"),
        F.when(raw < 0, F.lit("rate_above_baseline")).when(raw > 1, F.lit("rate_below_baseline")).alias("warning"),
        (F.col("total_samples") >= 10).alias("enough_samples"),
    )


def sort_score(
    strategy: str,
    composite: Column,
    risk: Column | None = None,
    ratio: Column | None = None,
    weights: tuple[float, float, float] = MULTI_FACTOR_WEIGHTS,
) -> Column:
    """Priority of a meter, higher first. Ratios are negated, as low use is suspicious."""
    if strategy == "composite_score":
        return composite
    if strategy == "risk_score" and risk is not None:
        return risk
    if strategy == "consumption_ratio" and ratio is not None:
        return -ratio
    if strategy == "multi_factor":
        score = weights[0] * composite
        if risk is not None:
            score = score + weights[1] * risk
        if ratio is not None:
            score = score + weights[2] * (1.0 - clip(ratio, 0.0, 1.0))
        return score
    raise ValueError(f"strategy {strategy!r} is unknown or lacks its column")


def top_suspicious(
    df: DataFrame,
    n: int,
    strategy: str = "composite_score",
    meter: str = "meter_id",
    include_ties: bool = False,
) -> DataFrame:
    """The ``n`` meters to inspect first, ranked 1..n; equal scores order by meter id.

    Only a top-n is taken (each task keeps n rows). With ``include_ties`` the n-th
    score is looked up first and every meter at or above it is kept.
    """
    have = set(df.columns)
    composite = F.col("composite_score")
    risk = F.col("risk_score") if "risk_score" in have else composite
    scored = df.select(
        meter,
        composite,
        risk.alias("risk_score"),
        F.col("ratio") if "ratio" in have else F.lit(None).cast("double").alias("ratio"),
        (F.col("risk_level") if "risk_level" in have else F.lit("unknown")).alias("risk_level"),
        sort_score(
            strategy, composite, risk if "risk_score" in have else None, F.col("ratio") if "ratio" in have else None
        ).alias("sort_score"),
    )
    first = scored.orderBy(F.desc_nulls_last("sort_score"), F.asc(meter)).limit(n)
    by_score = Window.orderBy(F.desc_nulls_last("sort_score"), F.asc(meter))
    if not include_ties:
        return first.withColumn("priority_rank", F.row_number().over(by_score))
    # Missing scores rank last; if they are among the first n, all of them tie there.
    cutoff = first.agg(F.min("sort_score").alias("cutoff"), F.count_if(F.col("sort_score").isNull()).alias("missing"))
    among = (F.col("sort_score") >= F.col("_g.cutoff")) | (F.col("_g.missing") > 0)
    tied = with_scalars(scored, cutoff).where(among).drop("_g")
    higher = first.groupBy("sort_score").agg(F.count("*").alias("_k"))
    ranks = higher.withColumn(
        "priority_rank",
        F.coalesce(
            F.sum("_k").over(Window.orderBy(F.desc_nulls_last("sort_score")).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
        + 1,
    ).drop("_k")
    ranks = ranks.withColumnRenamed("sort_score", "_score")
    return tied.join(F.broadcast(ranks), F.col("sort_score").eqNullSafe(F.col("_score"))).drop("_score")


def run_metrics(df: DataFrame, top_n: int = 100) -> DataFrame:
    """One row of a run's metrics: rates, counts and statistics of the composite score."""
    s = F.col("composite_score")
    total = F.count("*")
    stats = df.agg(
        total.alias("total_meters"),
        F.sum("anomaly_flag").alias("anomalies_detected"),
        F.avg("anomaly_flag").alias("detection_rate"),
        *[F.count_if(F.col("risk_level") == v).alias(f"{v}_risk_count") for v in ("high", "medium", "low")],
        (F.count_if(F.col("risk_level") == "high") / total).alias("high_risk_rate"),
        (F.least(F.lit(top_n), total) / total).alias("top_n_coverage"),
        F.avg(s).alias("score_mean"),
        F.stddev_samp(s).alias("score_std"),
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
    )
    median = group_median(df, [], "composite_score", "m")
    return with_scalars(stats, median).select("*", F.col("_g.m").alias("score_median")).drop("_g")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, precision, recall and F1 of two 0/1 columns; undefined ratios are 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counts.select(
        "*",
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def feature_contrast(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Per feature: mean of flagged meters, mean of the others, difference."""
    hot = F.col(flag) == 1
    means = df.agg(
        *[F.avg(F.when(hot, F.col(c))).alias(f"{c}@1") for c in columns],
        *[F.avg(F.when(~hot, F.col(c))).alias(f"{c}@0") for c in columns],
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(f"`{c}@1`").alias("mean_flagged"),
                    F.col(f"`{c}@0`").alias("mean_normal"),
                )
                for c in columns
            ]
        )
    )
    return means.select(pairs.alias("p")).select(
        "p.*", (F.col("p.mean_flagged") - F.col("p.mean_normal")).alias("difference")
    )
