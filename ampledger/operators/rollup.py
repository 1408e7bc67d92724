"""Roll-ups: meters to transformers to districts to cities, and their summaries.

Means of means are kept as such: a district's score is the mean over its
transformers, a city's the mean over its districts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.operators.grouped import attach, group_median, with_scalars
from ampledger.operators.risk import level_of


def monthly_profile(long: DataFrame) -> DataFrame:
    """``transformer_id, avg_consumption, median_consumption``: mean of the monthly means
    and median of the monthly medians. Months per transformer are few."""
    means = (
        long.groupBy("transformer_id", "month")
        .agg(F.avg("kwh").alias("m"))
        .groupBy("transformer_id")
        .agg(F.avg("m").alias("avg_consumption"))
    )
    medians = (
        group_median(long, ["transformer_id", "month"], "kwh", "m")
        .groupBy("transformer_id")
        .agg(F.median("m").alias("median_consumption"))
    )
    return means.join(medians, "transformer_id", "left")


def transformers(meters: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Meters to transformers. ``first`` values are those of the smallest meter id; rows
    without a transformer are left out."""

    def first(column: str):
        return F.min_by(F.col(column), F.col("meter_id")).alias(column)

    rolled = (
        meters.where(F.col("transformer_id").isNotNull())
        .groupBy("transformer_id")
        .agg(
            F.count("meter_id").alias("total_meters"),
            F.avg("anomaly_score").alias("avg_anomaly_score"),
            *[first(c) for c in ("lat", "lon", "barangay", "city_id")],
            F.sum("kva").alias("capacity_kva"),
            F.count_if(F.col("risk_level") == "HIGH").alias("suspicious_meter_count"),
        )
        .withColumn("risk_level", level_of(F.col("avg_anomaly_score")))
    )
    return rolled if long is None else attach(rolled, monthly_profile(long), ["transformer_id"])


def barangays(transformer_table: DataFrame) -> DataFrame:
    return transformer_table.where(F.col("barangay").isNotNull()).groupBy("barangay").agg(
        F.count("*").alias("total_transformers"),
        F.avg("avg_anomaly_score").alias("avg_risk_score"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.min_by("city_id", "transformer_id").alias("city_id"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_count"),
    )


def cities(barangay_table: DataFrame) -> DataFrame:
    rolled = barangay_table.where(F.col("city_id").isNotNull()).groupBy("city_id").agg(
        F.sum("total_transformers").alias("total_transformers"),
        F.avg("avg_risk_score").alias("avg_risk_score"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.sum("high_risk_count").alias("high_risk_count"),
    )
    return rolled.withColumn("city_name", F.initcap(F.regexp_replace("city_id", "_", " ")))


def run_summary(meters: DataFrame, transformer_table: DataFrame, barangay_table: DataFrame, city_table: DataFrame) -> DataFrame:
    """One row: totals, HIGH counts, and the most anomalous city, district, transformer."""
    totals = meters.agg(
        F.count("*").alias("total_meters"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_meters"),
    )

    def worst(name: str, score: str):
        """The highest score; of equal ones the smallest name, so that ids may be text."""
        return F.min_by(name, F.struct(F.col(score).isNull(), -F.col(score), F.col(name)))

    of_transformers = transformer_table.agg(
        F.count("*").alias("total_transformers"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_transformers"),
        worst("transformer_id", "avg_anomaly_score").alias("most_anomalous_transformer"),
    )
    of_barangays = barangay_table.agg(
        F.count("*").alias("total_barangays"),
        worst("barangay", "avg_risk_score").alias("most_anomalous_barangay"),
    )
    of_cities = city_table.agg(
        F.count("*").alias("total_cities"), worst("city_name", "avg_risk_score").alias("most_anomalous_city")
    )
    out = totals
    for name, part in (("_t", of_transformers), ("_b", of_barangays), ("_c", of_cities)):
        out = with_scalars(out, part, name)
    return out.select("*", "_t.*", "_b.*", "_c.*").drop("_t", "_b", "_c")


def top_transformers(transformer_table: DataFrame, n: int = 10) -> DataFrame:
    return transformer_table.orderBy(F.desc("avg_anomaly_score"), "transformer_id").limit(n)


def suspicion_by_transformer(
    features: DataFrame, ratio: str, trend: str, max_ratio: float = 0.6, max_trend: float = -5.0, min_rate: float = 0.20
) -> DataFrame:
    """Transformers where more than ``min_rate`` of the meters are low and falling."""
    suspicious = F.coalesce(((F.col(ratio) < max_ratio) & (F.col(trend) < max_trend)).cast("int"), F.lit(0))
    stats = features.groupBy("transformer_id").agg(
        F.sum(suspicious).alias("suspicious_count"),
        F.count("*").alias("total_meters"),
        F.avg(ratio).alias("avg_ratio"),
        F.avg(trend).alias("avg_trend"),
    )
    rate = F.col("suspicious_count") / F.col("total_meters")
    return stats.withColumn("suspicion_rate", rate).where(F.col("suspicion_rate") > min_rate)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``value, n`` by falling count; ``top`` keeps the first few."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if top is None else ordered.limit(top)


def class_means(long: DataFrame) -> DataFrame:
    """Mean of the monthly means per customer class."""
    monthly = long.groupBy("customer_class", "month").agg(F.avg("kwh").alias("m"))
    return monthly.groupBy("customer_class").agg(F.avg("m").alias("mean_kwh"))


def city_districts(meters: DataFrame) -> DataFrame:
    """Districts of each city: sorted set and its size. Pairs are made distinct first, so
    a city's set never sees its meters."""
    pairs = meters.select("city_id", "barangay").distinct()
    return pairs.groupBy("city_id").agg(
        F.array_sort(F.collect_set("barangay")).alias("barangays"), F.count("barangay").alias("n_barangays")
    )


def city_risk(meters: DataFrame, known: DataFrame, level: str = "risk_level") -> DataFrame:
    """HIGH / MEDIUM / LOW counts per known city and a colour by the HIGH share."""
    counts = meters.groupBy("city_id").agg(
        *[F.count_if(F.upper(level) == v).alias(f"n_{v.lower()}") for v in ("HIGH", "MEDIUM", "LOW")],
        F.count("*").alias("n_meters"),
    )
    share = F.col("n_high") / F.col("n_meters")
    # Map colours.
    colour = F.when(share > 0.3, F.lit("#EF4444")).when(share > 0.1, F.lit("#F59E0B")).otherwise(F.lit("#10B981"))
    return counts.join(known.select("city_id").distinct(), "city_id", "left_semi").withColumn("colour", colour)


def city_list(city_table: DataFrame, meters: DataFrame) -> DataFrame:
    """Cities with a district level by HIGH count and their number of meters."""
    counts = meters.groupBy("city_id").agg(F.count("*").alias("total_meters"))
    high = F.col("high_risk_count")
    level = F.when(high > 5, F.lit("high")).when(high > 2, F.lit("medium")).otherwise(F.lit("low"))
    joined = city_table.join(counts, "city_id", "left")
    return joined.select(
        "city_id",
        "city_name",
        "total_transformers",
        level.alias("risk_level"),
        F.coalesce("total_meters", F.lit(0)).alias("total_meters"),
    )


def series_summary(meters: DataFrame, values: str = "monthly_consumptions", peak_factor: float = 1.3) -> DataFrame:
    """Rounded mean, peak, last value and months far above the mean of each meter's array."""
    v = F.col(values)
    n = F.size(v)
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), n)
    rest = [c for c in meters.columns if c != values]
    return meters.withColumn("_mean", mean).select(
        *rest,
        F.coalesce(F.floor(F.col("_mean") + 0.5), F.lit(0)).cast("bigint").alias("avg_consumption"),
        F.coalesce(F.array_max(v), F.lit(0.0)).alias("peak_consumption"),
        F.coalesce(F.try_element_at(v, F.lit(-1)), F.lit(0.0)).alias("last_month"),
        F.size(F.filter(v, lambda x: x > F.col("_mean") * peak_factor)).alias("months_above"),
    )


def table_statistics(df: DataFrame, value: str) -> DataFrame:
    """mean, median, population std, min, max over all cells of a long table."""
    moments = df.agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return with_scalars(moments, group_median(df, [], value, "median")).select("*", "_g.median").drop("_g")


def bounds(meters: DataFrame) -> DataFrame:
    """One row: bounding box and distinct counts."""
    return meters.agg(
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
        F.countDistinct("transformer_id").alias("n_transformers"),
        F.countDistinct("customer_class").alias("n_classes"),
    )


def mostly_zero(long: DataFrame, share: float = 0.3) -> DataFrame:
    """Meters with more than ``share`` of their months at zero."""
    counts = long.groupBy("meter_id").agg(
        F.count_if(F.col("kwh") == 0).alias("zero_months"), F.count("*").alias("n_months")
    )
    return counts.where(F.col("zero_months") > share * F.col("n_months"))


def ambiguous_names(places: DataFrame) -> DataFrame:
    """District names that occur in more than one city."""
    named = places.groupBy("barangay").agg(F.countDistinct("city_id").alias("n_cities"))
    return named.where("n_cities > 1")
