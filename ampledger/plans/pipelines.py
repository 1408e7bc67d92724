"""The three entry points as Spark jobs: training run, upload run, single meters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.operators.detectors import (
    CONTAMINATION,
    Detector,
    Fitted,
    Tuning,
    fit,
    risk_separation,
    tune,
)
from ampledger.operators.features import ENGINEERED, consumption_ratio, engineer_features, meter_trend
from ampledger.operators.forest import IsolationForest
from ampledger.operators.grouped import attach
from ampledger.operators.impute import impute
from ampledger.operators.reshape import to_long
from ampledger.operators.risk import assess, complete_predictions, level_of, predictions, run_metrics
from ampledger.operators.rollup import barangays, cities, run_summary, transformers
from ampledger.operators.scaling import outlier_bounds, treat_outliers
from ampledger.operators.scoring import FLAG_THRESHOLD, score_meters
from ampledger.operators.separation import cluster_quality
from ampledger.operators.spatial import SMALL_CLUSTER, cluster_statistics, cluster_table, dbscan
from ampledger.operators.tuning import best_forest, register, tune_forest
from ampledger.session import no_larger, stored
from ampledger.sources.geography import districts
from ampledger.sources.models import load_fitted, save_fitted
from ampledger.sources.readers import clean_upload, pad_months, read_meters
from ampledger.sources.writers import save_run

RATIO = "consumption_ratio_to_transformer_median"
BASELINE = "transformer_baseline_median"
SPREAD = "transformer_baseline_variance"
TREND = "meter_consumption_trend"


@dataclass(frozen=True)
class Options:
    """Choices of a training run; the operators explain them."""

    impute: str = "forward_fill"
    outlier_method: str = "sigma"
    outlier_threshold: float = 3.0
    contamination: float = CONTAMINATION
    normalisation: str = "minmax"
    fusion: str = "weighted_sum"
    weights: dict[str, float] | None = None
    missing: str = "median"
    flag_threshold: float = FLAG_THRESHOLD
    risk: dict = field(default_factory=dict)  # thresholds of risk_class


def filled(long: DataFrame, options: Options) -> DataFrame:
    """Readings without gaps as ``kwh``."""
    done = impute(long, options.impute, group="transformer_id")
    return no_larger(done.select("meter_id", "transformer_id", "month", F.col("kwh_filled").alias("kwh")), long)


def capped(readings: DataFrame, bounds: DataFrame) -> DataFrame:
    """``readings`` within the transformers' outlier bounds, in the unit of the input."""
    treated = treat_outliers(readings, bounds)
    out = treated.select("meter_id", "transformer_id", "month", F.col("kwh_capped").alias("kwh"))
    return no_larger(out, readings)


def model_inputs(df: DataFrame) -> DataFrame:
    """What a detector sees: a trend, ratio or baseline that is not known is 0 there and
    marked by ``is_imputed``; ``ratio`` keeps what is known for the rules on it."""
    missing = [F.col(c).isNull() for c in ENGINEERED]
    inputs = df.select(
        "meter_id",
        "transformer_id",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ENGINEERED],
        (missing[0] | missing[1] | missing[2] | missing[3]).alias("is_imputed"),
        F.col(RATIO).alias("ratio"),
    )
    return no_larger(inputs, df)


def feature_table(long: DataFrame) -> DataFrame:
    """Engineered features of every meter, written once."""
    return stored(model_inputs(engineer_features(long)))


@dataclass
class Trained:
    """What later runs need: the fitted detector, and of each transformer its baseline, its
    spread and its outlier bounds (``baselines``). A loaded model has no assessment."""

    fitted: Fitted
    baselines: DataFrame
    options: Options
    assessment: DataFrame | None = None
    metrics: DataFrame | None = None


def train(
    long: DataFrame, detector: Detector | None = None, clean: bool = True, options: Options = Options()
) -> Trained:
    """Clean, build features, fit, score, assess, measure."""
    bounds = None
    readings = long
    if clean:
        gapless = stored(filled(long, options))
        found = outlier_bounds(gapless, options.outlier_method, options.outlier_threshold, with_median=False)
        bounds = stored(found.select("transformer_id", "lower_bound", "upper_bound"))
        readings = stored(capped(gapless, bounds))
    features = feature_table(readings)
    fitted = fit(detector or IsolationForest(), features, ENGINEERED, options.contamination)
    scored = score_meters(
        fitted.training,
        normalisation=options.normalisation,
        fusion=options.fusion,
        weights=options.weights,
        missing=options.missing,
        threshold=options.flag_threshold,
    )
    assessed = assess(scored, flag=None, **options.risk)
    baselines = features.where(F.col("transformer_id").isNotNull()).groupBy("transformer_id").agg(
        F.max(BASELINE).alias(BASELINE), F.max(SPREAD).alias(SPREAD)
    )
    if bounds is None:
        none = F.lit(None).cast("double")
        baselines = baselines.withColumns({"lower_bound": none, "upper_bound": none})
    else:
        baselines = baselines.join(bounds, "transformer_id", "left")
    return Trained(fitted, stored(baselines), options, assessed, run_metrics(assessed))


def save_model(trained: Trained, folder: str) -> None:
    """Store what scoring needs as parquet and the options as JSON text."""
    save_fitted(trained.fitted, trained.baselines, folder)
    text = json.dumps(asdict(trained.options))
    spark = trained.baselines.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/options")


def load_model(spark: SparkSession, folder: str) -> Trained:
    fitted, baselines = load_fitted(spark, folder)
    text = "".join(r.value for r in spark.read.text(f"{folder}/options").collect())  # one line
    return Trained(fitted, baselines, Options(**json.loads(text)))


def train_isolation_forest(
    features: DataFrame, columns: list[str], contamination: float = CONTAMINATION, **options
) -> Fitted:
    """One call: an isolation forest with its threshold; options as in IsolationForest."""
    return fit(IsolationForest(**options), features, columns, contamination)


def train_dbscan(points: DataFrame, eps: float = 50.0, min_samples: int = 5, small: int = SMALL_CLUSTER) -> dict[str, DataFrame]:
    """One call: ``labelled`` points with ``spatial_anomaly`` (noise or in a small cluster),
    the ``clusters`` for later assignments, and one row of ``statistics``."""
    labelled = stored(dbscan(points, eps, min_samples))
    clusters = cluster_table(labelled, small)
    small_ones = no_larger(clusters.select("cluster", "is_small"), labelled)
    flagged = attach(labelled, small_ones, ["cluster"])
    odd = (F.col("cluster") < 0) | F.coalesce("is_small", F.lit(False))
    return {
        "labelled": flagged.withColumn("spatial_anomaly", odd.cast("int")).drop("is_small"),
        "clusters": clusters,
        "statistics": cluster_statistics(labelled, small),
    }


def tune_isolation_forest(
    features: DataFrame,
    columns: list[str],
    combinations: list[dict],
    patience: int | None = None,
    folds: int | None = None,
    metric: str = "separation",
    registry: str | None = None,
) -> Tuning:
    """Forest options by a metric.

    With ``folds`` every combination is cross-validated, all of them together, by
    ``separation``, ``silhouette``, ``silhouette_sq``, ``davies_bouldin`` or
    ``calinski_harabasz``, and the best model is fitted on all rows and registered as a version
    if a folder is given. Without, each is fitted and measured on all rows, one after the other.
    """
    if folds is not None:
        tuned = tune_forest(features, columns, combinations, folds, metric)
        if registry is not None:
            baselines = features.select("transformer_id").distinct()
            register(tuned, best_forest(tuned, features, columns), registry, "isolation_forest", baselines)
        return tuned

    def separation(options: dict) -> float:
        scored = IsolationForest(**options).fit(features, columns).score(features)
        return risk_separation(stored(scored)).first().separation

    return tune(combinations, separation, patience)


def tune_dbscan(points: DataFrame, combinations: list[dict], patience: int | None = None) -> Tuning:
    """``eps`` and ``min_samples`` by the Calinski-Harabasz index of anomalous against
    normal positions."""

    def separation(options: dict) -> float:
        labelled = train_dbscan(points, **options)["labelled"]
        return cluster_quality(labelled, "spatial_anomaly", ["lat", "lon"]).first().calinski_harabasz

    return tune(combinations, separation, patience)


def new_meter_features(long: DataFrame, trained: Trained) -> DataFrame:
    """The features of :func:`feature_table`, prepared as in training: gaps filled the same
    way, outliers capped by the stored bounds, ratios against the stored baselines."""
    kind = long.schema["transformer_id"].dataType
    baselines = trained.baselines.withColumn("transformer_id", F.col("transformer_id").cast(kind))
    limits = baselines.select("transformer_id", "lower_bound", "upper_bound")
    readings = stored(capped(filled(long, trained.options), limits))
    ratios = consumption_ratio(readings, baselines, baseline_column=BASELINE, output=RATIO)
    trends = meter_trend(readings, output=TREND)
    joined = ratios.join(trends, "meter_id", "left").join(
        baselines.select("transformer_id", SPREAD), "transformer_id", "left"
    )
    return no_larger(model_inputs(joined), readings)


def score_new_meters(long: DataFrame, trained: Trained) -> DataFrame:
    """Predictions for meters that come one at a time or in batches, with scores on the
    stored training range."""
    scored = trained.fitted.scores(new_meter_features(long, trained))
    return predictions(scored.withColumnRenamed("score", "anomaly_score"))


def predict_csv(spark: SparkSession, meters: str, model: str, output: str | None = None) -> DataFrame:
    """A file of meters and a stored model to predictions, written as CSV if wanted."""
    long = to_long(read_meters(spark, meters), ["meter_id", "transformer_id"])
    found = score_new_meters(long, load_model(spark, model))
    if output is not None:
        found.write.mode("overwrite").option("header", True).csv(output)
    return found


def one_meter(spark, meter_id: str, transformer_id, months: dict[str, float], trained: Trained) -> DataFrame:
    """A single meter given as ``{'yyyyMM': kWh}``."""
    rows = [(meter_id, transformer_id, m, float(v)) for m, v in months.items()]
    kind = trained.baselines.schema["transformer_id"].dataType.simpleString()
    frame = spark.createDataFrame(rows, f"meter_id string, transformer_id {kind}, m string, kwh double")
    long = frame.select("meter_id", "transformer_id", F.to_date("m", "yyyyMM").alias("month"), "kwh")
    return score_new_meters(long, trained)


def run_upload(
    upload: DataFrame,
    detector: Detector | None = None,
    folder: str | None = None,
    run_id: str | None = None,
    trained: Trained | None = None,
) -> dict[str, DataFrame]:
    """An uploaded wide table to meters, transformers, districts, cities and a summary;
    stored as one run if a folder is given.

    With a trained model the meters are scored by it, on its own range; without one a
    detector is fitted on the upload itself, whose highest score is then 1.
    """
    cleaned = stored(pad_months(clean_upload(upload)))
    long = stored(to_long(cleaned, ["meter_id", "transformer_id"]))
    if trained is not None:
        scored = score_new_meters(long, trained).select("meter_id", "anomaly_score")
    else:
        fitted = fit(detector or IsolationForest(), feature_table(long), ENGINEERED)
        scored = fitted.training_scores().select("meter_id", F.col("score").alias("anomaly_score"))
    predicted = complete_predictions(scored.withColumn("risk_level", level_of(F.col("anomaly_score"))))
    numbered = cleaned.withColumn("barangay_id", F.col("barangay_id").try_cast("int"))
    located = attach(numbered, districts(upload.sparkSession), ["barangay_id"])
    meters = stored(
        located.withColumn("city_id", F.coalesce("city_id", F.lit("unknown")))
        .withColumn("barangay", F.coalesce("barangay", F.lit("Unknown")))
        .withColumnRenamed("kVA", "kva")
        .join(predicted, "meter_id", "left")
    )
    by_transformer = stored(transformers(meters, long))
    by_district = barangays(by_transformer)
    by_city = cities(by_district)
    tables = {
        "meters": meters,
        "transformers": by_transformer,
        "barangays": by_district,
        "cities": by_city,
        "summary": run_summary(meters, by_transformer, by_district, by_city),
    }
    if folder is not None:
        save_run(run_id or "run", tables, folder)
    return tables
