"""Sinks: run tables partitioned by run, predictions, reports, GeoJSON."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampledger.operators.grouped import with_scalars
from ampledger.operators.reshape import filter_meters
from ampledger.operators.runs import live_runs

#: Column list of the meter export.
EXPORT_COLUMNS = [
    "meter_id",
    "transformer_id",
    "barangay",
    "customer_class",
    "lat",
    "lon",
    "anomaly_score",
    "risk_level",
    "confidence",
]
#: Folder of the events of a run folder, one numbered file each, and what such a file holds.
COMMITS = "_commits"
LOG_SCHEMA = "run_id string, event string, created_at string, schemas map<string,string>"


def save_run(run_id: str, tables: dict[str, DataFrame], folder: str) -> None:
    """Append one run: every table under ``folder/<name>`` partitioned by ``run_id``.

    Rows go out in the partitions they are in. The run is committed last, so a run whose job
    died half-way is not listed; its partition is overwritten by a retry. Writers of different
    runs do not wait for each other and all of them are kept.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")
    schemas = {name: df.schema.json() for name, df in tables.items()}
    _commit(next(iter(tables.values())).sparkSession, folder, run_id, "saved", schemas)


def _storage(spark: SparkSession, folder: str):
    """The folder as a path, and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, folder: str, run_id: str, event: str, schemas: dict[str, str] | None = None) -> int:
    """Put one event into the log under the next free number; the number.

    The file is written aside and renamed to its number, which fails if another writer took
    that number first: then the next one is tried. Numbers order events even if clocks agree
    or disagree. That no number is given twice rests on the storage's rename.
    """
    fs_package = spark._jvm.org.apache.hadoop.fs
    root, fs = _storage(spark, f"{folder}/{COMMITS}")
    fs.mkdirs(root)
    now = datetime.now(timezone.utc).isoformat()
    entry = json.dumps({"run_id": run_id, "event": event, "created_at": now, "schemas": schemas or {}})
    aside = fs_package.Path(root, f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(entry.encode()))
    finally:
        out.close()
    context = fs_package.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(fs_package, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    while True:
        names = [status.getPath().getName() for status in fs.listStatus(root)]
        number = 1 + max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(fs_package.Path(root, f"{number:020d}.json")), options)
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, event, created_at, event_no`` of all events, and the ``schemas`` of saved runs."""
    log = spark.read.schema(LOG_SCHEMA).json(f"{folder}/{COMMITS}")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)", 1).cast("long")
    return log.select("run_id", "event", F.to_timestamp("created_at").alias("created_at"), number.alias("event_no"), "schemas")


def read_run(spark: SparkSession, folder: str, table: str, run_id: str) -> DataFrame:
    """One run's table; the filter on the partition column prunes all other runs.
    A run that is not in the log, or was deleted, is empty."""
    log = run_log(spark, folder)
    own = F.col("run_id") == run_id
    saved = log.where((F.col("event") == "saved") & F.col("schemas").isNotNull())
    # The run's own schema, or that of the newest run that has the table.
    schema_of = F.try_element_at("schemas", F.lit(table))
    newest = saved.where(schema_of.isNotNull()).agg(F.max_by(schema_of, F.struct(own, "event_no"))).first()[0]
    reader = spark.read.option("basePath", f"{folder}/{table}")
    if newest is not None:
        schema = T.StructType.fromJson(json.loads(newest))
        reader = reader.schema(schema.add("run_id", T.StringType()) if "run_id" not in schema.names else schema)
    rows = reader.parquet(f"{folder}/{table}")
    alive = live_runs(log.where(own)).limit(1).count() > 0
    return rows.where(own & F.lit(alive))


def latest_run_id(spark: SparkSession, folder: str) -> str | None:
    row = live_runs(run_log(spark, folder)).agg(F.max_by("run_id", F.struct("created_at", "run_id"))).first()
    return row[0]


def delete_run(spark: SparkSession, folder: str, run_id: str) -> None:
    """Remove a run: first the event, so that no reader starts on it, then its files. A
    repeated call removes what an interrupted one left behind."""
    _commit(spark, folder, run_id, "deleted")
    root, fs = _storage(spark, folder)
    for status in fs.listStatus(root):  # one folder per table
        part = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), f"run_id={run_id}")
        if status.isDirectory() and not status.getPath().getName().startswith("_"):
            fs.delete(part, True)


def save_predictions(df: DataFrame, path: str) -> None:
    """One JSON object per line and prediction."""
    df.write.mode("overwrite").json(path)


def save_artifacts(run_id: str, predictions: DataFrame, metrics: DataFrame, config: dict, stage_times: dict, folder: str) -> None:
    """A run's assessment as CSV and parquet, metrics, configuration and times as JSON."""
    root = f"{folder}/run_id={run_id}"
    spark = predictions.sparkSession
    predictions.write.mode("overwrite").option("header", True).csv(f"{root}/predictions_csv")
    predictions.write.mode("overwrite").parquet(f"{root}/predictions")
    metrics.write.mode("overwrite").json(f"{root}/metrics")
    for name, values in (("config", config), ("stage_times", stage_times)):
        spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string").write.mode(
            "overwrite"
        ).json(f"{root}/{name}")


def export_formats(df: DataFrame, folder: str, order: str, sample: int = 10) -> None:
    """CSV, parquet, and a JSON sample of the first rows."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    df.orderBy(order).limit(sample).write.mode("overwrite").json(f"{folder}/json_sample")


def export_level(
    level: str,
    meters: DataFrame,
    transformers: DataFrame,
    barangays: DataFrame,
    barangay: str | None = None,
    transformer: str | None = None,
    risk_level: str | None = None,
) -> DataFrame:
    """Rows of a report: one level, filtered, highest score first."""
    if level == "transformer":
        wanted = {"barangay": barangay, "risk_level": risk_level}
        return filter_meters(transformers, **wanted).orderBy(F.desc("avg_anomaly_score"), "transformer_id")
    if level == "barangay":
        return filter_meters(barangays, barangay=barangay).orderBy(F.desc("avg_risk_score"), "barangay")
    if level == "meter":
        wanted = {"barangay": barangay, "transformer_id": transformer, "risk_level": risk_level}
        have = [c for c in EXPORT_COLUMNS if c in meters.columns]
        return filter_meters(meters, **wanted).select(*have).orderBy(F.desc("anomaly_score"), "meter_id")
    raise ValueError(f"unknown level {level!r}")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def feature(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A GeoJSON point feature as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")),
        {"ignoreNullFields": "false"},
    )


#: Properties of a transformer on the map.
TRANSFORMER_PROPERTIES = [
    "transformer_id",
    "barangay",
    "total_meters",
    "suspicious_meter_count",
    "avg_anomaly_score",
    "risk_level",
]


def transformer_features(transformers: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """One feature per row, so a large map is written in parts."""
    return transformers.select("transformer_id", feature(properties or TRANSFORMER_PROPERTIES).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """All features in one document, one row: for maps that a browser can hold. Larger ones
    are written in parts, see :func:`feature_collection_parts`."""
    ordered = F.array_sort(F.collect_list(F.struct("transformer_id", "feature")))
    texts = F.transform(ordered, lambda f: f["feature"])
    head, tail = F.lit('{"type":"FeatureCollection","features":['), F.lit("]}")
    return features.agg(F.concat(head, F.array_join(texts, ","), tail).alias("geojson"))


def feature_collection_parts(features: DataFrame) -> DataFrame:
    """``part, transformer_id, line``: the same document in lines, in the order of
    (part, transformer_id, line): opening, features, closing. Features are sorted by range,
    so a map of any size is written by many tasks; no line is longer than a feature."""
    first = features.agg(F.min(F.struct("transformer_id", "feature")).alias("f")).select("f.*")
    marked = with_scalars(features.select("transformer_id", "feature"), first)
    is_first = (F.col("transformer_id") == F.col("_g.transformer_id")) & (F.col("feature") == F.col("_g.feature"))
    lines = marked.select(
        F.lit(1).alias("part"),
        "transformer_id",
        F.when(is_first, F.col("feature")).otherwise(F.concat(F.lit(","), "feature")).alias("line"),
    )
    none = F.lit(None).cast(features.schema["transformer_id"].dataType).alias("transformer_id")
    ends = features.sparkSession.range(2).select(
        (F.col("id") * 2).cast("int").alias("part"),
        none,
        F.when(F.col("id") == 0, F.lit('{"type":"FeatureCollection","features":[')).otherwise(F.lit("]}")).alias("line"),
    )
    return ends.unionByName(lines).orderBy("part", "transformer_id", "line")


def write_feature_collection(features: DataFrame, path: str) -> None:
    """Text files whose contents in the order of their names are one GeoJSON document."""
    feature_collection_parts(features).select("line").write.mode("overwrite").text(path)


def transformers_with_meters(transformers: DataFrame, meters: DataFrame, shown: int = 10) -> DataFrame:
    """Meter count and the first ``shown`` meter ids per transformer; 0 and none if it has
    no meters. The rank filter is a group limit: a transformer's list never exceeds it."""
    from pyspark.sql import Window

    counts = meters.groupBy("transformer_id").agg(F.count("*").alias("meter_count"))
    order = Window.partitionBy("transformer_id").orderBy("meter_id")
    first = (
        meters.select("transformer_id", "meter_id")
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= shown)
        .groupBy("transformer_id")
        .agg(F.array_sort(F.collect_list("meter_id")).alias("meter_ids"))
    )
    id_type = T.ArrayType(meters.schema["meter_id"].dataType)
    joined = transformers.join(counts, "transformer_id", "left").join(first, "transformer_id", "left")
    return joined.select(
        *transformers.columns,
        F.coalesce("meter_count", F.lit(0)).alias("meter_count"),
        F.coalesce("meter_ids", F.array().cast(id_type)).alias("meter_ids"),
    )
