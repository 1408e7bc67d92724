"""CSV and parquet intake with declared types; NaN and blank cells become NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ampledger.functions.columns import nan_to_null
from ampledger.operators.reshape import MONTH_PREFIX, month_columns

TEXT, NUMBER, WHOLE = T.StringType(), T.DoubleType(), T.IntegerType()
METER_TYPES = {
    "meter_id": TEXT,
    "transformer_id": TEXT,
    "customer_class": TEXT,
    "barangay": TEXT,
    "barangay_id": WHOLE,
    "lat": NUMBER,
    "lon": NUMBER,
    "kVA": NUMBER,
}
TRANSFORMER_TYPES = {
    "transformer_id": TEXT,
    "feeder_id": TEXT,
    "barangay": TEXT,
    "lat": NUMBER,
    "lon": NUMBER,
    "capacity_kVA": NUMBER,
}
LABEL_TYPES = {"meter_id": TEXT, "anomaly_flag": WHOLE, "risk_band": TEXT, "anomaly_type": TEXT}
UPLOAD_REQUIRED = ["meter_id", "transformer_id", "kVA", "barangay_id"]
MIN_MONTHS = 6
FULL_YEAR = 12


def read_table(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """Read CSV (by its header) or parquet and give every known column its declared type.

    The header is one line; the data is scanned once, without type inference. Unknown
    columns stay text and month columns become numbers.
    """
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        text = T.StructType([T.StructField(c, TEXT) for c in header])
        # a file whose header differs is an error, not silently shifted columns
        raw = spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(path)

    def typed(name: str):
        c = F.col(f"`{name}`")
        wanted = NUMBER if name.startswith(MONTH_PREFIX) else types.get(name)
        if wanted is None:
            return c
        c = c.try_cast(wanted)
        return (nan_to_null(c) if wanted == NUMBER else c).alias(name)

    out = raw.select(*[typed(c) for c in raw.columns])
    if "customer_class" in out.columns:
        out = out.withColumn("customer_class", F.lower("customer_class"))
    return out


def read_meters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, METER_TYPES)


def read_transformers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRANSFORMER_TYPES)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of anomalous meters; a path that does not exist means no labels."""
    try:
        return read_table(spark, path, LABEL_TYPES)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        schema = T.StructType([T.StructField(c, t) for c, t in LABEL_TYPES.items()])
        return spark.createDataFrame([], schema)


def label_meters(meters: DataFrame, labels: DataFrame) -> DataFrame:
    """Every meter with its flag; a meter that is not listed is normal."""
    flags = labels.select("meter_id", "anomaly_flag")
    return meters.join(flags, "meter_id", "left").withColumn(
        "anomaly_flag", F.coalesce("anomaly_flag", F.lit(0))
    )


def dataset_metadata(labelled: DataFrame) -> DataFrame:
    """One row: meters, transformers, anomalies, rate, months and their span."""
    months = month_columns(labelled)
    counts = labelled.agg(
        F.count("*").alias("n_meters"),
        F.countDistinct("transformer_id").alias("n_transformers"),
        F.sum("anomaly_flag").alias("n_anomalies"),
        F.avg("anomaly_flag").alias("anomaly_rate"),
    )
    return counts.select(
        "*",
        F.lit(len(months)).alias("n_months"),
        F.lit(months[0][len(MONTH_PREFIX) :]).alias("first_month"),
        F.lit(months[-1][len(MONTH_PREFIX) :]).alias("last_month"),
    )


def check_upload(df: DataFrame) -> list[str]:
    """Month columns of an upload; an error if columns or months are missing (no job)."""
    missing = [c for c in UPLOAD_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    months = month_columns(df)
    if len(months) < MIN_MONTHS:
        raise ValueError(f"at least {MIN_MONTHS} months are needed, got {len(months)}")
    return months


def clean_upload(df: DataFrame) -> DataFrame:
    """Ids to text, unreadable or missing numbers to 0, absent columns to defaults."""
    months = check_upload(df)

    def number(c: str):
        clean = nan_to_null(F.col(c).try_cast("double"))
        return F.coalesce(clean, F.lit(0.0)).alias(c)

    ids = [F.col(c).cast("string").alias(c) for c in ("meter_id", "transformer_id")]
    numbers = [number(c) if c in df.columns else F.lit(0.0).alias(c) for c in ("lat", "lon", "kVA")]
    default_class = F.lit("residential")
    klass = F.coalesce(F.lower("customer_class"), default_class) if "customer_class" in df.columns else default_class
    done = {"meter_id", "transformer_id", "lat", "lon", "kVA", "customer_class", *months}
    rest = [c for c in df.columns if c not in done]
    return df.select(*ids, klass.alias("customer_class"), *numbers, *rest, *[number(c) for c in months])


def next_month(yyyymm: str) -> str:
    year, month = int(yyyymm[:4]), int(yyyymm[4:])
    return f"{year + month // 12}{month % 12 + 1:02d}"


def pad_months(wide: DataFrame, n: int = FULL_YEAR) -> DataFrame:
    """Append months after the last one, each a copy of it, until there are ``n`` columns.
    Gaps between months are not filled."""
    months = month_columns(wide)
    last, label = months[-1], months[-1][len(MONTH_PREFIX) :]
    added = []
    for _ in range(n - len(months)):
        label = next_month(label)
        added.append(F.col(last).alias(MONTH_PREFIX + label))
    return wide.select("*", *added)
