"""Queries: sources, validation, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.operators import quality as Q
from ampledger.operators import reshape as D
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views
from ampledger.session import scratch_path
from ampledger.sources import dataset, readers

MONTH_NAME = "'monthly_consumption_' || strftime(month, '%Y%m')"


def _csv(t, df: DataFrame, name: str) -> str:
    """Write ``df`` as CSV to a scratch folder and return its path."""
    path = scratch_path(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


# ---- sources --------------------------------------------------------------------


@query(
    "s1_read_meters_csv",
    views("sparse meters")
    + r6(
        """SELECT m.meter_id::VARCHAR AS meter_id, m.transformer_id::VARCHAR AS transformer_id, customer_class, lat, lon,
        5.0::DOUBLE + m.meter_id % 50 AS "kVA", count(kwh) AS n_months, coalesce(sum(kwh), 0) AS total_kwh
        FROM meters m LEFT JOIN sparse s ON s.meter_id = m.meter_id GROUP BY ALL""",
        'lat lon total_kwh "kVA"',
    ),
)
def s1(t):
    meters = readers.read_meters(t.spark, _csv(t, t.wide_meters(), "meters"))
    months = [F.col(c) for c in D.month_columns(meters)]
    values = F.array_compact(F.array(*months))
    return meters.select(
        "meter_id",
        "transformer_id",
        "customer_class",
        "lat",
        "lon",
        "kVA",
        F.size(values).cast("bigint").alias("n_months"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total_kwh"),
    )


@query(
    "s2_read_transformers_csv",
    views("txs")
    + r6(
        """SELECT transformer_id::VARCHAR AS transformer_id, feeder_id, barangay, lat, lon, capacity_kVA AS "capacity_kVA"
        FROM txs""",
        'lat lon "capacity_kVA"',
    ),
)
def s2(t):
    return readers.read_transformers(t.spark, _csv(t, t.transformer_table(), "transformers"))


@query(
    "s3_read_labels_csv",
    views("marked")
    + """SELECT c_custkey::VARCHAR AS meter_id, coalesce(anomaly_flag, 0)::INT AS anomaly_flag
        FROM customer LEFT JOIN marked ON meter_id = c_custkey""",
)
def s3(t):
    labels = readers.read_labels(t.spark, _csv(t, t.label_table(), "labels"))
    meters = t.sparse_meters().select(F.col("meter_id").cast("string"))
    return readers.label_meters(meters, labels).select("meter_id", "anomaly_flag")


@query(
    "s3_missing_labels",
    "SELECT c_custkey::VARCHAR AS meter_id, 0 AS anomaly_flag FROM customer",
)
def s3_missing(t):
    labels = readers.read_labels(t.spark, scratch_path(t.spark, "no-labels"))
    meters = t.sparse_meters().select(F.col("meter_id").cast("string"))
    return readers.label_meters(meters, labels)


@query(
    "s4_load_all_metadata",
    views("sparse wide marked")
    + r6(
        """SELECT count(*) AS n_meters, count(DISTINCT transformer_id) AS n_transformers,
        count(anomaly_flag) AS n_anomalies, count(anomaly_flag) / count(*)::DOUBLE AS anomaly_rate,
        (SELECT date_diff('month', min(month), max(month)) + 1 FROM sparse)::INT AS n_months,
        (SELECT strftime(min(month), '%Y%m') FROM sparse) AS first_month,
        (SELECT strftime(max(month), '%Y%m') FROM sparse) AS last_month
        FROM wide LEFT JOIN marked ON marked.meter_id = wide.meter_id""",
        "anomaly_rate",
    ),
)
def s4(t):
    meters = readers.read_meters(t.spark, _csv(t, t.wide_meters(), "meters"))
    labels = readers.read_labels(t.spark, _csv(t, t.label_table(), "labels"))
    return readers.dataset_metadata(readers.label_meters(meters, labels))


@query(
    "s5_upload_months",
    views("sparse")
    + f"""SELECT {MONTH_NAME} AS month_column, count(kwh) AS n_readings FROM (SELECT unnest(generate_series(
        (SELECT min(month) FROM sparse), (SELECT max(month) FROM sparse), INTERVAL 1 MONTH))::DATE AS month)
        LEFT JOIN sparse USING (month) GROUP BY month""",
)
def s5(t):
    upload = t.spark.read.option("header", True).csv(_csv(t, t.wide_meters(), "upload"))
    months = readers.check_upload(upload)
    counted = upload.agg(*[F.count(c).alias(c) for c in months])
    return counted.unpivot([], months, "month_column", "n_readings")


def weekday_upload(t) -> DataFrame:
    """An upload of seven columns (sums per weekday) with unreadable and absent cells."""
    day = F.date_format(F.make_date(F.lit(2024), F.dayofweek("o_orderdate"), F.lit(1)), "yyyyMM")
    sums = (
        t.table("orders")
        .groupBy(F.col("o_custkey").alias("meter_id"), day.alias("m"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("kwh"))
    )
    months = [f"2024{m:02d}" for m in range(1, 8)]
    pivoted = sums.groupBy("meter_id").pivot("m", months).agg(F.max("kwh"))
    wide = pivoted.select("meter_id", *[F.col(m).alias(D.MONTH_PREFIX + m) for m in months])
    meters = t.sparse_meters().select(
        "meter_id",
        "transformer_id",
        F.col("transformer_id").alias("barangay_id"),
        F.when(F.col("meter_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("lat").cast("string")).alias("lat"),
        F.when(F.col("meter_id") % 11 > 0, F.col("raw_score").cast("string")).alias("kVA"),
    )
    return meters.join(wide, "meter_id", "left")


WEEKDAYS = {
    "d": """SELECT o_custkey AS meter_id, dayofweek(o_orderdate) + 1 AS d, round(sum(o_totalprice), 2) AS kwh
        FROM orders GROUP BY ALL""",
    "up": f"""SELECT m.meter_id::VARCHAR AS meter_id, m.transformer_id::VARCHAR AS transformer_id,
        'residential' AS customer_class, CASE WHEN m.meter_id % 9 = 0 THEN 0 ELSE lat END AS lat, 0.0::DOUBLE AS lon,
        CASE WHEN m.meter_id % 11 > 0 THEN raw_score ELSE 0 END AS kva, m.transformer_id AS barangay_id,
        {', '.join(f"coalesce(max(kwh) FILTER (d = {i}), 0) AS monthly_consumption_2024{i:02d}" for i in range(1, 8))}
        FROM meters m LEFT JOIN d ON d.meter_id = m.meter_id GROUP BY ALL""",
}
WEEK_COLUMNS = [f"monthly_consumption_2024{i:02d}" for i in range(1, 13)]


@query(
    "s6_clean_upload",
    views("meters", WEEKDAYS) + r6("SELECT * FROM up", "lat lon kva " + " ".join(WEEK_COLUMNS[:7])),
)
def s6(t):
    upload = t.spark.read.option("header", True).csv(_csv(t, weekday_upload(t), "upload"))
    return readers.clean_upload(upload).withColumnRenamed("kVA", "kva").withColumn(
        "barangay_id", F.col("barangay_id").cast("int")
    )


@query(
    "s7_pad_months",
    views("meters", WEEKDAYS)
    + r6(
        "SELECT meter_id, "
        + ", ".join(WEEK_COLUMNS[:7])
        + ", "
        + ", ".join(f"{WEEK_COLUMNS[6]} AS {c}" for c in WEEK_COLUMNS[7:])
        + " FROM up",
        " ".join(WEEK_COLUMNS),
    ),
)
def s7(t):
    padded = readers.pad_months(readers.clean_upload(weekday_upload(t)))
    return padded.select("meter_id", *D.month_columns(padded))


# ---- validation -----------------------------------------------------------------

RULE_COLUMNS = "rule, severity, field, n_bad, sample"
ALLOWED = ["building", "machinery", "household"]


def _flat(issues: DataFrame) -> DataFrame:
    return issues.withColumn("sample", F.array_join("sample", ","))


def _rule_sql(rule: str, field: str, table: str, bad: str, key: str = "meter_id", severity: str = "critical") -> str:
    return f"""SELECT '{rule}' AS rule, '{severity}' AS severity, '{field}' AS field, count(*) AS n_bad,
        coalesce(array_to_string((list({key} ORDER BY {key}))[1:5], ','), '') AS sample
        FROM {table} WHERE {bad} HAVING count(*) > 0"""


@query(
    "v1_required_columns",
    """SELECT 'required_column' AS rule, 'critical' AS severity, unnest(['barangay', 'customer_class']) AS field,
        n_bad, '' AS sample FROM (SELECT count(*) AS n_bad FROM customer)""",
)
def v1(t):
    meters = t.meter_attributes().drop("barangay", "customer_class")
    return _flat(Q.schema_issues(meters, Q.REQUIRED_METER))


@query(
    "v2_column_types",
    """SELECT 'column_type' AS rule, 'critical' AS severity, 'kVA' AS field, count(*) AS n_bad, 'string' AS sample
        FROM customer UNION ALL SELECT 'column_type', 'warning', 'transformer_id', count(*), 'bigint' FROM customer""",
)
def v2(t):
    meters = t.meter_attributes().withColumn("kVA", F.col("kVA").cast("string"))
    meters = meters.withColumn("transformer_id", F.col("transformer_id").cast("long"))
    return _flat(Q.schema_issues(meters, [], ["lat", "lon", "kVA"], ["transformer_id", "customer_class"]))


@query(
    "v3_allowed_values",
    views("wide marked")
    + _rule_sql("allowed_values", "customer_class", "wide", "customer_class NOT IN ('building', 'machinery', 'household')")
    + " UNION ALL "
    + _rule_sql("allowed_values", "risk_band", "marked", "risk_band <> 'High'"),
)
def v3(t):
    classes = Q.check(t.meter_attributes(), [Q.in_set("customer_class", ALLOWED)], "meter_id")
    bands = Q.check(t.label_table(), [Q.in_set("risk_band", ["High"]), Q.in_set("anomaly_flag", [0, 1])], "meter_id")
    return _flat(classes.unionByName(bands))


@query(
    "v4_ranges",
    views("wide txs")
    + " UNION ALL ".join(
        [
            _rule_sql("allowed_values", "customer_class", "wide", "customer_class NOT IN ('residential', 'commercial', 'industrial')"),
            _rule_sql("range", "lat", "wide", "lat > 14.6"),
            _rule_sql("range", "kVA", "wide", '"kVA" > 40'),
            _rule_sql("range", "capacity_kVA", "txs", '"capacity_kVA" NOT BETWEEN 25 AND 1000', "transformer_id"),
        ]
    ),
)
def v4(t):
    limits = {"lat": (-90.0, 14.6), "kVA": (0.0, 40.0)}
    meters = Q.check(t.meter_attributes(), Q.meter_rules(limits, Q.CUSTOMER_CLASSES), "meter_id")
    stations = Q.check(t.transformer_table(), Q.transformer_rules(), "transformer_id")
    return _flat(meters.unionByName(stations))


@query(
    "v4_consumption_range",
    views("dense") + _rule_sql("range", "kwh", "dense", "kwh > 300"),
)
def v4_consumption(t):
    return _flat(Q.check(t.dense(), [Q.in_range("kwh", 0.0, 300.0)], "meter_id"))


@query("v5_not_null", views("gaps") + _rule_sql("not_null", "kwh", "gaps", "kwh IS NULL"))
def v5(t):
    return _flat(Q.check(t.gaps(), [Q.not_null("meter_id"), Q.not_null("kwh")], "meter_id"))


@query(
    "v6_duplicate_keys",
    """SELECT sum(k)::BIGINT AS n_bad, sum(k - 1)::BIGINT AS extra_copies, count(*) AS keys
        FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 1)""",
)
def v6(t):
    return Q.duplicate_keys(t.table("orders"), "o_custkey")


@query(
    "v7_dominant_values",
    views("gaps", {"w": "SELECT month, CASE WHEN kwh < 100 THEN 0.0 ELSE kwh END AS kwh FROM gaps WHERE kwh IS NOT NULL"})
    + r6(
        """SELECT strftime(month, '%Y%m%d') AS day, sum(k)::BIGINT AS n_values, max(k) AS n_top,
        max(k) / sum(k)::DOUBLE AS top_share FROM (SELECT month, kwh, count(*) AS k FROM w GROUP BY ALL)
        GROUP BY month HAVING sum(k) > 10 AND max(k) / sum(k) > 0.5""",
        "top_share",
    ),
)
def v7(t):
    coarse = t.gaps().withColumn("kwh", F.when(F.col("kwh") < 100, F.lit(0.0)).otherwise(F.col("kwh")))
    found = Q.dominant_values(coarse)
    return found.select(F.date_format("month", "yyyyMMdd").alias("day"), "n_values", "n_top", "top_share")


@query(
    "v8_zero_variance",
    views("sparse")
    + "SELECT meter_id, count(*) AS n_months FROM sparse GROUP BY 1 HAVING var_pop(floor(kwh / 5000)) = 0",
)
def v8(t):
    return Q.zero_variance(t.sparse().withColumn("kwh", F.floor(F.col("kwh") / 5000)))


@query(
    "v9_completeness",
    views("gaps")
    + r6(
        """SELECT count(*) * 4 AS total_cells, count(*) FILTER (kwh IS NULL) AS null_cells, 0::BIGINT AS empty_rows,
        count(*) FILTER (kwh IS NULL) / (count(*) * 4)::DOUBLE AS null_ratio,
        count(*) FILTER (kwh IS NULL) / (count(*) * 4)::DOUBLE > 0.1 AS too_many_nulls, FALSE AS has_empty_rows
        FROM gaps""",
        "null_ratio",
    ),
)
def v9(t):
    return Q.completeness(t.gaps())


@query(
    "v10_orphans",
    """SELECT doc_id AS orphan_id, count(*) AS n_rows FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
        GROUP BY 1""",
)
def v10(t):
    return Q.orphans(t.table("labels"), t.table("conversations"), "doc_id", "conv_id")


SERIES_TEXT = {
    "ser": """SELECT meter_id, '[' || string_agg(round(kwh)::BIGINT::VARCHAR, ', ' ORDER BY month) || ']' AS s,
        list(round(kwh)::BIGINT ORDER BY month) AS v FROM sparse GROUP BY meter_id""",
    "txt": """SELECT meter_id, CASE WHEN meter_id % 17 = 0 THEN NULL WHEN meter_id % 13 = 0 THEN 'invalid_data' ELSE s END AS s,
        v FROM ser""",
}


@query(
    "v11_serialised_arrays",
    views("sparse", SERIES_TEXT)
    + " UNION ALL ".join(
        [
            _rule_sql("array_format", "readings", "txt", "s IS NULL OR s = 'invalid_data'"),
            _rule_sql("array_length", "readings", "txt", "s LIKE '[%' AND len(v) <> 10"),
            _rule_sql("array_values", "readings", "txt", "s LIKE '[%' AND len(v) = 10 AND list_max(v) > 5000"),
        ]
    ),
)
def v11(t):
    points = F.array_sort(F.collect_list(F.struct("month", F.round("kwh").cast("bigint").alias("v"))))
    series = t.sparse().groupBy("meter_id").agg(F.transform(points, lambda p: p["v"].cast("string")).alias("v"))
    text = F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]"))
    damaged = F.when(F.col("meter_id") % 17 == 0, F.lit(None)).when(F.col("meter_id") % 13 == 0, F.lit("invalid_data"))
    damaged = F.when((F.col("meter_id") % 17 == 0) | (F.col("meter_id") % 13 == 0), damaged).otherwise(text)
    parsed = series.select("meter_id", damaged.alias("s")).select("meter_id", Q.parse_array("s").alias("readings"))
    return _flat(Q.check(parsed, Q.array_rules("readings", length=10, high=5000.0), "meter_id"))


VERDICT = """SELECT count(*) FILTER (severity = 'critical') = 0 AS is_valid,
    count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warnings"""


@query(
    "v12_verdict",
    views("wide", {"i": _rule_sql("allowed_values", "customer_class", "wide", "customer_class <> 'building'")
        + " UNION ALL " + _rule_sql("range", "kVA", "wide", '"kVA" > 40', severity="warning")
        + " UNION ALL SELECT 'required_column', 'critical', 'feeder_id', 1, ''"
        + " UNION ALL SELECT 'broken', 'critical', 'nowhere', 1, ''"})
    + VERDICT + " FROM i",
)
def v12(t):
    rules = [
        Q.in_set("customer_class", ["building"]),
        Q.in_range("kVA", 0.0, 40.0, Q.WARNING),
        Q.Rule("broken", F.col("nowhere") > 1, "nowhere"),
    ]
    return Q.verdict(Q.validate(t.meter_attributes(), rules, "meter_id", required=["meter_id", "feeder_id"]))


@query(
    "v12_failing_rule",
    views("wide", {"i": _rule_sql("allowed_values", "customer_class", "wide", "customer_class <> 'building'")
        + " UNION ALL " + _rule_sql("range", "kVA", "wide", '"kVA" > 40', severity="warning")
        + " UNION ALL SELECT 'rated', 'critical', 'kVA', 1, 'USER_RAISED_EXCEPTION'"
        + " UNION ALL SELECT 'parsed', 'critical', 'customer_class', 1, 'USER_RAISED_EXCEPTION'"
        + " UNION ALL SELECT 'broken', 'critical', 'nowhere', 1, 'AnalysisException'"})
    + "SELECT * FROM i",
)
def v12_failing(t):
    """Two rules that fail on some row, and one that names no column, beside two that work."""
    failing = F.when(F.col("kVA") > 40, F.raise_error("no rating").cast("boolean")).otherwise(F.lit(False))
    parsed = F.when(F.col("customer_class").isNotNull(), F.raise_error("not a number").cast("boolean"))
    rules = [
        Q.in_set("customer_class", ["building"]),
        Q.Rule("rated", failing, "kVA"),
        Q.in_range("kVA", 0.0, 40.0, Q.WARNING),
        Q.Rule("parsed", parsed, "customer_class"),
        Q.Rule("broken", F.col("nowhere") > 1, "nowhere"),
    ]
    return _flat(Q.validate(t.meter_attributes(), rules, "meter_id"))


def _dataset(t) -> str:
    """The three tables as CSV in one folder; the first transformers have lost their ids."""
    folder = scratch_path(t.spark, "dataset")
    known = F.when(F.col("transformer_id") > 2, F.col("transformer_id")).otherwise(-1 - F.col("transformer_id"))
    renamed = t.transformer_table().withColumn("transformer_id", known)
    for name, df in (
        (dataset.METERS, t.wide_meters()),
        (dataset.TRANSFORMERS, renamed),
        (dataset.LABELS, t.label_table()),
    ):
        df.write.option("header", True).csv(f"{folder}/{name}")
    return folder


def _count_sql(table: str, rule: str, field: str, source: str, bad: str, key: str = "", severity: str = "critical") -> str:
    """Findings of a table read from a file, where ids are text and sorted as such."""
    sample = f"coalesce(array_to_string((list({key}::VARCHAR ORDER BY {key}::VARCHAR))[1:5], ','), '')" if key else "''"
    return f"""SELECT '{table}' AS "table", '{rule}' AS rule, '{severity}' AS severity, '{field}' AS field, count(*) AS n_bad,
        {sample} AS sample FROM {source} WHERE {bad} HAVING count(*) > 0"""


SPAN = "(SELECT datediff('month', min(month), max(month)) + 1 FROM sparse)"


@query(
    "v12_validate_dataset",
    views(
        "wide txs sparse",
        {
            "flat": "SELECT meter_id FROM sparse GROUP BY 1 HAVING min(kwh) = max(kwh)",
            "counted": "SELECT month, kwh, count(*) AS k FROM sparse GROUP BY ALL",
            "dominated": "SELECT month FROM counted GROUP BY 1 HAVING sum(k) > 10 AND max(k) / sum(k) > 0.5",
        },
    )
    + " UNION ALL ".join(
        [
            _count_sql("meters", "allowed_values", "customer_class", "wide", "customer_class <> 'building'", "meter_id"),
            _count_sql("meters", "range", "kVA", "wide", '"kVA" > 40', "meter_id"),
            _count_sql("meters", "range", "kwh", "sparse", "kwh > 5000", "meter_id"),
            _count_sql("meters", "zero_variance", "kwh", "flat", "TRUE", "meter_id", "warning"),
            _count_sql("meters", "dominant_value", "kwh", "dominated", "TRUE", "", "warning"),
            _count_sql(
                "transformers", "range", "capacity_kVA", "txs", '"capacity_kVA" NOT BETWEEN 25 AND 1000',
                "CASE WHEN transformer_id > 2 THEN transformer_id ELSE -1 - transformer_id END",
            ),
            _count_sql("meters", "orphan", "transformer_id", "wide", "transformer_id <= 2"),
            f"""SELECT 'meters', 'completeness', 'warning', '*', (SELECT count(*) FROM wide) * {SPAN} - (SELECT count(*) FROM sparse), ''""",
        ]
    ),
)
def v12_dataset(t):
    limits = {"kVA": (0.0, 40.0), "consumption": (0.0, 5000.0)}
    issues = dataset.validate_dataset(t.spark, _dataset(t), limits, ["building"])
    return issues.select("table", "rule", "severity", "field", "n_bad", F.array_join("sample", ",").alias("sample"))


@query(
    "s4_load_all_readings",
    views("sparse wide marked")
    + r6(
        """SELECT meter_id::VARCHAR AS meter_id, count(*) FILTER (kwh > 0) AS n_readings, coalesce(sum(kwh), 0) AS total_kwh
        FROM wide LEFT JOIN sparse USING (meter_id) GROUP BY 1""",
        "total_kwh",
    ),
)
def s4_readings(t):
    readings = dataset.load_dataset(t.spark, _dataset(t))["readings"]
    return readings.groupBy("meter_id").agg(
        F.count_if(F.col("kwh_filled") > 0).alias("n_readings"), F.sum("kwh_filled").alias("total_kwh")
    )


@query(
    "v13_quality_report",
    views("gaps txs marked")
    + r6(
        """SELECT (SELECT count(*) FROM gaps) AS meter_rows, 4 AS meter_columns,
        (SELECT count(*) FILTER (kwh IS NULL) FROM gaps) AS meter_null_cells,
        (SELECT count(*) - count(DISTINCT meter_id) FROM gaps) AS meter_duplicate_ids,
        (SELECT count(*) FROM txs) AS transformer_rows, 6 AS transformer_columns, 0::BIGINT AS transformer_null_cells,
        0::BIGINT AS transformer_duplicate_ids, (SELECT count(*) FROM marked) AS anomalies,
        (SELECT count(*) FROM marked) / (SELECT count(*) FROM gaps)::DOUBLE AS anomaly_rate""",
        "anomaly_rate",
    ),
)
def v13(t):
    return Q.quality_report(t.gaps(), t.transformer_table(), t.label_table())


@query(
    "v13_distribution",
    r6(
        """SELECT c_mktsegment AS value, count(*) AS n, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share
        FROM customer GROUP BY 1""",
        "share",
    ),
)
def v13_distribution(t):
    return Q.distribution(t.table("customer"), "c_mktsegment")


@query(
    "v14_user_rule",
    views("wide") + _rule_sql("class_load", "kVA", "wide", """customer_class = 'building' AND "kVA" > 30""", severity="warning"),
)
def v14(t):
    rule = Q.Rule("class_load", (F.col("customer_class") == "building") & (F.col("kVA") > 30), "kVA", Q.WARNING)
    return _flat(Q.check(t.meter_attributes(), [rule], "meter_id"))


@query(
    "v15_custom_constraints",
    views("txs") + _rule_sql("range", "capacity_kVA", "txs", '"capacity_kVA" NOT BETWEEN 100 AND 500', "transformer_id"),
)
def v15(t):
    return _flat(Q.check(t.transformer_table(), Q.transformer_rules({"capacity_kVA": (100.0, 500.0)}), "transformer_id"))


@query(
    "v16_acceptance",
    views("wide txs marked sparse")
    + """SELECT (SELECT count(*) FROM wide) = 1500 AS meters_ok, (SELECT count(*) FROM txs) = 25 AS transformers_ok,
        FALSE AS months_ok, abs((SELECT count(*) FROM marked) / (SELECT count(*) FROM wide)::DOUBLE - 0.1) <= 0.02
        AS anomaly_rate_ok, FALSE AS no_nulls, TRUE AS transformers_known""",
)
def v16(t):
    expected = {"meters": 1500, "transformers": 25, "months": 12, "anomaly_rate": 0.1}
    return Q.acceptance(t.wide_meters(), t.transformer_table(), t.label_table(), expected)


# ---- reshaping ------------------------------------------------------------------


@query(
    "d1_wide_to_long",
    views("sparse")
    + r6(
        """SELECT c_custkey AS meter_id, strftime(cal.month, '%Y%m') AS month, s.kwh FROM customer,
        (SELECT unnest(generate_series((SELECT min(month) FROM sparse), (SELECT max(month) FROM sparse),
        INTERVAL 1 MONTH))::DATE AS month) cal LEFT JOIN sparse s ON s.meter_id = c_custkey AND s.month = cal.month""",
        "kwh",
    ),
)
def d1(t):
    long = D.to_long(t.wide_meters(), ["meter_id"])
    return long.select("meter_id", F.date_format("month", "yyyyMM").alias("month"), "kwh")


SERIES = """SELECT meter_id, string_agg(printf('%.0f', kwh), ',' ORDER BY month) AS series, count(*)::INT AS n
    FROM sparse GROUP BY meter_id"""


@query(
    "d2_monthly_series",
    views("sparse")
    + f"""SELECT c_custkey AS meter_id, coalesce(series, '') AS series, coalesce(n, 0)::INT AS n
        FROM customer LEFT JOIN ({SERIES}) ON meter_id = c_custkey""",
)
def d2(t):
    folded = D.monthly_series(t.wide_meters().select("meter_id", *D.month_columns(t.wide_meters())))
    texts = F.transform("monthly_consumptions", lambda x: F.format_string("%.0f", x))
    return folded.select("meter_id", F.array_join(texts, ",").alias("series"), F.size("monthly_consumptions").alias("n"))


@query(
    "d3_chart_points",
    views("sparse")
    + r6(
        """SELECT meter_id, (row_number() OVER w - 1)::INT AS position,
        strftime(make_date(2024, ((row_number() OVER w - 1) % 12 + 1)::BIGINT, 1), '%b') AS month_label, kwh, kwh / 0.9 AS kva
        FROM sparse WINDOW w AS (PARTITION BY meter_id ORDER BY month)""",
        "kwh kva",
    ),
)
def d3(t):
    wide = t.wide_meters()
    return D.chart_points(D.monthly_series(wide.select("meter_id", *D.month_columns(wide))))


@query(
    "d4_one_hot",
    "SELECT c_custkey AS meter_id, "
    + ", ".join(f"(lower(c_mktsegment) = '{c}')::INT AS customer_class_{c}" for c in ALLOWED)
    + " FROM customer",
)
def d4(t):
    return D.one_hot(t.sparse_meters().select("meter_id", "customer_class"), "customer_class", ALLOWED, others="ignore")


@query(
    "d5_label_encode",
    """SELECT c_custkey AS meter_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS customer_class_encoded
        FROM customer""",
)
def d5(t):
    coded = D.label_encode(t.sparse_meters().select("meter_id", "customer_class"), "customer_class")
    return coded.select("meter_id", "customer_class_encoded")


@query(
    "d6_feature_matrix",
    views("facts") + r6("SELECT meter_id, raw_score, lat, lon, mean_kwh, ratio FROM facts", "raw_score lat lon mean_kwh ratio"),
)
def d6(t):
    facts = t.facts()
    return facts.select("meter_id", *D.feature_columns(facts))


@query(
    "d7_check_features",
    views("facts")
    + """SELECT count(*) AS n_rows, (count(*) - count(ratio))::BIGINT AS null_cells, 0::BIGINT AS inf_cells, TRUE AS usable,
        count(*) > count(ratio) AS has_missing FROM facts""",
)
def d7(t):
    return D.check_features(t.facts(), ["raw_score", "ratio"])


@query(
    "d8_filter_meters",
    views("rmeters")
    + r6(
        """SELECT meter_id, anomaly_score FROM rmeters WHERE risk_level = 'HIGH' AND city_id = 'asia'""", "anomaly_score"
    ),
)
def d8(t):
    found = D.filter_meters(t.rollup_meters(), risk_level="HIGH", city_id="asia", barangay="all")
    return found.select("meter_id", "anomaly_score").orderBy(F.desc("anomaly_score"))


@query(
    "d9_filter_options",
    views("rmeters") + "SELECT DISTINCT barangay AS option FROM rmeters WHERE city_id = 'asia' AND trim(barangay) <> ''",
)
def d9(t):
    return D.filter_options(t.rollup_meters(), "barangay", "ASIA")
