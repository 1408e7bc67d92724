"""Queries: roll-ups, joins, sorts, exports, run history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampledger.operators import features as X
from ampledger.operators import rollup as A
from ampledger.operators import runs as H
from ampledger.operators.grouped import attach, with_scalars
from ampledger.operators.reshape import filter_meters
from ampledger.operators.risk import confidence, predictions
from ampledger.plans.modelling import FUSE, RATIO, RECENT, SEN, scored_for_display
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views
from ampledger.session import scratch_path
from ampledger.sources import geography, writers

LEVELS = """CASE WHEN {s} >= 0.7 THEN 'HIGH' WHEN {s} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"""
TX_SQL = f"""SELECT *, {LEVELS.format(s='avg_anomaly_score')} AS risk_level FROM (SELECT transformer_id,
    count(*) AS total_meters, avg(anomaly_score) AS avg_anomaly_score, arg_min(lat, meter_id) AS lat,
    arg_min(lon, meter_id) AS lon, arg_min(barangay, meter_id) AS barangay, arg_min(city_id, meter_id) AS city_id,
    sum(kva) AS capacity_kva, count(*) FILTER (risk_level = 'HIGH') AS suspicious_meter_count
    FROM rmeters GROUP BY transformer_id)"""
BRGY_SQL = """SELECT barangay, count(*) AS total_transformers, avg(avg_anomaly_score) AS avg_risk_score,
    avg(lat) AS lat, avg(lon) AS lon, arg_min(city_id, transformer_id) AS city_id,
    count(*) FILTER (risk_level = 'HIGH') AS high_risk_count FROM tx GROUP BY barangay"""
CITY_SQL = """SELECT city_id, sum(total_transformers)::BIGINT AS total_transformers, avg(avg_risk_score) AS avg_risk_score,
    avg(lat) AS lat, avg(lon) AS lon, sum(high_risk_count)::BIGINT AS high_risk_count,
    array_to_string(list_transform(string_split(replace(city_id, '_', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS city_name FROM brgy GROUP BY city_id"""
UP = {"tx": TX_SQL, "brgy": BRGY_SQL, "city": CITY_SQL}


@query(
    "a1_transformer_rollup",
    views(
        "rmeters rlong",
        UP
        | {
            "mm": """SELECT transformer_id, month, avg(kwh) AS m, quantile_cont(kwh, 0.5) AS d FROM rlong GROUP BY ALL""",
            "pr": """SELECT transformer_id, avg(m) AS avg_consumption, quantile_cont(d, 0.5) AS median_consumption
                FROM mm GROUP BY 1""",
        },
    )
    + r6(
        "SELECT tx.*, avg_consumption, median_consumption FROM tx LEFT JOIN pr USING (transformer_id)",
        "avg_anomaly_score lat lon capacity_kva avg_consumption median_consumption",
    ),
)
def a1(t):
    return A.transformers(t.rollup_meters(), t.rollup_long())


@query("a2_barangay_rollup", views("rmeters", UP) + r6("SELECT * FROM brgy", "avg_risk_score lat lon"))
def a2(t):
    return A.barangays(A.transformers(t.rollup_meters()))


@query("a3_city_rollup", views("rmeters", UP) + r6("SELECT * FROM city", "avg_risk_score lat lon"))
def a3(t):
    return A.cities(A.barangays(A.transformers(t.rollup_meters())))


@query(
    "a4_run_summary",
    views("rmeters", UP)
    + """SELECT count(*) AS total_meters, count(*) FILTER (risk_level = 'HIGH') AS high_risk_meters,
        (SELECT count(*) FROM tx) AS total_transformers,
        (SELECT count(*) FROM tx WHERE risk_level = 'HIGH') AS high_risk_transformers,
        (SELECT transformer_id FROM tx ORDER BY avg_anomaly_score DESC, transformer_id LIMIT 1)::BIGINT AS most_anomalous_transformer,
        (SELECT count(*) FROM brgy) AS total_barangays, (SELECT arg_max(barangay, avg_risk_score) FROM brgy) AS most_anomalous_barangay,
        (SELECT count(*) FROM city) AS total_cities, (SELECT arg_max(city_name, avg_risk_score) FROM city) AS most_anomalous_city
        FROM rmeters""",
)
def a4(t):
    meters = t.rollup_meters()
    tx = A.transformers(meters)
    districts = A.barangays(tx)
    return A.run_summary(meters, tx, districts, A.cities(districts))


@query(
    "a4_top_transformers",
    views("rmeters", UP)
    + r6(
        """SELECT transformer_id, barangay, avg_anomaly_score, suspicious_meter_count, risk_level FROM tx
        ORDER BY avg_anomaly_score DESC, transformer_id LIMIT 10""",
        "avg_anomaly_score",
    ),
)
def a4_top(t):
    return A.top_transformers(A.transformers(t.rollup_meters())).select(
        "transformer_id", "barangay", "avg_anomaly_score", "suspicious_meter_count", "risk_level"
    )


@query(
    "a5_suspicion_by_transformer",
    views("dense", RATIO | RECENT | SEN)
    + r6(
        """SELECT *, suspicious_count / total_meters::DOUBLE AS suspicion_rate FROM (SELECT transformer_id,
        count(*) FILTER (ratio < 1.1 AND trend < 0) AS suspicious_count, count(*) AS total_meters,
        avg(ratio) AS avg_ratio, avg(trend) AS avg_trend FROM ratios LEFT JOIN sen USING (meter_id) GROUP BY 1)
        WHERE suspicious_count / total_meters > 0.2""",
        "avg_ratio avg_trend suspicion_rate",
    ),
)
def a5(t):
    long = t.dense(keep=True)
    ratios = X.consumption_ratio(long, X.transformer_baseline(long))
    both = ratios.join(X.meter_trend(long), "meter_id", "left")
    return A.suspicion_by_transformer(both, "ratio", "trend", max_ratio=1.1, max_trend=0.0)


@query(
    "a6_value_counts",
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
)
def a6(t):
    return A.value_counts(t.table("part"), "p_brand", 5)


@query(
    "a7_class_means",
    views("sparse meters")
    + r6(
        """SELECT customer_class, avg(m) AS mean_kwh FROM (SELECT customer_class, month, avg(kwh) AS m
        FROM sparse JOIN meters USING (meter_id) GROUP BY ALL) GROUP BY 1""",
        "mean_kwh",
    ),
)
def a7(t):
    classes = t.sparse_meters().select("meter_id", "customer_class")
    return A.class_means(t.sparse().join(classes, "meter_id"))


@query(
    "a8_city_districts",
    views("rmeters")
    + """SELECT city_id, array_to_string(list_sort(list(DISTINCT barangay)), ',') AS barangays,
        count(DISTINCT barangay) AS n_barangays FROM rmeters GROUP BY 1""",
)
def a8(t):
    return A.city_districts(t.rollup_meters()).withColumn("barangays", F.array_join("barangays", ","))


@query(
    "a9_city_risk",
    views("rmeters")
    + """SELECT *, CASE WHEN n_high / n_meters::DOUBLE > 0.3 THEN '#EF4444' WHEN n_high / n_meters::DOUBLE > 0.1
        THEN '#F59E0B' ELSE '#10B981' END AS colour FROM (SELECT city_id, count(*) FILTER (risk_level = 'HIGH') AS n_high,
        count(*) FILTER (risk_level = 'MEDIUM') AS n_medium, count(*) FILTER (risk_level = 'LOW') AS n_low,
        count(*) AS n_meters FROM rmeters WHERE city_id <> 'asia' GROUP BY 1)""",
)
def a9(t):
    return A.city_risk(t.rollup_meters(), t.geography().where("city_id != 'asia'"))


@query(
    "a10_city_list",
    views("rmeters", UP)
    + """SELECT city_id, city_name, total_transformers, CASE WHEN high_risk_count > 5 THEN 'high'
        WHEN high_risk_count > 2 THEN 'medium' ELSE 'low' END AS risk_level,
        (SELECT count(*) FROM rmeters r WHERE r.city_id = city.city_id) AS total_meters FROM city""",
)
def a10(t):
    meters = t.rollup_meters()
    return A.city_list(A.cities(A.barangays(A.transformers(meters))), meters)


@query(
    "a11_series_summary",
    views("dense")
    + r6(
        """SELECT meter_id, floor(avg(kwh) + 0.5)::BIGINT AS avg_consumption, max(kwh) AS peak_consumption,
        arg_max(kwh, month) AS last_month, (count(*) FILTER (kwh > 1.3 * m))::INT AS months_above
        FROM (SELECT *, avg(kwh) OVER (PARTITION BY meter_id) AS m FROM dense) GROUP BY meter_id""",
        "peak_consumption last_month",
    ),
)
def a11(t):
    points = F.array_sort(F.collect_list(F.struct("month", "kwh")))
    series = t.dense().groupBy("meter_id").agg(F.transform(points, lambda p: p["kwh"]).alias("monthly_consumptions"))
    return A.series_summary(series)


@query(
    "a12_table_statistics",
    views("sparse")
    + r6(
        """SELECT avg(kwh) AS mean, stddev_pop(kwh) AS std, min(kwh) AS min, max(kwh) AS max,
        quantile_cont(kwh, 0.5) AS median FROM sparse""",
        "mean std min max median",
    ),
)
def a12(t):
    return A.table_statistics(t.sparse(keep=True), "kwh")


@query(
    "a12_bounds",
    views("meters")
    + r6(
        """SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
        count(DISTINCT transformer_id) AS n_transformers, count(DISTINCT customer_class) AS n_classes FROM meters""",
        "lat_min lat_max lon_min lon_max",
    ),
)
def a12_bounds(t):
    return A.bounds(t.sparse_meters())


@query(
    "a13_mostly_zero",
    views("gaps")
    + """SELECT meter_id, count(*) FILTER (kwh IS NULL) AS zero_months, count(*) AS n_months FROM gaps GROUP BY 1
        HAVING count(*) FILTER (kwh IS NULL) > 0.1 * count(*)""",
)
def a13(t):
    return A.mostly_zero(t.gaps().withColumn("kwh", F.coalesce("kwh", F.lit(0.0))), 0.1)


@query(
    "a14_ambiguous_names",
    """SELECT p_name AS barangay, count(DISTINCT p_brand) AS n_cities FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""",
)
def a14(t):
    places = t.table("part").select(F.col("p_name").alias("barangay"), F.col("p_brand").alias("city_id"))
    return A.ambiguous_names(places)


# ---- joins, sorts, sets ---------------------------------------------------------


@query(
    "j1_left_join_predictions",
    views("meters facts", FUSE)
    + r6(
        f"""SELECT m.meter_id, m.customer_class, s.iso AS anomaly_score, {LEVELS.format(s='s.iso')} AS risk_level
        FROM meters m LEFT JOIN
            (SELECT CASE WHEN meter_id % 3 = 0 THEN -meter_id ELSE meter_id END AS meter_id, iso FROM sc) s USING (meter_id)""".replace(
            LEVELS.format(s="s.iso"), f"CASE WHEN s.iso IS NOT NULL THEN {LEVELS.format(s='s.iso')} END"
        ),
        "anomaly_score",
    ),
)
def j1(t):
    # Every third prediction belongs to a meter that is not in the table.
    key = F.when(F.col("meter_id") % 3 == 0, -F.col("meter_id")).otherwise(F.col("meter_id"))
    predicted = predictions(scored_for_display(t)).select(key.alias("meter_id"), "anomaly_score", "risk_level")
    return t.sparse_meters().select("meter_id", "customer_class").join(predicted, "meter_id", "left")


@query(
    "j2_anti_join",
    """SELECT c_custkey AS meter_id FROM customer WHERE c_custkey NOT IN
        (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def j2(t):
    meters = t.sparse_meters().select("meter_id")
    active = t.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("meter_id"))
    return meters.join(active, "meter_id", "left_anti")


@query(
    "j3_membership",
    views("marked") + """SELECT c_custkey AS meter_id, (c_custkey IN (SELECT meter_id FROM marked))::INT AS truth FROM customer""",
)
def j3(t):
    truth = t.label_table().select("meter_id", F.lit(1).alias("truth"))
    meters = t.sparse_meters().select("meter_id")
    return meters.join(truth, "meter_id", "left").withColumn("truth", F.coalesce("truth", F.lit(0)))


DISTRICT_VALUES = "(VALUES " + ", ".join(
    f"({i}, '{city}', '{name}')" for city, names in geography.DISTRICTS.items() for i, name in names.items()
) + ") v(id, city_id, barangay)"


@query(
    "j4_district_lookup",
    f"""SELECT c_custkey AS meter_id, coalesce(city_id, 'unknown') AS city_id, coalesce(barangay, 'Unknown') AS barangay
        FROM customer LEFT JOIN {DISTRICT_VALUES} ON id = (c_custkey % 60)""",
)
def j4(t):
    meters = t.sparse_meters().select("meter_id", (F.col("meter_id") % 60).cast("int").alias("barangay_id"))
    places = F.broadcast(geography.districts(t.spark))
    found = meters.join(places, "barangay_id", "left")
    return found.select(
        "meter_id",
        F.coalesce("city_id", F.lit("unknown")).alias("city_id"),
        F.coalesce("barangay", F.lit("Unknown")).alias("barangay"),
    )


@query(
    "j5_group_statistics",
    views("meters")
    + r6(
        """SELECT meter_id, avg(raw_score) OVER (PARTITION BY transformer_id) AS group_mean,
        count(*) OVER (PARTITION BY transformer_id) AS group_size FROM meters""",
        "group_mean",
    ),
)
def j5(t):
    meters = t.sparse_meters()
    stats = meters.groupBy("transformer_id").agg(
        F.avg("raw_score").alias("group_mean"), F.count("*").alias("group_size")
    )
    return attach(meters.select("meter_id", "transformer_id"), stats, ["transformer_id"]).drop("transformer_id")


@query(
    "t1_sort_meters",
    views("rmeters") + r6("SELECT meter_id, barangay, risk_level, anomaly_score FROM rmeters", "anomaly_score"),
)
def t1(t):
    return t.rollup_meters().select("meter_id", "barangay", "risk_level", "anomaly_score").orderBy(
        F.desc("anomaly_score"), "meter_id"
    )


@query(
    "t2_top_and_bottom",
    views("dense")
    + r6(
        """SELECT * FROM (SELECT 'highest' AS part, meter_id, stddev_pop(kwh) AS std FROM dense GROUP BY 2
        ORDER BY std DESC, meter_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'lowest' AS part, meter_id,
        stddev_pop(kwh) AS std FROM dense GROUP BY 2 ORDER BY std, meter_id LIMIT 10)""",
        "std",
    ),
)
def t2(t):
    std = t.dense().groupBy("meter_id").agg(F.stddev_pop("kwh").alias("std"))
    high = std.orderBy(F.desc("std"), "meter_id").limit(5).select(F.lit("highest").alias("part"), "*")
    low = std.orderBy("std", "meter_id").limit(10).select(F.lit("lowest").alias("part"), "*")
    return high.unionByName(low)


@query(
    "u1_set_difference",
    "SELECT doc_id AS missing_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def u1(t):
    listed = t.table("labels").select("doc_id")
    known = t.table("documents").select("doc_id").distinct()
    return known.join(listed, "doc_id", "left_anti").withColumnRenamed("doc_id", "missing_id")


@query(
    "u2_union_of_batches",
    "SELECT o_orderstatus AS batch, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1",
)
def u2(t):
    path = scratch_path(t.spark, "batches")
    t.table("orders").withColumnRenamed("o_orderstatus", "batch").write.partitionBy("batch").parquet(path)
    whole = t.spark.read.parquet(path)
    return whole.groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


# ---- sinks and exports ----------------------------------------------------------


@query(
    "s8_save_artifacts",
    views("rmeters") + r6("SELECT meter_id::VARCHAR AS meter_id, risk_level, anomaly_score FROM rmeters", "anomaly_score"),
)
def s8(t):
    folder = scratch_path(t.spark, "artifacts")
    meters = t.rollup_meters().select("meter_id", "risk_level", "anomaly_score")
    metrics = confidence(meters)
    writers.save_artifacts("run-1", meters, metrics, {"contamination": 0.12}, {"load": 0.1}, folder)
    back = t.spark.read.option("header", True).csv(f"{folder}/run_id=run-1/predictions_csv")
    return back.select("meter_id", "risk_level", F.col("anomaly_score").cast("double").alias("anomaly_score"))


@query(
    "s9_save_predictions",
    views("rmeters") + r6("SELECT meter_id, risk_level, anomaly_score FROM rmeters", "anomaly_score"),
)
def s9(t):
    path = scratch_path(t.spark, "predictions")
    writers.save_predictions(t.rollup_meters().select("meter_id", "risk_level", "anomaly_score"), path)
    return t.spark.read.schema("meter_id bigint, risk_level string, anomaly_score double").json(path)


@query(
    "s10_export_level",
    views("rmeters")
    + r6(
        """SELECT meter_id::VARCHAR AS meter_id, transformer_id::VARCHAR AS transformer_id, barangay, customer_class,
        lat, lon, anomaly_score, risk_level FROM rmeters WHERE risk_level = 'HIGH' AND barangay = 'NATION_3'""",
        "lat lon anomaly_score",
    ),
)
def s10(t):
    meters = t.rollup_meters()
    tx = A.transformers(meters)
    report = writers.export_level("meter", meters, tx, A.barangays(tx), barangay="NATION_3", risk_level="HIGH")
    path = scratch_path(t.spark, "report")
    writers.write_report(report, path)
    back = t.spark.read.option("header", True).csv(path)
    doubles = ("lat", "lon", "anomaly_score")
    return back.select(*[F.col(c).cast("double").alias(c) if c in doubles else F.col(c) for c in back.columns])


@query(
    "s11_export_formats",
    """SELECT (SELECT count(*) FROM customer) AS csv_rows, (SELECT count(*) FROM customer) AS parquet_rows,
        (SELECT least(10, count(*)) FROM customer) AS json_rows""",
)
def s11(t):
    folder = scratch_path(t.spark, "formats")
    writers.export_formats(t.table("customer"), folder, "c_custkey")
    read = t.spark.read
    counts = read.option("header", True).csv(f"{folder}/csv").agg(F.count("*").alias("csv_rows"))
    counts = with_scalars(counts, read.parquet(f"{folder}/parquet").agg(F.count("*").alias("parquet_rows")), "_p")
    counts = with_scalars(counts, read.json(f"{folder}/json_sample").agg(F.count("*").alias("json_rows")), "_j")
    return counts.select("csv_rows", "_p.parquet_rows", "_j.json_rows")


GEO = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"transformer_id":'
    || transformer_id || ',"barangay":"' || barangay || '","total_meters":' || total_meters || ',"suspicious_meter_count":'
    || suspicious_meter_count || ',"risk_level":"' || risk_level || '"}}'"""
GEO_ROWS = "SELECT *, (lon * 10000)::BIGINT AS x, (lat * 10000)::BIGINT AS y FROM tx"


def _map(t):
    """Transformers on a whole-number grid, so that both engines print them alike."""
    tx = A.transformers(t.rollup_meters())
    return tx.withColumn("lon", F.round(F.col("lon") * 10000).cast("bigint")).withColumn(
        "lat", F.round(F.col("lat") * 10000).cast("bigint")
    )


GEO_PROPERTIES = ["transformer_id", "barangay", "total_meters", "suspicious_meter_count", "risk_level"]


@query(
    "s12_geojson_features",
    views("rmeters", UP | {"g": GEO_ROWS}) + f"SELECT transformer_id, {GEO} AS feature FROM g",
)
def s12(t):
    return writers.transformer_features(_map(t), GEO_PROPERTIES)


@query(
    "s12_geojson_collection",
    views("rmeters", UP | {"g": GEO_ROWS})
    + f"""SELECT '{{"type":"FeatureCollection","features":[' || string_agg({GEO}, ',' ORDER BY transformer_id) || ']}}'
        AS geojson FROM g""",
)
def s12_collection(t):
    return writers.feature_collection(writers.transformer_features(_map(t), GEO_PROPERTIES))


@query(
    "s13_transformers_with_meters",
    """SELECT n_nationkey::BIGINT AS transformer_id, count(s_suppkey) AS meter_count,
        coalesce(array_to_string((list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL))[1:10], ','), '') AS meter_ids
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def s13(t):
    stations = t.table("nation").select(F.col("n_nationkey").cast("long").alias("transformer_id"))
    meters = t.table("supplier").select(
        F.col("s_suppkey").alias("meter_id"), F.col("s_nationkey").cast("long").alias("transformer_id")
    )
    joined = writers.transformers_with_meters(stations, meters)
    return joined.withColumn("meter_ids", F.array_join("meter_ids", ","))


#: All values of the segment column, in the order in which their runs are stored.
SEGMENTS = ("building", "furniture", "automobile", "household", "machinery")


def _stored_runs(t) -> str:
    """The meters of each segment stored as a run, then one run deleted."""
    folder = scratch_path(t.spark, "runs")
    meters = t.rollup_meters()
    for name in SEGMENTS:
        chosen = filter_meters(meters, customer_class=name)
        writers.save_run(name, {"meters": chosen, "transformers": A.transformers(chosen)}, folder)
    writers.delete_run(t.spark, folder, "furniture")
    return folder


@query("s14_list_runs", """SELECT lower(c_mktsegment) AS run_id,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 4 END AS position,
    count(*) AS n_meters FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY c_mktsegment""")
def s14_list(t):
    folder = _stored_runs(t)
    listed = H.list_runs(writers.run_log(t.spark, folder), 10)
    order = F.row_number().over(Window.orderBy(F.desc("created_at")))
    stored = t.spark.read.parquet(f"{folder}/meters").groupBy("run_id").agg(F.count("*").alias("n_meters"))
    return listed.withColumn("position", order).join(stored, "run_id").select("run_id", "position", "n_meters")


@query(
    "s14_read_run",
    views("rmeters")
    + r6("SELECT meter_id, risk_level, anomaly_score FROM rmeters WHERE customer_class <> 'furniture'", "anomaly_score"),
)
def s14_read(t):
    folder = _stored_runs(t)
    runs = [writers.read_run(t.spark, folder, "meters", name) for name in SEGMENTS]  # the deleted one is empty
    return reduce(DataFrame.unionByName, runs).select("meter_id", "risk_level", "anomaly_score")


# ---- model versions -------------------------------------------------------------

VERSIONS = """SELECT o_orderkey AS model_id, o_orderpriority AS model_type, o_orderdate AS registered_at,
    CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' ELSE 'development' END AS deployment_stage,
    CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS accuracy, o_totalprice / 2 AS recall,
    o_orderkey % 2 = 0 AS has_even, o_custkey % 3 = 0 AS has_third FROM orders"""


def versions(t) -> DataFrame:
    """Orders as model versions: stage from status, metrics from price, tags from keys."""
    accuracy = F.struct(F.lit("accuracy").alias("k"), F.col("o_totalprice").alias("v"))
    recall = F.struct(F.lit("recall").alias("k"), (F.col("o_totalprice") / 2).alias("v"))
    stage = F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "staging")
    return t.table("orders").select(
        F.col("o_orderkey").alias("model_id"),
        F.col("o_orderpriority").alias("model_type"),
        F.lit(1).alias("version"),
        F.col("o_orderdate").alias("registered_at"),
        stage.otherwise("development").alias("deployment_stage"),
        F.map_from_entries(
            F.array_compact(F.array(F.when(F.col("o_orderkey") % 4 > 0, accuracy), recall))
        ).alias("performance_metrics"),
        F.array_compact(
            F.array(
                F.when(F.col("o_orderkey") % 2 == 0, F.lit("even")), F.when(F.col("o_custkey") % 3 == 0, F.lit("third"))
            )
        ).alias("tags"),
    )


@query(
    "h1_latest_version",
    f"""SELECT model_id, model_type FROM ({VERSIONS}) WHERE deployment_stage = 'production' AND has_even AND has_third
        AND coalesce(accuracy, 0) >= 100000 ORDER BY registered_at DESC, model_id DESC LIMIT 1""",
)
def h1(t):
    found = H.latest_version(versions(t), stage="production", tags=("even", "third"), min_metrics={"accuracy": 100_000.0})
    return found.select("model_id", "model_type")


@query(
    "h2_list_versions",
    f"""SELECT model_id, deployment_stage, strftime(registered_at, '%Y%m%d') AS day FROM ({VERSIONS})
        WHERE model_type = '5-LOW' AND has_even""",
)
def h2(t):
    found = H.find_versions(versions(t), model_type="5-LOW", tags=("even",))
    return found.select("model_id", "deployment_stage", F.date_format("registered_at", "yyyyMMdd").alias("day"))


@query(
    "h3_compare_versions",
    r6(
        f"""SELECT model_id, accuracy, recall, NULL::DOUBLE AS f1 FROM ({VERSIONS}) WHERE model_id IN (1, 2, 4, 8, -5)""",
        "accuracy recall f1",
    ),
)
def h3(t):
    return H.compare_versions(versions(t), [1, 2, 4, 8, -5], ["accuracy", "recall", "f1"])


@query(
    "h4_retention",
    f"""SELECT model_id, model_type, deployment_stage FROM (SELECT *, count(*) FILTER (deployment_stage = 'production')
        OVER (PARTITION BY model_type) AS prod, row_number() OVER (PARTITION BY model_type, deployment_stage = 'production'
        ORDER BY registered_at DESC, model_id DESC) AS rn FROM ({VERSIONS}))
        WHERE deployment_stage = 'production' OR rn <= greatest(0, 1200 - prod)""",
)
def h4(t):
    return H.retained(versions(t), 1200).select("model_id", "model_type", "deployment_stage")


@query(
    "h5_current_state",
    """WITH e AS (SELECT user_id AS model_id, event_id AS n, event_type, value FROM events),
        s AS (SELECT model_id, arg_max(CASE WHEN value > 40 THEN 'production' ELSE 'staging' END, n) AS stage, max(n) AS last_n
        FROM e WHERE event_type <> 'error' GROUP BY 1),
        d AS (SELECT model_id, max(n) AS any_delete, max(n) FILTER (value > 60) AS forced FROM e WHERE event_type = 'error' GROUP BY 1)
        SELECT model_id, stage FROM s LEFT JOIN d USING (model_id)
        WHERE NOT coalesce(CASE WHEN stage = 'production' THEN forced ELSE any_delete END > last_n, FALSE)""",
)
def h5(t):
    log = t.table("events").select(
        F.col("user_id").alias("model_id"),
        F.col("event_id").alias("event_time"),
        F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("stage")).alias("event"),
        F.when(F.col("value") > 40, F.lit("production")).otherwise(F.lit("staging")).alias("stage"),
        (F.col("value") > 60).alias("force"),
    )
    return H.current_state(log)
