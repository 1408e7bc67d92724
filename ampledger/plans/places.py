"""Queries: distances, clustering, cities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampledger.functions.columns import distance
from ampledger.operators import quality as Q
from ampledger.operators import spatial as G
from ampledger.operators.nearest import nearest_place
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views
from ampledger.sources import geography

EPS, MIN_SAMPLES = 400.0, 4


def hav(a: str, b: str) -> str:
    return (
        f"2 * 6371000.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + "
        f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def _distance_sql(expr: str) -> str:
    return views("meters", {"o": "SELECT * FROM meters WHERE meter_id = (SELECT min(meter_id) FROM meters)"}) + r6(
        f"SELECT a.meter_id, {expr} AS d FROM meters a, o", "d"
    )


def _from_first(t, metric):
    meters = t.sparse_meters()
    first = meters.agg(F.min_by(F.struct("lat", "lon"), "meter_id").alias("p")).select("p.*").first()
    d = distance(metric, F.lit(first.lat), F.lit(first.lon), F.col("lat"), F.col("lon"))
    return meters.select("meter_id", d.alias("d"))


@query("g1_haversine", _distance_sql(hav("o", "a")))
def g1(t):
    return _from_first(t, "haversine")


@query("g1_euclidean", _distance_sql("sqrt(pow(a.lat - o.lat, 2) + pow(a.lon - o.lon, 2))"))
def g1_euclidean(t):
    return _from_first(t, "euclidean")


@query("g1_manhattan", _distance_sql("abs(a.lat - o.lat) + abs(a.lon - o.lon)"))
def g1_manhattan(t):
    return _from_first(t, "manhattan")


@query("g1_chebyshev", _distance_sql("greatest(abs(a.lat - o.lat), abs(a.lon - o.lon))"))
def g1_chebyshev(t):
    return _from_first(t, "chebyshev")


def cluster_views(near: str, min_samples: int = MIN_SAMPLES) -> dict[str, str]:
    """Clusters by pairwise distances and the closure of core links."""
    return {
        "nb": f"SELECT a.meter_id AS a, b.meter_id AS b FROM meters a JOIN meters b ON {near}",
        "core": f"SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {min_samples}",
        "links": "SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)",
        "reach": "SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b",
        "roots": "SELECT a AS id, min(b) AS root FROM reach GROUP BY a",
        "numbered": "SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots",
        "border": """SELECT a AS id, min(cluster) AS cluster FROM nb JOIN numbered ON numbered.id = nb.b
            WHERE a NOT IN (SELECT id FROM core) GROUP BY a""",
        "lab": """SELECT m.meter_id, m.lat, m.lon, coalesce(n.cluster, b.cluster, -1)::INT AS cluster,
            n.id IS NOT NULL AS is_core FROM meters m LEFT JOIN numbered n ON n.id = m.meter_id
            LEFT JOIN border b ON b.id = m.meter_id""",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


#: Meters moved around the globe, in SQL that both engines read.
MOVED = {
    "antimeridian": ("lat", "CASE WHEN lon + 58.95 > 180 THEN lon + 58.95 - 360 ELSE lon + 58.95 END"),
    "pole": ("90 - sqrt(pow(lat - 14.55, 2) + pow(lon - 121.05, 2))", "degrees(atan2(lon - 121.05, lat - 14.55))"),
}


def moved_clusters(where: str) -> str:
    lat, lon = MOVED[where]
    pairs = {k: v.replace(" meters ", " moved ") for k, v in cluster_views(f"{hav('a', 'b')} <= {EPS}").items()}
    moved = {"moved": f"SELECT meter_id, {lat} AS lat, {lon} AS lon FROM meters"}
    return recursive(views("meters", moved | pairs)) + "SELECT meter_id, cluster, is_core FROM lab"


CLUSTERS = recursive(views("meters", cluster_views(f"{hav('a', 'b')} <= {EPS}")))


def clustered(t):
    return G.dbscan(t.sparse_meters(), EPS, MIN_SAMPLES)


@query("g2_dbscan", CLUSTERS + "SELECT meter_id, cluster, is_core FROM lab")
def g2(t):
    return clustered(t).select("meter_id", "cluster", "is_core")


def clustered_elsewhere(t, where):
    lat, lon = MOVED[where]
    moved = t.sparse_meters().select("meter_id", F.expr(lat).alias("lat"), F.expr(lon).alias("lon"))
    return G.dbscan(moved, EPS, MIN_SAMPLES).select("meter_id", "cluster", "is_core")


@query("g2_dbscan_antimeridian", moved_clusters("antimeridian"))
def g2_antimeridian(t):
    return clustered_elsewhere(t, "antimeridian")


@query("g2_dbscan_pole", moved_clusters("pole"))
def g2_pole(t):
    return clustered_elsewhere(t, "pole")


@query(
    "g2_dbscan_euclidean",
    recursive(
        views("meters", cluster_views("sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 0.00351", 5))
    )
    + "SELECT meter_id, cluster FROM lab",
)
def g2_euclidean(t):
    return G.dbscan(t.sparse_meters(), 0.00351, 5, metric="euclidean").select("meter_id", "cluster")


TABLE_SQL = """SELECT cluster, count(*) AS size, avg(lat) AS center_lat, avg(lon) AS center_lon, count(*) <= 10 AS is_small
    FROM lab WHERE cluster >= 0 GROUP BY cluster"""


@query("g3_cluster_table", CLUSTERS + r6(TABLE_SQL, "center_lat center_lon"))
def g3(t):
    return G.cluster_table(clustered(t))


@query(
    "g4_cluster_statistics",
    CLUSTERS
    + r6(
        f"""SELECT *, n_noise / n_points::DOUBLE AS noise_rate, (n_noise + n_small_members) / n_points::DOUBLE AS anomaly_rate
        FROM (SELECT (SELECT count(*) FROM lab) AS n_points, count(*) AS n_clusters,
        (SELECT count(*) FROM lab WHERE cluster = -1) AS n_noise, count(*) FILTER (is_small) AS n_small_clusters,
        coalesce(sum(size) FILTER (is_small), 0)::BIGINT AS n_small_members FROM ({TABLE_SQL}))""",
        "noise_rate anomaly_rate",
    ),
)
def g4(t):
    return G.cluster_statistics(clustered(t))


@query(
    "g5_assign_clusters",
    CLUSTERS.rstrip()
    + f""", tab AS ({TABLE_SQL}), new AS (SELECT m.meter_id, CASE WHEN m.meter_id % 10 > 0 THEN m.lat + 0.001 END AS lat,
        m.lon FROM meters m), near AS (SELECT n.meter_id, arg_min(cluster, {hav('n', 'c')}) AS cluster
        FROM new n JOIN (SELECT cluster, center_lat AS lat, center_lon AS lon FROM tab) c ON {hav('n', 'c')} <= {EPS}
        GROUP BY 1)
        SELECT new.meter_id, coalesce(near.cluster, -1)::INT AS cluster, CASE WHEN new.lat IS NULL THEN 0
        WHEN near.cluster IS NULL OR is_small THEN 1 ELSE 0 END AS spatial_anomaly FROM new
        LEFT JOIN near ON near.meter_id = new.meter_id LEFT JOIN tab ON tab.cluster = near.cluster""",
)
def g5(t):
    table = G.cluster_table(clustered(t))
    lat = F.when(F.col("meter_id") % 10 > 0, F.col("lat") + 0.001)
    new = t.sparse_meters().select("meter_id", lat.alias("lat"), "lon")
    return G.assign_clusters(new, table, EPS).select("meter_id", "cluster", "spatial_anomaly")


@query(
    "g6_gps_check",
    views("meters")
    + """SELECT 'range' AS rule, 'lat' AS field, count(*) AS n_bad FROM meters WHERE meter_id % 7 = 1 AND lat + 76 > 90
        UNION ALL SELECT 'not_null', 'lon', count(*) FROM meters WHERE meter_id % 5 = 0""",
)
def g6(t):
    meters = t.sparse_meters()
    bad_lat = F.when(F.col("meter_id") % 7 == 1, F.col("lat") + 76).otherwise(F.col("lat"))
    damaged = meters.select(
        "meter_id", bad_lat.alias("lat"), F.when(F.col("meter_id") % 5 > 0, F.col("lon")).alias("lon")
    )
    return Q.check(damaged, Q.gps_rules(), "meter_id").select("rule", "field", "n_bad")


CITY_VALUES = "(VALUES " + ", ".join(f"('{c[0]}', {c[2]}, {c[3]})" for c in geography.CITIES) + ")"
CITY_VIEW = {"ct": f"SELECT city_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM {CITY_VALUES} v(city_id, lat, lon)"}


@query(
    "g7_nearest_city",
    views("meters", CITY_VIEW)
    + r6(
        f"""SELECT m.meter_id, arg_min(ct.city_id, {hav('m', 'ct')}) AS city_id, min({hav('m', 'ct')}) AS distance_m
        FROM meters m, ct GROUP BY 1""",
        "distance_m",
    ),
)
def g7(t):
    near = G.nearest_city(F.col("lat"), F.col("lon"), geography.CITIES)
    return t.sparse_meters().select(
        "meter_id", near["city_id"].alias("city_id"), near["d"].alias("distance_m")
    )


NAMES = [(name, city) for city, names in geography.DISTRICTS.items() for name in names.values()]
NAME_VIEW = {
    "nm": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(NAMES)) + ") v(i, barangay, mapped)",
    "src": """SELECT m.*, nm.barangay, nm.mapped, CASE WHEN m.meter_id % 4 = 0 THEN 'pasig' WHEN m.meter_id % 4 = 1
        THEN 'unknown' END AS given FROM meters m LEFT JOIN nm ON nm.i = m.meter_id % 60""",
    "nr": f"""SELECT s.meter_id, arg_min(ct.city_id, {hav('s', 'ct')}) AS gps, min({hav('s', 'ct')}) AS d,
        min({hav('s', 'ct')}) FILTER (ct.city_id = s.mapped) AS far FROM src s, ct GROUP BY 1""",
}


@query(
    "g8_resolve_city",
    views("meters", CITY_VIEW | NAME_VIEW)
    + """SELECT meter_id, CASE WHEN given NOT IN ('', 'unknown') THEN given WHEN d < far - 2000 THEN gps
        ELSE coalesce(mapped, gps) END AS resolved_city FROM src JOIN nr USING (meter_id)""",
)
def g8(t):
    names = F.array(*[F.lit(n) for n, _ in NAMES])
    position = (F.col("meter_id") % 60).cast("int")
    given = F.when(F.col("meter_id") % 4 == 0, F.lit("pasig")).when(F.col("meter_id") % 4 == 1, F.lit("unknown"))
    meters = t.sparse_meters().select(
        "meter_id", "lat", "lon", F.get(names, position).alias("barangay"), given.alias("city_id")
    )
    places = geography.districts(t.spark)
    return G.resolve_city(meters, places, geography.CITIES).select("meter_id", "resolved_city")


HIGH = {"h": "SELECT * FROM rmeters WHERE risk_level = 'HIGH'"}


@query(
    "g9_high_risk_cluster",
    views("rmeters", HIGH)
    + f"""SELECT city_id, bool_or(k >= 2) AS has_cluster FROM (SELECT a.city_id, a.meter_id,
        count(*) FILTER (b.meter_id <> a.meter_id) AS k FROM h a JOIN h b ON a.city_id = b.city_id
        AND {hav('a', 'b')} <= 600 GROUP BY 1, 2) GROUP BY 1""",
)
def g9(t):
    return G.has_cluster(t.rollup_meters().where("risk_level = 'HIGH'"), 600.0, "city_id")


@query(
    "g10_tight_cluster_members",
    views("rmeters", HIGH | {
        "pairs": f"SELECT a.meter_id AS a, b.meter_id AS b FROM h a JOIN h b ON {hav('a', 'b')} <= 700",
        "centre": "SELECT a FROM pairs GROUP BY a HAVING count(*) >= 4",
    })
    + "SELECT DISTINCT b AS meter_id FROM pairs WHERE a IN (SELECT a FROM centre)",
)
def g10(t):
    return G.cluster_members(t.rollup_meters().where("risk_level = 'HIGH'"), 700.0, 4).select("meter_id")


@query(
    "g11_heat_points",
    views("rmeters") + r6("SELECT lat, lon, anomaly_score * 0.8 AS intensity FROM rmeters WHERE risk_level = 'HIGH'", "lat lon intensity"),
)
def g11(t):
    return G.heat_points(t.rollup_meters())


@query(
    "g7_nearest_place",
    views("meters", {
        "sites": "SELECT meter_id AS place_id, lat + 0.0004 AS lat, lon - 0.0003 AS lon FROM meters WHERE meter_id % 3 = 0",
        "d": f"SELECT a.meter_id, place_id, {hav('a', 'b')} AS d FROM meters a, sites b",
    })
    + r6("SELECT meter_id, arg_min(place_id, (d, place_id)) AS nearest, min(d) AS distance_m FROM d GROUP BY meter_id", "distance_m"),
)
def g7_nearest_place(t):
    meters = t.sparse_meters().select("meter_id", "lat", "lon")
    sites = meters.where("meter_id % 3 = 0").selectExpr("meter_id AS place_id", "lat + 0.0004 AS lat", "lon - 0.0003 AS lon")
    return nearest_place(meters, sites).select("meter_id", "nearest", "distance_m")
