"""Queries on what groups, caps and prepared steps tend to lose: rows without a group, many
labels, large documents, features of a stored model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampledger.operators import detectors as M
from ampledger.operators import features as X
from ampledger.operators import scaling as S
from ampledger.operators.reshape import one_hot
from ampledger.plans import pipelines as P
from ampledger.plans.registry import query, r6
from ampledger.plans.rollups import GEO, GEO_PROPERTIES, GEO_ROWS, UP, _map
from ampledger.plans.tables import views
from ampledger.session import scratch_path, stored
from ampledger.sources import writers


def partly_grouped(t):
    """Readings of which every fifth meter has no transformer."""
    known = F.when(F.col("meter_id") % 5 != 0, F.col("transformer_id"))
    return t.dense().withColumn("transformer_id", known)


GROUPED = "FROM dense WHERE meter_id % 5 <> 0 AND kwh > 0 GROUP BY transformer_id"


@query(
    "f2_null_group",
    views("dense") + r6(f"SELECT transformer_id, quantile_cont(kwh, 0.5) AS baseline {GROUPED}", "baseline"),
)
def f2_null(t):
    return X.transformer_baseline(stored(partly_grouped(t)))


@query(
    "o2_null_group",
    views("dense")
    + r6(
        f"""SELECT transformer_id, greatest(0, avg(kwh) - 3 * stddev_samp(kwh)) AS lower_bound,
        avg(kwh) + 3 * stddev_samp(kwh) AS upper_bound, count(*) AS n_valid {GROUPED} HAVING count(*) >= 3""",
        "lower_bound upper_bound",
    ),
)
def o2_null(t):
    return S.outlier_bounds(partly_grouped(t), "sigma", with_median=False)


@query(
    "m14_many_labels",
    views("facts", {
        "x": "SELECT meter_id % 120 AS k, raw_score / 10000 AS u, coalesce(ratio, 1) AS v FROM facts",
        "c": "SELECT k, count(*) AS n, avg(u) AS cu, avg(v) AS cv, sum(u * u + v * v) AS q FROM x GROUP BY k",
        "own": "SELECT x.*, pow(u - cu, 2) + pow(v - cv, 2) AS d2 FROM x JOIN c USING (k)",
        "sp": "SELECT k, avg(sqrt(d2)) AS s, sum(d2) AS w FROM own GROUP BY k",
        "cs": "SELECT * FROM c JOIN sp USING (k)",
        "db": """SELECT a.k, max((a.s + b.s) / sqrt(pow(a.cu - b.cu, 2) + pow(a.cv - b.cv, 2))) AS m
            FROM cs a, cs b WHERE a.k <> b.k GROUP BY a.k""",
        "g": "SELECT avg(u) AS gu, avg(v) AS gv, count(*) AS n FROM x",
        "r": "SELECT row_number() OVER () AS r, * FROM x",
        "ms": """SELECT r.r, r.k, c.k AS o, c.n, (r.u * r.u + r.v * r.v) + c.q / c.n - 2 * (r.u * c.cu + r.v * c.cv) AS m
            FROM r, c""",
        "ab": """SELECT r, max(CASE WHEN k = o THEN n END) AS n, max(CASE WHEN k = o AND n > 1 THEN m * n / (n - 1) END) AS a,
            min(CASE WHEN k <> o THEN m END) AS b FROM ms GROUP BY r""",
    })
    + r6(
        """SELECT (SELECT avg(m) FROM db) AS davies_bouldin,
        (SELECT sum(c.n * (pow(cu - gu, 2) + pow(cv - gv, 2))) FROM c, g) / (SELECT count(*) - 1 FROM c)
            / ((SELECT sum(w) FROM sp) / ((SELECT n FROM g) - (SELECT count(*) FROM c))) AS calinski_harabasz,
        (SELECT sum(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) FROM ab) / (SELECT n FROM g)::DOUBLE AS silhouette_sq""",
        "davies_bouldin calinski_harabasz silhouette_sq",
    ),
)
def m14_many(t):
    x = t.facts().select(
        (F.col("meter_id") % 120).alias("k"),
        (F.col("raw_score") / 10000).alias("u"),
        F.coalesce("ratio", F.lit(1.0)).alias("v"),
    )
    return M.cluster_quality(x, "k", ["u", "v"])


@query(
    "s12_geojson_parts",
    views("rmeters", UP | {"g": GEO_ROWS})
    + f"""SELECT 1 AS part, CASE WHEN row_number() OVER (ORDER BY transformer_id) > 1 THEN ',' ELSE '' END || {GEO} AS line
        FROM g UNION ALL SELECT 0, '{{"type":"FeatureCollection","features":[' UNION ALL SELECT 2, ']}}'""",
)
def s12_parts(t):
    parts = writers.feature_collection_parts(writers.transformer_features(_map(t), GEO_PROPERTIES))
    return parts.select("part", "line")


@query(
    "x3_saved_model_scores",
    views("gaps")
    + """SELECT DISTINCT meter_id, TRUE AS same_ratio, TRUE AS same_trend, TRUE AS same_raw FROM gaps""",
)
def x3_saved(t):
    """Training rows scored again as new meters by the model that was stored and read back."""
    long = t.gaps(keep=True)
    trained = P.train(long, M.ZScoreDetector())
    folder = scratch_path(t.spark, "model")
    P.save_model(trained, folder)
    again = P.score_new_meters(long, P.load_model(t.spark, folder))
    columns = {"same_ratio": "ratio", "same_trend": P.TREND, "same_raw": "raw_score"}
    old = trained.fitted.training.select("meter_id", *[F.col(c).alias(f"_{k}") for k, c in columns.items()])
    both = again.join(old, "meter_id")

    def same(a, b):
        return F.coalesce(F.abs(a - b) <= 1e-9 * (1 + F.abs(a)), a.eqNullSafe(b))

    return both.select("meter_id", *[same(F.col(c), F.col(f"_{k}")).alias(k) for k, c in columns.items()])


CLASSES = ["automobile", "building", "furniture", "household", "machinery"]


@query(
    "d4_one_hot_discovered",
    "SELECT c_custkey AS meter_id, "
    + ", ".join(f"(lower(c_mktsegment) = '{c}')::INT AS customer_class_{c}" for c in CLASSES)
    + " FROM customer",
)
def d4_found(t):
    return one_hot(t.sparse_meters().select("meter_id", "customer_class"), "customer_class")
