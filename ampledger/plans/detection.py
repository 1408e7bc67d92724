"""Queries: detectors, evaluation, pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ampledger.operators import detectors as M
from ampledger.operators.features import ENGINEERED
from ampledger.operators.forest import IsolationForest, feature_importance
from ampledger.operators.tuning import tune_zscore
from ampledger.plans import pipelines as P
from ampledger.plans.places import CLUSTERS, EPS, MIN_SAMPLES, TABLE_SQL
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views

RAW = views("meters")


def balance(t):
    return t.sparse_meters().select("meter_id", "raw_score")


@query("m1_threshold", RAW + r6("SELECT quantile_cont(raw_score, 0.88) AS threshold FROM meters", "threshold"))
def m1(t):
    return M.score_threshold(balance(t))


@query(
    "m2_batch_normalise",
    RAW
    + r6(
        """SELECT meter_id, (raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()) AS score
        FROM meters""",
        "score",
    ),
)
def m2(t):
    return M.batch_normalise(balance(t)).select("meter_id", "score")


@query(
    "m3_binary_label",
    RAW + "SELECT meter_id, (raw_score > (SELECT quantile_cont(raw_score, 0.88) FROM meters))::INT AS flag FROM meters",
)
def m3(t):
    scored = balance(t)
    return M.flag(scored, "raw_score", M.score_threshold(scored).first()[0]).select("meter_id", "flag")


@query(
    "m4_probability",
    RAW
    + r6(
        "SELECT meter_id, 1 / (1 + exp(-(raw_score - avg(raw_score) OVER ()) / 1000)) AS probability FROM meters",
        "probability",
    ),
)
def m4(t):
    return M.probabilities(balance(t), temperature=1000.0).select("meter_id", "probability")


@query("m5_isolation_forest")
def m5(t):
    features = P.feature_table(t.dense(keep=True))
    fitted = P.train_isolation_forest(features, ENGINEERED)
    return fitted.training_scores().select("meter_id", "raw_score", "score", "flag")


@query("m6_feature_importance")
def m6(t):
    features = P.feature_table(t.dense(keep=True))
    model = IsolationForest(n_trees=50).fit(features, ENGINEERED)
    return feature_importance(model, features)


@query(
    "m7_most_anomalous",
    RAW
    + r6(
        """SELECT meter_id, raw_score, avg(raw_score) OVER () AS score_mean, stddev_pop(raw_score) OVER () AS score_std
        FROM meters ORDER BY raw_score DESC, meter_id LIMIT 10""",
        "raw_score score_mean score_std",
    ),
)
def m7(t):
    return M.most_anomalous(balance(t), 10)


FILLED = {"x": "SELECT meter_id, raw_score AS u, coalesce(mean_kwh, 0) AS v FROM facts"}


def two_features(t):
    return t.facts().select("meter_id", F.col("raw_score").alias("u"), F.coalesce("mean_kwh", F.lit(0.0)).alias("v"))


IMPORTANCE = {
    "s": "SELECT avg(u) AS mu, stddev_pop(u) + 1e-6 AS su, avg(v) AS mv, stddev_pop(v) + 1e-6 AS sv FROM x",
    "o": """SELECT *, row_number() OVER (ORDER BY md5('42|' || meter_id), meter_id) - 1 AS no, count(*) OVER () AS n FROM x""",
    "p": """SELECT pow((a.u - mu) / su, 2) AS zu, pow((a.v - mv) / sv, 2) AS zv, pow((b.u - mu) / su, 2) AS pu,
        pow((c.v - mv) / sv, 2) AS pv FROM s, o a JOIN o b ON b.no = (a.no + greatest(1, a.n // 3)) % a.n
        JOIN o c ON c.no = (a.no + greatest(1, 2 * a.n // 3)) % a.n""",
    "w": """SELECT abs(var_pop(sqrt(zu + zv)) - var_pop(sqrt(pu + zv))) AS du,
        abs(var_pop(sqrt(zu + zv)) - var_pop(sqrt(zu + pv))) AS dv FROM p""",
}


@query(
    "m6_zscore_importance",
    views("facts", FILLED | IMPORTANCE)
    + r6(
        "SELECT 'u' AS feature, du / (du + dv) AS importance FROM w UNION ALL SELECT 'v', dv / (du + dv) FROM w",
        "importance",
    ),
)
def m6_zscore(t):
    df = two_features(t)
    return feature_importance(M.ZScoreDetector().fit(df, ["u", "v"]), df)


M8_SQL = (
    views("facts", FILLED | {
        "s": """SELECT avg(u) AS mu, avg(v) AS mv, var_samp(u) + 1e-6 AS a, var_samp(v) + 1e-6 AS d, covar_samp(u, v) AS b FROM x""",
    })
    + r6(
        """SELECT meter_id, sqrt((d * pow(u - mu, 2) - 2 * b * (u - mu) * (v - mv) + a * pow(v - mv, 2)) / (a * d - b * b))
        AS raw_score FROM x, s""",
        "raw_score",
    )
)


@query("m8_mahalanobis", M8_SQL)
def m8(t):
    df = two_features(t)
    return M.MahalanobisDetector().fit(df, ["u", "v"]).score(df).select("meter_id", "raw_score")


Z_SQL = """SELECT meter_id, sqrt(pow((u - avg(u) OVER ()) / (stddev_pop(u) OVER () + 1e-6), 2)
    + pow((v - avg(v) OVER ()) / (stddev_pop(v) OVER () + 1e-6), 2)) AS raw_score FROM x"""


@query("m9_zscore_length", views("facts", FILLED) + r6(Z_SQL, "raw_score"))
def m9(t):
    df = two_features(t)
    return M.ZScoreDetector().fit(df, ["u", "v"]).score(df).select("meter_id", "raw_score")


@query(
    "m10_convergence",
    views("facts", FILLED | {"z": Z_SQL})
    + r6(
        """SELECT *, score_variance > 1e-6 AND nonzero_share > 0.01 AS converged FROM (SELECT avg(raw_score) AS score_mean,
        var_pop(raw_score) AS score_variance, avg((abs(raw_score) > 1e-6)::INT) AS nonzero_share FROM z)""",
        "score_mean score_variance nonzero_share",
    ),
)
def m10(t):
    df = two_features(t)
    return M.convergence(M.ZScoreDetector().fit(df, ["u", "v"]).score(df))


FOLD_SQL = "('0x' || substr(md5('42|' || meter_id), 1, 8))::BIGINT"


@query(
    "m11_train_validation_folds",
    RAW + f"""SELECT CASE WHEN {FOLD_SQL} % 1000 < 200 THEN 'validation' ELSE 'train' END AS part, meter_id,
        ({FOLD_SQL} % 5)::INT AS fold FROM meters""",
)
def m11(t):
    df = balance(t)
    train, rest = M.train_validation(df, "meter_id", 0.2)
    parts = train.select(F.lit("train").alias("part"), "meter_id").unionByName(
        rest.select(F.lit("validation").alias("part"), "meter_id")
    )
    return parts.withColumn("fold", M.fold_of("meter_id", 5))


@query("m12_train_isolation_forest")
def m12(t):
    trained = P.train(t.dense(), IsolationForest(n_trees=50))
    return trained.metrics


@query(
    "m12_train_zscore_run",
    None,
)
def m12_zscore(t):
    trained = P.train(t.gaps(), M.ZScoreDetector())
    return trained.assessment.select("meter_id", "composite_score", "risk_level", "risk_reason")


SWEEP = [0.05, 0.1, 0.2]


@query(
    "m13_threshold_sweep",
    views("meters", {"c": "SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS contamination",
                     "k": """SELECT contamination, CASE contamination WHEN 0.05 THEN q[1] WHEN 0.1 THEN q[2] ELSE q[3] END AS threshold
                         FROM c, (SELECT quantile_cont(raw_score, [0.95, 0.9, 0.8]) AS q FROM meters)"""})
    + r6(
        """SELECT contamination, threshold, count(*) FILTER (raw_score > threshold) AS n_flagged,
        count(*) FILTER (raw_score > threshold) / count(*)::DOUBLE AS flag_rate,
        avg(raw_score) FILTER (raw_score > threshold) - avg(raw_score) FILTER (raw_score <= threshold) AS separation
        FROM meters, k GROUP BY ALL""",
        "contamination threshold flag_rate separation",
    ),
)
def m13(t):
    return M.threshold_sweep(balance(t), SWEEP)


def zscore_tuning_sql(value: str) -> str:
    """Three folds: fitted without each, flagged above its quantile, measured on it."""
    return views("facts", FILLED | {
        "d": f"SELECT *, ({FOLD_SQL} % 3)::INT AS fold FROM x",
        "s": """SELECT f.fold, avg(u) AS mu, stddev_pop(u) + 1e-6 AS su, avg(v) AS mv, stddev_pop(v) + 1e-6 AS sv
            FROM d JOIN (SELECT unnest([0, 1, 2])::INT AS fold) f ON f.fold <> d.fold GROUP BY f.fold""",
        "z": "SELECT d.*, sqrt(pow((u - mu) / su, 2) + pow((v - mv) / sv, 2)) AS raw FROM d JOIN s USING (fold)",
        "c": "SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS contamination",
        "cut": """SELECT fold, contamination, quantile_cont(raw, [0.95, 0.9, 0.8, 0.7]) AS q FROM z, c GROUP BY ALL""",
        "l": """SELECT z.*, contamination, raw > CASE contamination WHEN 0.05 THEN q[1] WHEN 0.1 THEN q[2] WHEN 0.2 THEN q[3] ELSE q[4] END
            AS k FROM z JOIN cut USING (fold)""",
        "g": "SELECT contamination, fold, k, count(*) AS n, avg(u) AS cu, avg(v) AS cv FROM l GROUP BY ALL",
        "w": """SELECT contamination, fold, k, sum(pow(u - cu, 2) + pow(v - cv, 2)) AS within,
            avg(sqrt(pow(u - cu, 2) + pow(v - cv, 2))) AS spread FROM l JOIN g USING (contamination, fold, k) GROUP BY ALL""",
        "sides": """SELECT contamination, fold, a.n AS na, b.n AS nb, pow(a.cu - b.cu, 2) + pow(a.cv - b.cv, 2) AS gap,
            wa.within + wb.within AS within, wa.spread + wb.spread AS spread
            FROM g a JOIN g b USING (contamination, fold) JOIN w wa USING (contamination, fold) JOIN w wb USING (contamination, fold)
            WHERE NOT a.k AND b.k AND NOT wa.k AND wb.k""",
    }) + r6(f"SELECT contamination, avg({value}) AS value FROM sides GROUP BY contamination", "value")


def zscore_tuning(t, metric):
    tuned = tune_zscore(two_features(t), ["u", "v"], [0.05, 0.1, 0.2, 0.3], metric=metric)
    rows = [(p["contamination"], v) for v, p in tuned.trials]
    return t.spark.createDataFrame(rows, "contamination double, value double")


@query("m13_tune_zscore_folds", zscore_tuning_sql("na * nb / (na + nb) * gap / (within / (na + nb - 2))"))
def m13_zscore(t):
    return zscore_tuning(t, "calinski_harabasz")


@query("m13_tune_zscore_davies_bouldin", zscore_tuning_sql("spread / sqrt(gap)"))
def m13_zscore_davies(t):
    return zscore_tuning(t, "davies_bouldin")


@query("m13_tune_forest_folds")
def m13_tune_folds(t):
    features = P.feature_table(t.dense(keep=True))
    options = M.grid({"n_trees": [20, 40], "sample_size": [64, 128], "contamination": [0.1]})
    tuned = P.tune_isolation_forest(features, ENGINEERED, options, folds=3, metric="calinski_harabasz")
    return tuned.table(features)


@query("m13_tune_forest")
def m13_tune(t):
    features = P.feature_table(t.dense(keep=True))

    options = M.grid({"n_trees": [10, 30], "sample_size": [64]})
    return P.tune_isolation_forest(features, ENGINEERED, options).table(features)


@query(
    "m12_train_dbscan",
    CLUSTERS
    + f"""SELECT meter_id, lab.cluster, (lab.cluster = -1 OR is_small)::INT AS spatial_anomaly
        FROM lab LEFT JOIN ({TABLE_SQL}) c ON c.cluster = lab.cluster""",
)
def m12_dbscan(t):
    run = P.train_dbscan(t.sparse_meters(), EPS, MIN_SAMPLES)
    return run["labelled"].select("meter_id", "cluster", "spatial_anomaly")


@query(
    "m14_cluster_quality",
    views("facts", {
        "x": """SELECT (raw_score > 5000)::INT AS k, raw_score / 10000 AS u, coalesce(ratio, 1) AS v FROM facts""",
        "c": "SELECT k, count(*) AS n, avg(u) AS cu, avg(v) AS cv, sum(u * u + v * v) AS q FROM x GROUP BY k",
        "own": """SELECT x.*, pow(u - cu, 2) + pow(v - cv, 2) AS d2 FROM x JOIN c USING (k)""",
        "sp": "SELECT k, avg(sqrt(d2)) AS s, sum(d2) AS w FROM own GROUP BY k",
        "g": "SELECT avg(u) AS gu, avg(v) AS gv, count(*) AS n FROM x",
        "ms": """SELECT x.u, x.v, x.k, c.k AS o, c.n,
            (x.u * x.u + x.v * x.v) + c.q / c.n - 2 * (x.u * c.cu + x.v * c.cv) AS m FROM x, c""",
        "ab": """SELECT u, v, k, max(CASE WHEN k = o THEN m * n / (n - 1) END) AS a, max(CASE WHEN k <> o THEN m END) AS b
            FROM (SELECT row_number() OVER () AS r, * FROM ms) GROUP BY u, v, k""",
        "cnt": "SELECT u, v, k, count(*) AS copies FROM x GROUP BY ALL",
    })
    + r6(
        """SELECT (SELECT sum(s) FROM sp) / (SELECT sqrt(pow(max(cu) - min(cu), 2) + pow(max(cv) - min(cv), 2)) FROM c)
        AS davies_bouldin,
        (SELECT sum(c.n * (pow(cu - gu, 2) + pow(cv - gv, 2))) FROM c, g) / ((SELECT sum(w) FROM sp) / ((SELECT n FROM g) - 2))
        AS calinski_harabasz,
        (SELECT sum(copies * (b - a) / greatest(a, b)) FROM ab JOIN cnt USING (u, v, k)) / (SELECT n FROM g)::DOUBLE AS silhouette_sq""",
        "davies_bouldin calinski_harabasz silhouette_sq",
    ),
)
def m14(t):
    df = t.facts().select(
        (F.col("raw_score") > 5000).cast("int").alias("k"),
        (F.col("raw_score") / 10000).alias("u"),
        F.coalesce("ratio", F.lit(1.0)).alias("v"),
    )
    return M.cluster_quality(df, "k", ["u", "v"])


def silhouette_sql(label: str) -> str:
    """Every row against every row, in plain SQL."""
    return views("facts", {
        "x": f"SELECT row_number() OVER () AS r, {label} AS k, raw_score / 10000 AS u, coalesce(ratio, 1) AS v FROM facts",
        "n": "SELECT k, count(*) AS n FROM x GROUP BY k",
        "m": """SELECT a.r, a.k, b.k AS o, sum(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2))) AS total
            FROM x a, x b GROUP BY a.r, a.k, b.k""",
        "ab": """SELECT r, max(CASE WHEN m.k = o THEN n END) AS n, max(CASE WHEN m.k = o AND n > 1 THEN total / (n - 1) END) AS a,
            min(CASE WHEN m.k <> o THEN total / n END) AS b FROM m JOIN n ON n.k = m.o GROUP BY r""",
    }) + r6(
        """SELECT avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab""",
        "silhouette",
    )


def labelled(t, label):
    return t.facts().select(
        label.alias("k"), (F.col("raw_score") / 10000).alias("u"), F.coalesce("ratio", F.lit(1.0)).alias("v")
    )


@query("m14_silhouette", silhouette_sql("(raw_score > 5000)::INT"))
def m14_silhouette(t):
    return M.silhouette(labelled(t, (F.col("raw_score") > 5000).cast("int")), "k", ["u", "v"])


@query("m14_silhouette_many_labels", silhouette_sql("meter_id % 120"))
def m14_silhouette_many(t):
    return M.silhouette(labelled(t, F.col("meter_id") % 120), "k", ["u", "v"])


@query(
    "m15_risk_separation",
    views("meters", {"q": "SELECT quantile_cont(raw_score, 0.9) AS cut FROM meters"})
    + r6(
        """SELECT avg(raw_score) FILTER (raw_score >= cut) - avg(raw_score) FILTER (raw_score < cut) AS separation,
        avg((raw_score >= cut)::INT) AS share_above FROM meters, q""",
        "separation share_above",
    ),
)
def m15(t):
    return M.risk_separation(balance(t))


def learn_moments(df, columns):
    row = df.agg(*[F.avg(c).alias(f"m{c}") for c in columns], *[F.stddev_pop(c).alias(f"s{c}") for c in columns]).first()
    return np.array([row[f"m{c}"] for c in columns]), np.array([row[f"s{c}"] for c in columns])


def moment_length(state, x):
    mean, std = state
    return np.sqrt((((x - mean) / (std + 1e-6)) ** 2).sum(axis=1))


@query("x1_user_detector", views("facts", FILLED) + r6(Z_SQL, "raw_score"))
def x1(t):
    df = two_features(t)
    model = M.UserDetector(learn_moments, moment_length).fit(df, ["u", "v"])
    return model.score(df).select("meter_id", "raw_score")


def no_moments():
    return 0, None, None


def add_moments(state, x):
    mean = x.mean(axis=0)
    return join_moments(state, (len(x), mean, (x - mean).T @ (x - mean)))


def join_moments(a, b):
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * b[0] / n, a[2] + b[2] + np.outer(step, step) * a[0] * b[0] / n


def inverse_covariance(state):
    n, mean, squares = state
    return mean, np.linalg.inv(squares / (n - 1) + 1e-6 * np.eye(len(mean)))


def mahalanobis(state, x):
    mean, inverse = state
    return np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)))


@query("x1_block_detector", M8_SQL)
def x1_block(t):
    """The Mahalanobis distance as a user would write it with NumPy alone."""
    df = two_features(t)
    detector = M.BlockDetector(no_moments, add_moments, join_moments, mahalanobis, inverse_covariance)
    return detector.fit(df, ["u", "v"]).score(df).select("meter_id", "raw_score")


@query(
    "x3_stored_range_scores",
    views("facts", FILLED | {"z": Z_SQL})
    + r6(
        """SELECT meter_id, (raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()) AS score,
        (raw_score > (SELECT quantile_cont(raw_score, 0.88) FROM z))::INT AS flag FROM z""",
        "score",
    ),
)
def x3(t):
    df = two_features(t)
    return M.fit(M.ZScoreDetector(), df, ["u", "v"]).scores(df).select("meter_id", "score", "flag")


@query("x3_upload_run")
def x3_upload(t):
    from ampledger.plans.intake import weekday_upload

    tables = P.run_upload(weekday_upload(t), IsolationForest(n_trees=50))
    return tables["cities"]
