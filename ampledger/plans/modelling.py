"""Queries: features, scores, risk, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampledger.functions.columns import sorted_median
from ampledger.operators import features as X
from ampledger.operators import risk as R
from ampledger.operators import scoring as C
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views

STATS = "mean median std min max range cv p25 p75 iqr trend zero_ratio skewness kurtosis"


@query(
    "f1_meter_statistics",
    views("dense", {"c": """SELECT *, year(month) * 12 + month(month) AS x,
        avg(kwh) OVER (PARTITION BY meter_id) AS m, stddev_pop(kwh) OVER (PARTITION BY meter_id) AS s FROM dense"""})
    + r6(
        """SELECT meter_id, avg(kwh) AS mean, quantile_cont(kwh, 0.5) AS median, stddev_pop(kwh) AS std,
        min(kwh) AS min, max(kwh) AS max, max(kwh) - min(kwh) AS range,
        stddev_pop(kwh) / (avg(kwh) + 1e-6) AS cv, quantile_cont(kwh, 0.25) AS p25, quantile_cont(kwh, 0.75) AS p75,
        quantile_cont(kwh, 0.75) - quantile_cont(kwh, 0.25) AS iqr, regr_slope(kwh, x) AS trend,
        count(*) FILTER (kwh = 0) / count(*)::DOUBLE AS zero_ratio,
        CASE WHEN max(s) > 0 THEN avg(pow(kwh - m, 3)) / pow(max(s), 3) END AS skewness,
        CASE WHEN max(s) > 0 THEN avg(pow(kwh - m, 4)) / pow(max(s), 4) - 3 END AS kurtosis
        FROM c GROUP BY meter_id""",
        STATS,
    ),
)
def f1(t):
    return X.meter_statistics(t.dense())


def _group_sql(expr: str, name: str) -> str:
    return views("dense") + r6(
        f"SELECT transformer_id, {expr} AS {name} FROM dense WHERE kwh > 0 GROUP BY transformer_id", name
    )


@query("f2_baseline_median", _group_sql("quantile_cont(kwh, 0.5)", "baseline"))
def f2(t):
    return X.transformer_baseline(t.dense(keep=True))


@query("f2_baseline_mean", _group_sql("avg(kwh)", "baseline"))
def f2_mean(t):
    return X.transformer_baseline(t.dense(), "mean")


@query(
    "f2_baseline_trimmed_mean",
    views("dense", {"r": """SELECT transformer_id, kwh,
        row_number() OVER (PARTITION BY transformer_id ORDER BY kwh) AS i,
        floor(0.1 * count(*) OVER (PARTITION BY transformer_id)) AS cut,
        count(*) OVER (PARTITION BY transformer_id) AS n FROM dense WHERE kwh > 0"""})
    + r6("SELECT transformer_id, avg(kwh) AS baseline FROM r WHERE i > cut AND i <= n - cut GROUP BY 1", "baseline"),
)
def f2_trimmed(t):
    return X.transformer_baseline(t.dense(keep=True), "trimmed_mean")


@query("f3_spread_variance", _group_sql("var_samp(kwh)", "spread"))
def f3_variance(t):
    return X.transformer_spread(t.dense(), "variance")


@query("f3_spread_std", _group_sql("stddev_samp(kwh)", "spread"))
def f3_std(t):
    return X.transformer_spread(t.dense(), "std")


@query("f3_spread_mad", _group_sql("mad(kwh) * 1.4826::DOUBLE", "spread"))
def f3_mad(t):
    return X.transformer_spread(t.dense(keep=True), "mad")


@query("f3_spread_iqr", _group_sql("quantile_cont(kwh, 0.75) - quantile_cont(kwh, 0.25)", "spread"))
def f3_iqr(t):
    return X.transformer_spread(t.dense(keep=True), "iqr")


RECENT = {
    "last": "SELECT max(year(month) * 12 + month(month)) AS l FROM dense",
    "pts": """SELECT meter_id, year(month) * 12 + month(month) AS x, kwh AS y FROM dense, last
        WHERE kwh > 0 AND year(month) * 12 + month(month) > l - 6""",
    "ids": "SELECT DISTINCT meter_id FROM dense",
}


def _trend_sql(expr: str, source: str = "pts") -> str:
    return views("dense", RECENT) + r6(
        f"""SELECT ids.meter_id, trend FROM ids LEFT JOIN (SELECT meter_id, {expr} AS trend FROM {source}
        GROUP BY meter_id HAVING count(*) >= 3) USING (meter_id)""",
        "trend",
    )


SEN = {
    "slopes": """SELECT a.meter_id, (b.y - a.y) / (b.x - a.x) AS s FROM pts a JOIN pts b
        ON a.meter_id = b.meter_id AND a.x < b.x""",
    "sen": "SELECT meter_id, quantile_cont(s, 0.5) AS trend FROM slopes GROUP BY meter_id HAVING count(*) >= 3",
}


@query("f4_trend_ols", _trend_sql("regr_slope(y, x)"))
def f4(t):
    return X.meter_trend(t.dense(), "ols")


@query(
    "f5_theil_sen",
    views("dense", RECENT | SEN) + r6("SELECT meter_id, trend FROM ids LEFT JOIN sen USING (meter_id)", "trend"),
)
def f5(t):
    return X.meter_trend(t.dense(), "theil_sen")


@query("f6_trend_difference", _trend_sql("arg_max(y, x) - arg_min(y, x)"))
def f6(t):
    return X.meter_trend(t.dense(), "difference")


@query("f7_trend_percent_change", _trend_sql("(arg_max(y, x) - arg_min(y, x)) / arg_min(y, x) * 100"))
def f7(t):
    return X.meter_trend(t.dense(), "percent_change")


RATIO = {
    "base": "SELECT transformer_id, quantile_cont(kwh, 0.5) AS baseline FROM dense WHERE kwh > 0 GROUP BY 1",
    "ratios": """SELECT meter_id, transformer_id, mean_kwh, baseline, mean_kwh / baseline AS ratio
        FROM (SELECT meter_id, transformer_id, avg(kwh) AS mean_kwh FROM dense GROUP BY 1, 2)
        JOIN base USING (transformer_id)""",
}


@query("f8_consumption_ratio", views("dense", RATIO) + r6("SELECT * FROM ratios", "mean_kwh baseline ratio"))
def f8(t):
    long = t.dense(keep=True)
    return X.consumption_ratio(long, X.transformer_baseline(long))


@query(
    "f9_trend_statistics",
    views("dense", RECENT | SEN)
    + r6(
        """SELECT count(trend) AS n, avg(trend) AS mean, quantile_cont(trend, 0.5) AS median, stddev_pop(trend) AS std,
        count(*) FILTER (trend < 0) / count(trend)::DOUBLE AS share_declining FROM sen""",
        "mean median std share_declining",
    ),
)
def f9(t):
    return X.trend_statistics(X.meter_trend(t.dense()))


@query(
    "f9_ratio_statistics",
    views("facts")
    + r6(
        """SELECT count(ratio) AS n, avg(ratio) AS mean, quantile_cont(ratio, 0.5) AS median, stddev_pop(ratio) AS std,
        count(*) FILTER (ratio < 0.5) / count(ratio)::DOUBLE AS share_below_half,
        count(*) FILTER (ratio > 2) / count(ratio)::DOUBLE AS share_above_double FROM facts""",
        "mean median std share_below_half share_above_double",
    ),
)
def f9_ratio(t):
    return X.ratio_statistics(t.facts())


FEATURES = {
    "spread": """SELECT transformer_id, mad(kwh) * 1.4826::DOUBLE AS v FROM dense WHERE kwh > 0 GROUP BY 1""",
    "features": """SELECT r.meter_id, r.transformer_id, r.baseline AS transformer_baseline_median,
        v AS transformer_baseline_variance, trend AS meter_consumption_trend,
        ratio AS consumption_ratio_to_transformer_median
        FROM ratios r LEFT JOIN spread USING (transformer_id) LEFT JOIN sen USING (meter_id)""",
}


@query(
    "f10_engineer_features",
    views("dense", RATIO | RECENT | SEN | FEATURES) + r6("SELECT * FROM features", " ".join(X.ENGINEERED)),
)
def f10(t):
    return X.engineer_features(t.dense(keep=True))


@query(
    "f10_feature_coverage",
    views("dense", RATIO | RECENT | SEN | FEATURES)
    + r6(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, count({c})::BIGINT AS n_valid, count({c}) / count(*)::DOUBLE AS share,
            count({c}) / count(*)::DOUBLE < 0.8 AS low, count(DISTINCT transformer_id)::BIGINT AS n_transformers
            FROM features"""
            for c in X.ENGINEERED
        ),
        "share",
    ),
)
def f10_coverage(t):
    return X.feature_coverage(X.engineer_features(t.dense(keep=True)), X.ENGINEERED)


@query(
    "f11_dispersion",
    views("dense")
    + r6(
        """SELECT meter_id, quantile_cont(kwh, 0.5) AS median, var_pop(kwh) AS variance,
        var_pop(kwh) / (quantile_cont(kwh, 0.5) + 1e-6) AS variance_ratio FROM dense GROUP BY 1""",
        "median variance variance_ratio",
    ),
)
def f11(t):
    return X.dispersion(t.dense())


@query(
    "f12_describe",
    views("facts")
    + r6(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, count({c})::BIGINT AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
            min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
            quantile_cont({c}, 0.75) AS p75 FROM facts"""
            for c in ("raw_score", "mean_kwh", "ratio")
        ),
        "mean std min max p25 p50 p75",
    ),
)
def f12(t):
    return X.describe(t.facts(), ["raw_score", "mean_kwh", "ratio"])


# ---- scores ---------------------------------------------------------------------


@query(
    "c1_missing_scores",
    views("facts")
    + r6(
        """SELECT meter_id, coalesce(ratio, 0) AS zero, coalesce(ratio, avg(ratio) OVER ()) AS mean,
        coalesce(ratio, (SELECT quantile_cont(ratio, 0.5) FROM facts)) AS median FROM facts""",
        "zero mean median",
    ),
)
def c1(t):
    out = t.facts()
    for policy in ("zero", "mean", "median"):
        out = C.fill_missing(out, "ratio", policy, policy)
    return out.select("meter_id", "zero", "mean", "median")


def _score_sql(stats: str, expr: str) -> str:
    return views("meters", {"s": f"SELECT {stats} FROM meters"} if stats else None) + r6(
        f"SELECT meter_id, {expr} AS score FROM meters{', s' if stats else ''}", "score"
    )


def _scores(t, method):
    return C.normalise_scores(t.sparse_meters().select("meter_id", "raw_score"), "raw_score", method).select(
        "meter_id", "score"
    )


@query("c2_minmax", _score_sql("min(raw_score) AS a, max(raw_score) AS b", "(raw_score - a) / (b - a)"))
def c2(t):
    return _scores(t, "minmax")


@query(
    "c3_zscore_sigmoid",
    _score_sql("avg(raw_score) AS a, stddev_pop(raw_score) AS b", "1 / (1 + exp(-(raw_score - a) / b))"),
)
def c3(t):
    return _scores(t, "zscore")


@query(
    "c4_robust_sigmoid",
    _score_sql(
        """quantile_cont(raw_score, 0.5) AS m,
        quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25) AS w""",
        "1 / (1 + exp(-(raw_score - m) / w))",
    ),
)
def c4(t):
    return _scores(t, "robust")


@query(
    "c5_percentile",
    _score_sql(
        "",
        """(rank() OVER (ORDER BY raw_score) + (count(*) OVER (PARTITION BY raw_score) - 1) / 2.0::DOUBLE)
        / count(*) OVER ()""",
    ),
)
def c5(t):
    return _scores(t, "percentile")


@query("c5_percentile_with_ties", r6(
    """SELECT event_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE)
    / count(*) OVER () AS score FROM (SELECT event_id, round(value / 5) AS v FROM events)""", "score"))
def c5_ties(t):
    coarse = t.table("events").select("event_id", F.round(F.col("value") / 5).alias("v"))
    return C.normalise_scores(coarse, "v", "percentile").select("event_id", "score")


@query(
    "c6_sigmoid",
    _score_sql("quantile_cont(raw_score, 0.5) AS m", "1 / (1 + exp(-(raw_score - m)))"),
)
def c6(t):
    return _scores(t, "sigmoid")


RATIO_SCORE = """CASE WHEN ratio < 0.5 THEN 1 - ratio / 0.5 * 0.7 WHEN ratio <= 2 THEN 0.3::DOUBLE
    WHEN ratio > 2 THEN 0.3 + greatest(0, least(0.5, ln(1 + (ratio - 2)) / 10)) END"""


@query(
    "c7_ratio_score",
    views("facts") + r6(f"SELECT meter_id, {RATIO_SCORE} AS ratio_score FROM facts", "ratio_score"),
)
def c7(t):
    return t.facts().select("meter_id", C.ratio_score("ratio").alias("ratio_score"))


FUSE = {
    "st": "SELECT quantile_cont(ratio, 0.5) AS med, min(raw_score) AS a, max(raw_score) AS b FROM facts",
    "fl": """SELECT meter_id, transformer_id, raw_score, coalesce(facts.ratio, med) AS ratio,
        (raw_score - a) / (b - a) AS iso FROM facts, st""",
    "sc": f"SELECT *, {RATIO_SCORE} AS rs FROM fl",
    "cs": "SELECT *, greatest(0, least(1, 0.7 * iso + 0.3 * rs)) AS cs FROM sc",
}


@query(
    "c8_fusion_methods",
    views("facts", FUSE)
    + r6(
        """SELECT meter_id, 0.7 * iso + 0.3 * rs AS weighted_sum, pow(iso, 0.7) * pow(rs, 0.3) AS weighted_product,
        greatest(iso, rs) AS max, least(iso, rs) AS min, 1 / (0.7 / (iso + 1e-10) + 0.3 / (rs + 1e-10)) AS harmonic
        FROM sc""",
        "weighted_sum weighted_product max min harmonic",
    ),
)
def c8(t):
    scored = C.score_meters(t.facts())
    parts = {"iso": F.col("iso_score"), "ratio": F.col("ratio_score")}
    methods = ["weighted_sum", "weighted_product", "max", "min", "harmonic"]
    return scored.select("meter_id", *[C.fuse(parts, C.WEIGHTS, m).alias(m) for m in methods])


@query(
    "c9_score_meters",
    views("facts", FUSE)
    + r6(
        """SELECT meter_id, iso AS iso_score, rs AS ratio_score, cs AS composite_score, (cs >= 0.5)::INT AS anomaly_flag
        FROM cs""",
        "iso_score ratio_score composite_score",
    ),
)
def c9(t):
    out = C.score_meters(t.facts())
    return out.select("meter_id", "iso_score", "ratio_score", "composite_score", "anomaly_flag")


@query(
    "c10_score_summary",
    views("facts", FUSE)
    + r6(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS score_name, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min,
            max({c}) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median,
            quantile_cont({c}, 0.75) AS q75 FROM cs"""
            for name, c in (("iso_score", "iso"), ("ratio_score", "rs"), ("composite_score", "cs"))
        ),
        "mean std min max q25 median q75",
    ),
)
def c10(t):
    return C.score_summary(C.score_meters(t.facts()), ["iso_score", "ratio_score", "composite_score"])


# ---- risk -----------------------------------------------------------------------

ASSESS = FUSE | {
    "sp": "SELECT *, (meter_id % 20 = 0)::INT AS flag FROM cs",
    "bo": """SELECT *, CASE WHEN flag = 1 AND (SELECT sum(flag) FROM sp) >= 3 THEN 0.15 ELSE 0 END AS boost FROM sp""",
    "ri": "SELECT *, greatest(0, least(1, cs + boost)) AS risk FROM bo",
    "ass": """SELECT *, CASE WHEN ratio < 0.2 OR risk > 0.8 OR (cs > 0.6 AND risk > cs) THEN 'high'
        WHEN ratio < 0.4 OR risk > 0.6 THEN 'medium' ELSE 'low' END AS lvl,
        CASE WHEN ratio < 0.2 THEN 'extreme_low_consumption' WHEN risk > 0.8 THEN 'high_composite_score'
        WHEN cs > 0.6 AND risk > cs THEN 'spatial_cluster_boost' WHEN ratio < 0.4 THEN 'suspicious_low_consumption'
        WHEN risk > 0.6 THEN 'medium_composite_score' ELSE 'normal_behavior' END AS why FROM ri""",
}


def assessed(t):
    """Sparse meters scored and classified; every twentieth meter counts as spatially flagged."""
    flag = (F.col("meter_id") % 20 == 0).cast("int")
    facts = C.fill_missing(t.facts(), "ratio", "median")
    return R.assess(C.score_meters(facts).withColumn("spatial_anomaly", flag))


@query(
    "r1_spatial_boost",
    views("facts", ASSESS)
    + r6("SELECT meter_id, boost::DOUBLE AS spatial_boost, risk AS risk_score FROM ri", "spatial_boost risk_score"),
)
def r1(t):
    return assessed(t).select("meter_id", "spatial_boost", "risk_score")


@query(
    "r2_risk_level",
    views("facts", ASSESS)
    + r6("SELECT meter_id, risk AS risk_score, lvl AS risk_level, why AS risk_reason FROM ass", "risk_score"),
)
def r2(t):
    return assessed(t).select("meter_id", "risk_score", "risk_level", "risk_reason")


@query(
    "r2_without_overrides",
    views("facts", ASSESS)
    + """SELECT meter_id, CASE WHEN risk > 0.65 OR (cs > 0.45 AND risk > cs) THEN 'high'
        WHEN risk > 0.45 THEN 'medium' ELSE 'low' END AS risk_level FROM ri""",
)
def r2_plain(t):
    flag = (F.col("meter_id") % 20 == 0).cast("int")
    scored = C.score_meters(C.fill_missing(t.facts(), "ratio", "median")).withColumn("spatial_anomaly", flag)
    return R.assess(scored, high=0.65, medium=0.45, override_rules=False).select("meter_id", "risk_level")


@query(
    "r3_risk_distribution",
    views("facts", ASSESS)
    + r6(
        "SELECT count(*) AS total, "
        + ", ".join(f"count(*) FILTER (lvl = '{v}') AS n_{v}" for v in ("high", "medium", "low"))
        + ", "
        + ", ".join(f"count(*) FILTER (lvl = '{v}') * 100.0 / count(*) AS pct_{v}" for v in ("high", "medium", "low"))
        + " FROM ass",
        "pct_high pct_medium pct_low",
    ),
)
def r3(t):
    return R.risk_distribution(assessed(t))


@query(
    "r3_high_risk_meters",
    views("facts", ASSESS) + "SELECT meter_id, why AS risk_reason FROM ass WHERE lvl = 'high'",
)
def r3_high(t):
    return assessed(t).where("risk_level = 'high'").select("meter_id", "risk_reason")


LEVEL = "CASE WHEN iso >= 0.7 THEN 'HIGH' WHEN iso >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def scored_for_display(t):
    """Sparse meters with the min-max raw score as ``anomaly_score``."""
    return C.normalise_scores(t.sparse_meters(), "raw_score", "minmax", "anomaly_score")


@query(
    "r4_inference_levels",
    views("facts", FUSE)
    + r6(
        f"""SELECT meter_id, iso AS anomaly_score, {LEVEL} AS risk_level,
        CASE {LEVEL} WHEN 'HIGH' THEN iso WHEN 'MEDIUM' THEN 0.7 ELSE 1 - iso END AS confidence,
        CASE {LEVEL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.EXPLANATIONS.items())} END AS explanation,
        CASE WHEN iso > 0.5 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS consumption_pattern FROM sc""",
        "anomaly_score confidence",
    ),
)
def r4(t):
    out = R.predictions(scored_for_display(t))
    return out.select("meter_id", "anomaly_score", "risk_level", "confidence", "explanation", "consumption_pattern")


@query(
    "r5_complete_predictions",
    views("facts", FUSE)
    + r6(
        f"""SELECT meter_id, iso AS anomaly_score, {LEVEL} AS risk_level, abs(iso - 0.5) * 2 AS confidence,
        'Anomaly detection completed' AS explanation FROM sc""",
        "anomaly_score confidence",
    ),
)
def r5(t):
    return R.complete_predictions(scored_for_display(t).select("meter_id", "anomaly_score"))


@query(
    "r6_declining_low_users",
    views("dense", RATIO | RECENT | SEN)
    + r6(
        """SELECT meter_id, ratio, trend, ratio + trend / 100 AS suspicion_score
        FROM ratios JOIN sen USING (meter_id) WHERE ratio < 1.1 AND trend < 0
        ORDER BY suspicion_score, meter_id LIMIT 10""",
        "ratio trend suspicion_score",
    ),
)
def r6_query(t):
    long = t.dense(keep=True)
    ratios = X.consumption_ratio(long, X.transformer_baseline(long)).select("meter_id", "ratio")
    both = ratios.join(X.meter_trend(long), "meter_id")
    hits = R.declining_low_users(both, "ratio", "trend", max_ratio=1.1, max_trend=0.0)
    return hits.orderBy("suspicion_score", "meter_id").limit(10)


@query(
    "r7_risk_band",
    views("daily")
    + """SELECT meter_id, CASE WHEN quantile_cont(kwh, 0.5) < 50 THEN 'High'
        WHEN quantile_cont(kwh, 0.5) < 100 THEN 'Medium' ELSE 'Low' END AS risk_band FROM daily GROUP BY meter_id""",
)
def r7(t):
    series = t.gaps().where("kwh is not null").groupBy("meter_id").agg(F.collect_list("kwh").alias("v"))
    return series.select("meter_id", R.risk_band(sorted_median(F.col("v"))).alias("risk_band"))


@query(
    "r8_display_labels",
    views("facts", FUSE)
    + f"""SELECT meter_id, lower({LEVEL}) AS display_level,
        CASE {LEVEL} WHEN 'HIGH' THEN 'High Risk' WHEN 'MEDIUM' THEN 'Medium Risk' ELSE 'Low Risk' END AS display_band,
        CASE WHEN iso >= 0.7 THEN printf('High anomaly score detected (%.1f%%). Recommend field inspection.', iso * 100)
        END AS anomaly_note FROM sc""",
)
def r8(t):
    out = R.display_labels(R.predictions(scored_for_display(t)))
    return out.select("meter_id", "display_level", "display_band", "anomaly_note")


CONFIDENCE_DOUBLES = "confidence high_risk_rate baseline_rate deviation"
CONFIDENCE_SQL = """SELECT *, greatest(0, least(1, raw)) AS confidence,
    CASE WHEN raw >= 0.9 THEN 'very_high' WHEN raw >= 0.7 THEN 'high' WHEN raw >= 0.5 THEN 'medium'
    WHEN raw >= 0.3 THEN 'low' ELSE 'very_low' END AS confidence_level,
    0.2::DOUBLE AS baseline_rate, high_risk_rate - 0.2 AS deviation,
    CASE WHEN raw < 0 THEN 'rate_above_baseline' WHEN raw > 1 THEN 'rate_below_baseline' END AS warning,
    total_samples >= 10 AS enough_samples
    FROM (SELECT *, high_risk_count / total_samples::DOUBLE AS high_risk_rate,
    1 - high_risk_count / total_samples::DOUBLE / 0.2 AS raw FROM (SELECT count(*) AS total_samples,
    count(*) FILTER (lvl = 'high') AS high_risk_count, count(*) FILTER (lvl = 'medium') AS medium_risk_count,
    count(*) FILTER (lvl = 'low') AS low_risk_count FROM ass))"""


@query(
    "k1_confidence",
    views("facts", ASSESS) + r6(f"SELECT * EXCLUDE (raw) FROM ({CONFIDENCE_SQL})", CONFIDENCE_DOUBLES),
)
def k1(t):
    return R.confidence(assessed(t))


PRIORITY = {
    "composite_score": "cs",
    "risk_score": "risk",
    "consumption_ratio": "-ratio",
    "multi_factor": "0.5 * cs + 0.3 * risk + 0.2 * (1 - greatest(0, least(1, ratio)))",
}


def _top_sql(strategy: str, n: int) -> str:
    return f"""SELECT meter_id, cs AS composite_score, risk AS risk_score, ratio, lvl AS risk_level,
        {PRIORITY[strategy]} AS sort_score,
        row_number() OVER (ORDER BY {PRIORITY[strategy]} DESC, meter_id)::INT AS priority_rank
        FROM ass ORDER BY {PRIORITY[strategy]} DESC, meter_id LIMIT {n}"""


TOP_DOUBLES = "composite_score risk_score ratio sort_score"


def _register_top(strategy: str):
    @query(f"k2_top_by_{strategy}", views("facts", ASSESS) + r6(_top_sql(strategy, 50), TOP_DOUBLES))
    def top(t):
        return R.top_suspicious(assessed(t), 50, strategy)


for _strategy in PRIORITY:
    _register_top(_strategy)


@query(
    "k2_defaults_for_missing_columns",
    views("facts", FUSE)
    + r6(
        """SELECT meter_id, cs AS composite_score, cs AS risk_score, NULL::DOUBLE AS ratio, 'unknown' AS risk_level,
        cs AS sort_score, row_number() OVER (ORDER BY cs DESC, meter_id)::INT AS priority_rank FROM cs
        ORDER BY cs DESC, meter_id LIMIT 20""",
        TOP_DOUBLES,
    ),
)
def k2_defaults(t):
    scored = C.score_meters(C.fill_missing(t.facts(), "ratio", "median"))
    return R.top_suspicious(scored.select("meter_id", "composite_score"), 20)


TIES = {
    "coarse": "SELECT meter_id, round(cs, 2) AS cs FROM cs",
    "rk": "SELECT *, rank() OVER (ORDER BY cs DESC) AS priority_rank FROM coarse",
}


@query(
    "k3_top_with_ties",
    views("facts", FUSE | TIES)
    + r6(
        """SELECT meter_id, cs AS composite_score, priority_rank::BIGINT AS priority_rank FROM rk
        WHERE priority_rank <= 25""",
        "composite_score",
    ),
)
def k3(t):
    scored = C.score_meters(C.fill_missing(t.facts(), "ratio", "median"))
    coarse = scored.select("meter_id", F.round("composite_score", 2).alias("composite_score"))
    return R.top_suspicious(coarse, 25, include_ties=True).select("meter_id", "composite_score", "priority_rank")


@query(
    "k4_all_metrics",
    views("facts", ASSESS | {"conf": CONFIDENCE_SQL, "top": _top_sql("composite_score", 10)})
    + r6(
        """SELECT priority_rank, meter_id, composite_score, risk_level, confidence, high_risk_rate FROM top, conf""",
        "composite_score confidence high_risk_rate",
    ),
)
def k4(t):
    from ampledger.operators.grouped import with_scalars

    both = with_scalars(R.top_suspicious(assessed(t), 10), R.confidence(assessed(t)))
    return both.select(
        "priority_rank", "meter_id", "composite_score", "risk_level", "_g.confidence", "_g.high_risk_rate"
    )


@query(
    "k5_run_metrics",
    views("facts", ASSESS)
    + r6(
        """SELECT count(*) AS total_meters, count(*) FILTER (cs >= 0.5) AS anomalies_detected,
        avg((cs >= 0.5)::INT) AS detection_rate, count(*) FILTER (lvl = 'high') AS high_risk_count,
        count(*) FILTER (lvl = 'medium') AS medium_risk_count, count(*) FILTER (lvl = 'low') AS low_risk_count,
        count(*) FILTER (lvl = 'high') / count(*)::DOUBLE AS high_risk_rate,
        least(100, count(*)) / count(*)::DOUBLE AS top_n_coverage, avg(cs) AS score_mean, stddev_samp(cs) AS score_std,
        min(cs) AS score_min, max(cs) AS score_max, quantile_cont(cs, 0.5) AS score_median FROM ass""",
        "detection_rate high_risk_rate top_n_coverage score_mean score_std score_min score_max score_median",
    ),
)
def k5(t):
    return R.run_metrics(assessed(t))


@query(
    "k6_confusion",
    r6(
        """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1
        FROM (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp,
        count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)""",
        "precision recall f1",
    ),
)
def k6(t):
    labelled = t.table("labels").withColumn("low", 1 - F.col("quality"))
    return R.confusion(labelled, "toxic", "low")


@query(
    "k7_feature_contrast",
    views("facts", FUSE)
    + r6(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS feature, avg({c}) FILTER (meter_id % 20 = 0) AS mean_flagged,
            avg({c}) FILTER (meter_id % 20 <> 0) AS mean_normal,
            avg({c}) FILTER (meter_id % 20 = 0) - avg({c}) FILTER (meter_id % 20 <> 0) AS difference FROM cs"""
            for name, c in (("iso_score", "iso"), ("ratio_score", "rs"))
        ),
        "mean_flagged mean_normal difference",
    ),
)
def k7(t):
    return R.feature_contrast(assessed(t), "spatial_anomaly", ["iso_score", "ratio_score"])


# ---- the flagship ---------------------------------------------------------------

FLAGSHIP = RATIO | {
    "sc": f"SELECT *, {RATIO_SCORE} AS rs FROM ratios",
    "lv": """SELECT *, CASE WHEN ratio < 0.2 THEN 'high' WHEN rs > 0.8 THEN 'high' WHEN ratio < 0.4 THEN 'medium'
        WHEN rs > 0.6 THEN 'medium' ELSE 'low' END AS risk_level FROM sc""",
}


@query(
    "flagship_low_consumers",
    views("dense", FLAGSHIP)
    + r6(
        """SELECT meter_id, transformer_id, mean_kwh, baseline, ratio, rs AS composite_score, risk_level,
        row_number() OVER (ORDER BY ratio, meter_id)::INT AS priority_rank FROM lv
        ORDER BY ratio, meter_id LIMIT 20""",
        "mean_kwh baseline ratio composite_score",
    ),
)
def flagship(t):
    long = t.dense(keep=True)
    ratios = X.consumption_ratio(long, X.transformer_baseline(long))
    scored = ratios.withColumn("composite_score", C.ratio_score("ratio"))
    levelled = R.assess(scored, flag=None)
    top = R.top_suspicious(levelled, 20, "consumption_ratio").select("meter_id", "priority_rank")
    return levelled.join(F.broadcast(top), "meter_id").select(
        "meter_id", "transformer_id", "mean_kwh", "baseline", "ratio", "composite_score", "risk_level", "priority_rank"
    )
