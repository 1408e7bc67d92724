"""Queries: imputation, outliers, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampledger.operators import impute as I
from ampledger.operators import scaling as S
from ampledger.plans.registry import query, r6
from ampledger.plans.tables import views

KEY = "meter_id, strftime(month, '%Y%m%d') AS day"
PAST = "(PARTITION BY meter_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FUTURE = "(PARTITION BY meter_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FORWARD = f"last_value(kwh IGNORE NULLS) OVER {PAST}"
BACKWARD = f"first_value(kwh IGNORE NULLS) OVER {FUTURE}"


def _filled(t, strategy, group=None):
    keep = strategy in ("mean", "median", "transformer_median")
    out = I.impute(t.gaps(keep), strategy, group=group)
    return out.select("meter_id", F.date_format("month", "yyyyMMdd").alias("day"), "kwh_filled")


def _fill_sql(expr: str) -> str:
    return views("gaps") + r6(f"SELECT {KEY}, {expr} AS kwh_filled FROM gaps", "kwh_filled")


@query("i1_zero_fill", _fill_sql("coalesce(kwh, 0)"))
def i1(t):
    return _filled(t, "zero")


@query("i2_month_mean_fill", _fill_sql("coalesce(kwh, avg(kwh) OVER (PARTITION BY month))"))
def i2(t):
    return _filled(t, "mean")


@query("i3_month_median_fill", _fill_sql("coalesce(kwh, quantile_cont(kwh, 0.5) OVER (PARTITION BY month))"))
def i3(t):
    return _filled(t, "median")


@query("i4_forward_fill_zero", _fill_sql(f"coalesce({FORWARD}, 0)"))
def i4(t):
    return _filled(t, "forward_fill_zero")


@query("i5_forward_backward_fill", _fill_sql(f"coalesce({FORWARD}, {BACKWARD})"))
def i5(t):
    return _filled(t, "forward_fill")


@query("i6_backward_forward_fill", _fill_sql(f"coalesce({BACKWARD}, {FORWARD})"))
def i6(t):
    return _filled(t, "backward_fill")


@query(
    "i7_interpolate",
    views(
        "gaps",
        {
            "placed": "SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY month) AS pos FROM gaps",
            "known": f"""SELECT *,
                last_value(CASE WHEN kwh IS NOT NULL THEN pos END IGNORE NULLS) OVER {PAST} AS pa,
                {FORWARD} AS ya,
                first_value(CASE WHEN kwh IS NOT NULL THEN pos END IGNORE NULLS) OVER {FUTURE} AS pb,
                {BACKWARD} AS yb FROM placed""",
        },
    )
    + r6(
        f"""SELECT {KEY}, coalesce(kwh, CASE WHEN pb > pa THEN ya + (yb - ya) * (pos - pa) / (pb - pa) END, ya, yb)
        AS kwh_filled FROM known""",
        "kwh_filled",
    ),
)
def i7(t):
    return _filled(t, "interpolate")


@query(
    "i8_transformer_month_median_fill",
    views(
        "gaps",
        {
            "med": """SELECT meter_id, transformer_id, month, coalesce(kwh,
                quantile_cont(kwh, 0.5) OVER (PARTITION BY transformer_id, month)) AS kwh FROM gaps"""
        },
    )
    + r6(f"SELECT {KEY}, coalesce({FORWARD}, {BACKWARD}) AS kwh_filled FROM med", "kwh_filled"),
)
def i8(t):
    return _filled(t, "transformer_median", "transformer_id")


@query(
    "i9_imputation_stats",
    views("gaps", {"f": f"SELECT kwh, coalesce({FORWARD}, {BACKWARD}) AS v FROM gaps"})
    + r6(
        """SELECT count(*) FILTER (kwh IS NULL)::BIGINT AS missing_before,
        count(*) FILTER (v IS NULL)::BIGINT AS missing_after,
        (count(v) - count(kwh))::BIGINT AS imputed,
        (count(v) - count(kwh)) / count(*)::DOUBLE AS imputation_rate, 'forward_fill' AS strategy FROM f""",
        "imputation_rate",
    ),
)
def i9(t):
    return I.imputation_stats(I.impute(t.gaps(), "forward_fill"), "forward_fill")


def _bounds_sql(low: str, high: str) -> str:
    return f"""SELECT transformer_id, greatest(0, {low}) AS lower_bound, {high} AS upper_bound,
        quantile_cont(kwh, 0.5) AS median, count(*) AS n_valid
        FROM dense WHERE kwh > 0 GROUP BY transformer_id HAVING count(*) >= 3"""


SIGMA = _bounds_sql("avg(kwh) - 3 * stddev_samp(kwh)", "avg(kwh) + 3 * stddev_samp(kwh)")
Q1, Q3 = "quantile_cont(kwh, 0.25)", "quantile_cont(kwh, 0.75)"
IQR = _bounds_sql(f"{Q1} - 1.5 * ({Q3} - {Q1})", f"{Q3} + 1.5 * ({Q3} - {Q1})")
CENTRAL = _bounds_sql("quantile_cont(kwh, 0.025)", "quantile_cont(kwh, 0.975)")
BOUND_COLUMNS = "lower_bound upper_bound median"


@query("o1_sigma_bounds", views("dense") + r6(SIGMA, BOUND_COLUMNS))
def o1(t):
    return S.outlier_bounds(t.dense(keep=True), "sigma", 3.0)


@query("o2_iqr_bounds", views("dense") + r6(IQR, BOUND_COLUMNS))
def o2(t):
    return S.outlier_bounds(t.dense(keep=True), "iqr", 1.5)


@query("o3_percentile_bounds", views("dense") + r6(CENTRAL, BOUND_COLUMNS))
def o3(t):
    return S.outlier_bounds(t.dense(keep=True), "percentile")


TREATED = """SELECT d.*, coalesce(kwh < lower_bound OR kwh > upper_bound, FALSE) AS hit,
    CASE WHEN kwh < lower_bound THEN lower_bound WHEN kwh > upper_bound THEN upper_bound ELSE kwh END AS kwh_capped
    FROM dense d LEFT JOIN bounds b USING (transformer_id)"""


@query(
    "o4_treat_outliers",
    views("dense", {"bounds": IQR, "treated": TREATED})
    + r6(
        """SELECT meter_id, strftime(month, '%Y%m') AS month, kwh_capped, hit::INT AS is_outlier FROM treated""",
        "kwh_capped",
    ),
)
def o4(t):
    long = t.dense(keep=True)
    out = S.treat_outliers(long, S.outlier_bounds(long, "iqr", 1.5))
    return out.select(
        "meter_id", F.date_format("month", "yyyyMM").alias("month"), "kwh_capped", F.col("is_outlier").cast("int")
    )


@query(
    "o4_outlier_summary",
    views("dense", {"bounds": IQR, "treated": TREATED})
    + r6(
        """SELECT count(*) FILTER (hit)::BIGINT AS outliers_treated, count(kwh)::BIGINT AS total_values,
        count(*) FILTER (hit) / count(kwh)::DOUBLE AS outlier_ratio FROM treated
        WHERE transformer_id IN (SELECT transformer_id FROM bounds)""",
        "outlier_ratio",
    ),
)
def o4_summary(t):
    long = t.dense(keep=True)
    return S.outlier_summary(S.treat_outliers(long, S.outlier_bounds(long, "iqr", 1.5)))


NORM = {
    "minmax": ("min(kwh)", "max(kwh) - min(kwh)"),
    "robust": ("quantile_cont(kwh, 0.5)", f"{Q3} - {Q1}"),
    "standard": ("avg(kwh)", "stddev_samp(kwh)"),
}


def _params_sql(method: str) -> str:
    centre, spread = NORM[method]
    return f"""SELECT transformer_id, {centre} AS centre,
        CASE WHEN {spread} > 0 THEN {spread} ELSE 1 END AS spread FROM dense GROUP BY transformer_id"""


def _norm_sql(method: str) -> str:
    scaled = "(kwh - centre) / spread"
    scaled = f"greatest(0, least(1, {scaled}))" if method == "minmax" else scaled
    return views("dense", {"p": _params_sql(method)}) + r6(
        f"""SELECT meter_id, strftime(month, '%Y%m') AS month, {scaled} AS kwh_norm
        FROM dense JOIN p USING (transformer_id)""",
        "kwh_norm",
    )


def _normalised(t, method):
    long = t.dense(keep=True)
    out = S.normalise(long, S.scale_params(long, method), method)
    return out.select("meter_id", F.date_format("month", "yyyyMM").alias("month"), "kwh_norm")


@query("n1_minmax", _norm_sql("minmax"))
def n1(t):
    return _normalised(t, "minmax")


@query("n2_robust", _norm_sql("robust"))
def n2(t):
    return _normalised(t, "robust")


@query("n3_standard", _norm_sql("standard"))
def n3(t):
    return _normalised(t, "standard")


@query(
    "n4_inverse",
    views("dense")
    + r6("SELECT meter_id, strftime(month, '%Y%m') AS month, kwh AS kwh_restored FROM dense", "kwh_restored"),
)
def n4(t):
    long = t.dense(keep=True)
    params = S.scale_params(long, "robust")
    back = S.denormalise(S.normalise(long, params, "robust"), params)
    return back.select("meter_id", F.date_format("month", "yyyyMM").alias("month"), "kwh_restored")


PREPROCESS = {
    "f": f"""SELECT meter_id, transformer_id, month, kwh AS raw, coalesce({FORWARD}, {BACKWARD}) AS kwh FROM gaps""",
    "bounds": """SELECT transformer_id, greatest(0, avg(kwh) - 3 * stddev_samp(kwh)) AS lower_bound,
        avg(kwh) + 3 * stddev_samp(kwh) AS upper_bound FROM f WHERE kwh > 0
        GROUP BY transformer_id HAVING count(*) >= 3""",
    "capped": """SELECT f.*, coalesce(kwh < lower_bound OR kwh > upper_bound, FALSE) AS hit,
        CASE WHEN kwh < lower_bound THEN lower_bound WHEN kwh > upper_bound THEN upper_bound ELSE kwh END AS c
        FROM f LEFT JOIN bounds USING (transformer_id)""",
    "p": """SELECT transformer_id, min(c) AS lo, CASE WHEN max(c) > min(c) THEN max(c) - min(c) ELSE 1 END AS w
        FROM capped GROUP BY 1""",
    "done": "SELECT capped.*, greatest(0, least(1, (c - lo) / w)) AS norm FROM capped JOIN p USING (transformer_id)",
}


@query(
    "n5_preprocess",
    views("gaps", PREPROCESS) + r6(f"SELECT {KEY}, norm AS kwh_norm, hit::INT AS is_outlier FROM done", "kwh_norm"),
)
def n5(t):
    out = S.preprocess(t.gaps())
    return out.select(
        "meter_id", F.date_format("month", "yyyyMMdd").alias("day"), "kwh_norm", F.col("is_outlier").cast("int")
    )


@query(
    "n5_preprocess_summary",
    views("gaps", PREPROCESS)
    + r6(
        """SELECT count(DISTINCT meter_id)::BIGINT AS n_meters, count(*)::BIGINT AS n_cells,
        count(*) FILTER (raw IS NULL)::BIGINT AS missing_before, count(*) FILTER (kwh IS NULL)::BIGINT AS missing_after,
        count(*) FILTER (hit)::BIGINT AS outliers_treated,
        (SELECT count(*) FROM (SELECT meter_id FROM f GROUP BY 1 HAVING count(raw) < 25))::BIGINT AS meters_below_min_months,
        min(norm) AS norm_min, max(norm) AS norm_max FROM done""",
        "norm_min norm_max",
    ),
)
def n5_summary(t):
    return S.preprocess_summary(S.preprocess(t.gaps()), min_valid_months=25)


@query(
    "n6_standardise",
    r6(
        """SELECT c_custkey AS meter_id,
        (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS c_acctbal_std FROM customer""",
        "c_acctbal_std",
    ),
)
def n6(t):
    out = S.standardise(t.table("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select(F.col("c_custkey").alias("meter_id"), "c_acctbal_std")
