"""Small Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` alone would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def finite(value: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    v = col(value)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~bad, v)


def nan_to_null(value: Column | str) -> Column:
    v = col(value)
    return F.when(~F.isnan(v), v)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_ratio(num: Column, den: Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(den > 0, num / den)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def least_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def greatest_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def arc_m(dlat: Column, dlon: Column, cos1: Column, cos2: Column) -> Column:
    """Great-circle metres from coordinate differences in degrees and both cosines."""
    a, b = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + cos1 * cos2 * b * b)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    return arc_m(lat2 - lat1, lon2 - lon1, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))


def distance(metric: str, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Distance by name; only ``haversine`` treats the pair as degrees."""
    dy, dx = F.abs(y2 - y1), F.abs(x2 - x1)
    if metric == "haversine":
        return haversine_m(y1, x1, y2, x2)
    if metric == "euclidean":
        return F.sqrt(dy * dy + dx * dx)
    if metric == "manhattan":
        return dy + dx
    if metric == "chebyshev":
        return F.greatest(dy, dx)
    raise ValueError(f"unknown metric {metric!r}")


def ols_slope(y: Column, x: Column) -> Column:
    """Least-squares slope; NULL when fewer than two distinct x."""
    return F.regr_slope(y, x)


def sorted_median(values: Column) -> Column:
    """Median of an array of numbers that is bounded in length (one meter's series)."""
    s = F.array_sort(values)
    n = F.size(s)
    upper = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    lower = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def month_index(month: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(month) * 12 + F.month(month)


def yyyymm(month: Column) -> Column:
    return F.date_format(month, "yyyyMM")
