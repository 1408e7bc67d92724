"""Missing readings in the long table, per meter along its months.

Windows run over one meter's months, a bounded series; statistics across meters
(month mean, month median, transformer-month median) are group aggregates that are
attached back, since one month or transformer can own a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.operators.grouped import attach, group_median
from ampledger.session import no_larger

STRATEGIES = (
    "zero",
    "mean",
    "median",
    "forward_fill_zero",
    "forward_fill",
    "backward_fill",
    "interpolate",
    "transformer_median",
)


def _past(meter: str, month: str):
    return Window.partitionBy(meter).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)


def _future(meter: str, month: str):
    return Window.partitionBy(meter).orderBy(month).rowsBetween(0, Window.unboundedFollowing)


def _forward(value: Column, meter: str, month: str) -> Column:
    return F.last(value, ignorenulls=True).over(_past(meter, month))


def _backward(value: Column, meter: str, month: str) -> Column:
    return F.first(value, ignorenulls=True).over(_future(meter, month))


def impute(
    long: DataFrame,
    strategy: str = "forward_fill",
    meter: str = "meter_id",
    month: str = "month",
    value: str = "kwh",
    group: str | None = None,
    output: str = "kwh_filled",
) -> DataFrame:
    """Add ``output``: ``value`` with gaps filled by ``strategy``.

    The table must hold one row per meter and month, with NULL for a missing reading.
    Without ``group``, ``transformer_median`` is the plain forward and backward fill.
    """
    return no_larger(_impute(long, strategy, meter, month, value, group, output), long)


def _impute(
    long: DataFrame, strategy: str, meter: str, month: str, value: str, group: str | None, output: str
) -> DataFrame:
    v = F.col(value)
    if strategy == "zero":
        return long.withColumn(output, F.coalesce(v, F.lit(0.0)))
    if strategy == "mean":
        stats = no_larger(long.groupBy(month).agg(F.avg(v).alias("_fill")), long)
        filled = attach(long, stats, [month])
        return filled.withColumn(output, F.coalesce(v, F.col("_fill"))).drop("_fill")
    if strategy == "median":
        filled = attach(long, group_median(long, [month], value, "_fill"), [month])
        return filled.withColumn(output, F.coalesce(v, F.col("_fill"))).drop("_fill")
    if strategy == "forward_fill_zero":
        return long.withColumn(output, F.coalesce(_forward(v, meter, month), F.lit(0.0)))
    if strategy == "backward_fill":
        return long.withColumn(
            output, F.coalesce(_backward(v, meter, month), _forward(v, meter, month))
        )
    if strategy == "interpolate":
        return _interpolate(long, meter, month, value, output)
    if strategy == "transformer_median" and group is not None:
        keys = [group, month]
        long = attach(long, group_median(long, keys, value, "_fill"), keys)
        v = F.coalesce(v, F.col("_fill"))
        return long.withColumn(
            output, F.coalesce(_forward(v, meter, month), _backward(v, meter, month))
        ).drop("_fill")
    if strategy in ("forward_fill", "transformer_median"):
        return long.withColumn(
            output, F.coalesce(_forward(v, meter, month), _backward(v, meter, month))
        )
    raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")


def _interpolate(long: DataFrame, meter: str, month: str, value: str, output: str) -> DataFrame:
    """Straight line between the neighbouring readings by position; flat at the edges."""
    position = F.row_number().over(Window.partitionBy(meter).orderBy(month))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos"), F.col(value).alias("y")))
    framed = (
        long.withColumn("_pos", position)
        .withColumn("_a", _forward(known, meter, month))
        .withColumn("_b", _backward(known, meter, month))
    )
    span = F.col("_b._pos") - F.col("_a._pos")
    share = (F.col("_pos") - F.col("_a._pos")) / F.nullif(span, F.lit(0))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * share
    return framed.withColumn(
        output, F.coalesce(F.col(value), line, F.col("_a.y"), F.col("_b.y"))
    ).drop("_pos", "_a", "_b")


def imputation_stats(
    filled: DataFrame, strategy: str, value: str = "kwh", output: str = "kwh_filled"
) -> DataFrame:
    """One row: missing before and after, imputed, share of cells imputed, strategy."""
    counts = filled.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(value).isNull()).alias("missing_before"),
        F.count_if(F.col(output).isNull()).alias("missing_after"),
    )
    imputed = F.col("missing_before") - F.col("missing_after")
    return counts.select(
        "missing_before",
        "missing_after",
        imputed.alias("imputed"),
        F.coalesce(F.try_divide(imputed.cast("double"), F.col("total")), F.lit(0.0)).alias("imputation_rate"),
        F.lit(strategy).alias("strategy"),
    )
