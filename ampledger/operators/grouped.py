"""Group statistics at scale: back-joins, exact quantiles, running totals.

A single transformer, month or score may own a third of all rows, and a global
statistic owns all of them. Nothing here puts the raw rows of a group into one
task: aggregates are partial, quantiles are narrowed by a mergeable sketch before
any ordering, and ordered totals run over range partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import all_of, any_of, col, greatest_of
from ampledger.session import bounded, checkpointed, no_larger, row_bound, stored

#: A statistics table is broadcast only after its row count was checked against this.
BROADCAST_ROWS = 200_000
#: Rows of one key beyond which a shuffled join splits the key over several tasks.
HOT_ROWS = 5_000_000
#: Tables proven to be no longer than this take exact percentiles in one aggregate, since
#: even a single group of all rows fits one task. This changes the plan, never the answer:
#: on both ways rows with a NULL key belong to no group.
EXACT_ROWS = 1_000_000
#: Rank resolution of the quantile sketch; its rank error is n / SKETCH_ACCURACY. It changes
#: how much is ordered, not the result.
SKETCH_ACCURACY = 10_000


def with_scalars(rows: DataFrame, one_row: DataFrame, name: str = "_g") -> DataFrame:
    """Put a one-row aggregate beside every row as struct column ``name``.

    The row is fetched and becomes literals: later passes see constants that fold into
    the generated code, and chained statistics do not nest their plans into each other.
    No join and no window over the whole table.
    """
    row = one_row.first()
    fields = [
        F.lit(row[f.name] if row is not None else None).cast(f.dataType).alias(f.name)
        for f in one_row.schema.fields
    ]
    return no_larger(rows.withColumn(name, F.struct(*fields)), rows)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """True if ``df`` has at most ``max_rows`` rows: by its noted bound, else by counting
    no further than needed."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    known = row_bound(df)
    if known is not None and known <= max_rows:
        return True
    return df.limit(max_rows + 1).count() <= max_rows


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group ``stats`` (unique on ``keys``) back to ``rows``.

    A table whose bound is known to be small is broadcast as it is. Otherwise it is
    computed once and counted. Small: broadcast, so the rows are not shuffled. Large: a
    shuffled join in which hot keys are split.
    """
    known = row_bound(stats)
    if known is None or known > BROADCAST_ROWS:
        stats = stored(stats)
    if is_small(stats):
        joined = rows.join(F.broadcast(stats), keys, how)
    else:
        joined = salted_join(rows, stats, keys, how)
    return no_larger(joined, rows)


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a large ``side`` (unique on ``keys``) where some keys of ``rows`` are hot.

    Keys are counted first (combined map-side). A key with more than ``HOT_ROWS`` rows is
    split into as many parts as its count asks for: its rows draw a part, its one side row
    is copied to each. There are at most rows / ``HOT_ROWS`` such keys, so their list is
    broadcast. All other keys join as they are; rows without a key are spread over all
    partitions. The part is a hash of the row, so equal rows draw the same one: a caller with
    many equal rows of a key counts them into one row first.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_k")).where(F.col("_k") > HOT_ROWS)
    parts = F.ceil(F.col("_k") / HOT_ROWS).cast("int")
    hot = stored(counts.select(*keys, parts.alias("_parts")))
    if row_bound(hot) == 0:
        return rows.join(side, keys, how)
    hot = F.broadcast(hot)
    spread = F.xxhash64(*[F.col(c) for c in rows.columns])
    keyless = any_of([F.col(k).isNull() for k in keys])
    salt = F.when(keyless, spread).otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1))))
    salted = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
    copied = side.join(hot, keys, "left").withColumn("_salt", copies).drop("_parts")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that belong to a group: no key is NULL."""
    return rows.where(all_of([F.col(k).isNotNull() for k in keys])) if keys else rows


def group_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: Column | str,
    probs: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per group; ``keys=[]`` for the table.

    1. One pass builds a mergeable sketch per group. Around every wanted rank it
       gives an interval that provably holds the order statistic.
    2. Values outside the intervals collapse onto an interval edge, which keeps the
       order, and equal values are counted map-side.
    3. Only what is left (about n / accuracy distinct values) is ordered, in one window
       per group or, if it is still long, by range partitions.

    Groups with fewer than ``accuracy`` values skip the sketch and stay whole. A table
    proven to be short takes the built-in exact percentile instead. Rows with a NULL key
    are left out.
    """
    names = list(probs)
    known = row_bound(rows)
    rows = with_keys(rows, keys)
    if known is not None and known <= EXACT_ROWS:
        exact = F.percentile(col(value).cast("double"), F.array(*[F.lit(probs[k]) for k in names]))
        whole = rows.groupBy(*keys).agg(exact.alias("_p"))
        picked = whole.select(*keys, *[F.col("_p")[i].alias(k) for i, k in enumerate(names)])
        picked = picked.where(F.col(names[0]).isNotNull()) if keys else picked
        return bounded(picked, known if keys else 1)
    margin = 3.0 / accuracy
    lows = [max(0.0, probs[k] - margin) for k in names]
    highs = [min(1.0, probs[k] + margin) for k in names]
    values = rows.select(*keys, col(value).cast("double").alias("_v")).where("_v is not null")

    brackets = (
        values.groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", lows + highs, accuracy).alias("_s"),
        )
        .select(
            *keys,
            *[
                F.when(F.col("_n") < accuracy, F.col("_min"))
                .otherwise(F.element_at("_s", i + 1))
                .alias(f"_lo{i}")
                for i in range(len(names))
            ],
            *[
                F.when(F.col("_n") < accuracy, F.col("_max"))
                .otherwise(F.element_at("_s", len(names) + i + 1))
                .alias(f"_hi{i}")
                for i in range(len(names))
            ],
        )
    )
    if keys:
        ties = values.groupBy(*keys, "_v").agg(F.count("*").alias("_ties"))
        bound = attach(ties, brackets, keys, "inner")
        edge = F.col
    else:
        bound = with_scalars(values.withColumn("_ties", F.lit(1).cast("long")), brackets, "_b")
        edge = lambda c: F.col(f"_b.{c}")

    lo = [edge(f"_lo{i}") for i in range(len(names))]
    hi = [edge(f"_hi{i}") for i in range(len(names))]
    v = F.col("_v")
    lowest = reduce(F.least, lo)
    kept = any_of([v.between(a, b) for a, b in zip(lo, hi)])
    collapsed = F.when(kept, v).otherwise(greatest_of([lowest, *[F.when(b <= v, b) for b in hi]]))

    counts = stored(bound.groupBy(*keys, collapsed.alias("_c")).agg(F.sum("_ties").alias("_k")))
    totals = no_larger(counts.groupBy(*keys).agg(F.sum("_k").alias("_n")), counts)
    ranked = running_total(counts, ["_c"], F.col("_k"), keys, "_to")
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_k"))
    if keys:
        ranked = attach(ranked, totals, keys)
    else:
        ranked = with_scalars(ranked, totals, "_t").withColumn("_n", F.col("_t._n"))

    def order_statistic(position: Column) -> Column:
        return F.max(F.when((F.col("_from") <= position) & (position < F.col("_to")), F.col("_c")))

    picks = []
    for i, name in enumerate(names):
        exact = F.lit(probs[name]) * (F.col("_n") - 1)
        picks += [
            order_statistic(F.floor(exact)).alias(f"_l{i}"),
            order_statistic(F.ceil(exact)).alias(f"_u{i}"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, name in enumerate(names):
        exact = F.lit(probs[name]) * (F.col("_n") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_u{i}")
        out.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return no_larger(picked.select(*keys, *out), rows)


def group_median(rows: DataFrame, keys: list[str], value: Column | str, name: str) -> DataFrame:
    return group_quantiles(rows, keys, value, {name: 0.5})


def running_total(
    df: DataFrame,
    order: list[str],
    weight: Column | None = None,
    keys: list[str] | None = None,
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``weight`` (default 1) in ``order`` within ``keys``.

    Rows are range-partitioned by (keys, order) and written once; each range is
    summed on its own and shifted by the totals of the ranges before it, of which
    there are no more than shuffle partitions per key. ``(keys, order)`` must be
    unique, so a hot value has to be counted into one row beforehand. A table proven to
    be short is summed by one window instead. Rows with a NULL key are left out.
    """
    keys = keys or []
    known = row_bound(df)
    df = with_keys(df, keys)
    weight = F.lit(1).cast("long") if weight is None else weight
    if known is not None and known <= EXACT_ROWS:
        whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return bounded(df.withColumn(name, F.sum(weight).over(whole)), known)
    ranged = checkpointed(
        df.withColumn("_w", weight)
        .repartitionByRange(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    shifts = totals.select(
        *keys,
        "_range",
        F.coalesce(
            F.sum("_t").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_inside", F.sum("_w").over(inside))
        .join(shifts, [*keys, "_range"])
        .withColumn(name, F.col("_inside") + F.col("_shift"))
        .drop("_w", "_range", "_inside", "_shift")
    )
