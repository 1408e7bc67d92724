"""The given tables seen as meters, transformers and readings, in Spark and in SQL.

dense   suppliers as meters, shipped quantity per month, nations as transformers
gaps    users as meters, event value per day on a full calendar with missing days
sparse  customers as meters, order value per month, market segment as class
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.operators.features import consumption_ratio, transformer_baseline
from ampledger.operators.grouped import with_scalars
from ampledger.operators.reshape import to_wide
from ampledger.operators.risk import level_of
from ampledger.session import no_larger, stored

GPS_SQL = (
    "14.4 + (({k} * 7919 + {k} * {k} * 31) % 3000) / 10000.0::DOUBLE AS lat, "
    "120.9 + (({k} * 104729 + {k} * {k} * 17) % 3000) / 10000.0::DOUBLE AS lon"
)


def gps(key: str) -> list:
    """Positions by integer arithmetic from the key; copies occur once keys pass 3000."""
    k = F.col(key)
    return [
        (F.lit(14.4) + ((k * 7919 + k * k * 31) % 3000) / F.lit(10000.0)).alias("lat"),
        (F.lit(120.9) + ((k * 104729 + k * k * 17) % 3000) / F.lit(10000.0)).alias("lon"),
    ]


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its footer is read once per query."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    # With ``keep`` a table of readings is written once, for jobs that pass over it often.

    def dense(self, keep: bool = False) -> DataFrame:
        """``meter_id, transformer_id, month, kwh``; summed before the meter join."""
        return stored(self._dense()) if keep else self._dense()

    def gaps(self, keep: bool = False) -> DataFrame:
        """``meter_id, transformer_id, month, kwh`` on the full calendar; days without
        an event are NULL. The calendar is exploded per meter: no cross join."""
        return stored(self._gaps()) if keep else self._gaps()

    def sparse(self, keep: bool = False) -> DataFrame:
        """``meter_id, transformer_id, month, kwh`` of customers with orders."""
        return stored(self._sparse()) if keep else self._sparse()

    def _dense(self) -> DataFrame:
        monthly = (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("meter_id"), F.trunc("l_shipdate", "month").alias("month"))
            .agg(F.sum("l_quantity").alias("kwh"))
        )
        meters = self.table("supplier").select(
            F.col("s_suppkey").alias("meter_id"), F.col("s_nationkey").alias("transformer_id")
        )
        return monthly.join(meters, "meter_id").select("meter_id", "transformer_id", "month", "kwh")

    def _gaps(self) -> DataFrame:
        daily = (
            self.table("events")
            .groupBy(F.col("user_id").alias("meter_id"), F.to_date("ts").alias("month"))
            .agg(F.round(F.sum("value"), 2).alias("kwh"))
        )
        span = self.table("events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
        meters = daily.select("meter_id").distinct()
        calendar = with_scalars(meters, span).select(
            "meter_id", F.explode(F.sequence("_g.a", "_g.b")).alias("month")
        )
        return calendar.join(daily, ["meter_id", "month"], "left").select(
            "meter_id", (F.col("meter_id") % 10).alias("transformer_id"), "month", "kwh"
        )

    def sparse_meters(self) -> DataFrame:
        """``meter_id, transformer_id, customer_class, kva, raw_score, lat, lon``."""
        return self.table("customer").select(
            F.col("c_custkey").alias("meter_id"),
            F.col("c_nationkey").alias("transformer_id"),
            F.lower("c_mktsegment").alias("customer_class"),
            F.col("c_acctbal").alias("raw_score"),
            *gps("c_custkey"),
        )

    def _sparse(self) -> DataFrame:
        monthly = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("meter_id"), F.trunc("o_orderdate", "month").alias("month"))
            .agg(F.floor(F.round(F.sum("o_totalprice"), 2) / 100).cast("double").alias("kwh"))
        )
        meters = self.table("customer").select(
            F.col("c_custkey").alias("meter_id"), F.col("c_nationkey").alias("transformer_id")
        )
        return monthly.join(meters, "meter_id").select("meter_id", "transformer_id", "month", "kwh")

    def facts(self) -> DataFrame:
        """Every sparse meter with its ratio (NULL without readings) and raw score.

        Written once: one row per meter, which the scoring passes then read several times.
        """
        long = self.sparse(keep=True)
        ratios = consumption_ratio(long, transformer_baseline(long)).select("meter_id", "mean_kwh", "ratio")
        return stored(self.sparse_meters().join(ratios, "meter_id", "left"))

    def wide_meters(self) -> DataFrame:
        """Customers as a wide meters table: attributes and one column per month."""
        months = to_wide(self.sparse(), ["meter_id"])
        return self.meter_attributes().join(months, "meter_id", "left")

    def meter_attributes(self) -> DataFrame:
        """Customers as meters without their readings."""
        return self.sparse_meters().select(
            F.col("meter_id"),
            "transformer_id",
            "customer_class",
            F.concat(F.lit("NATION_"), F.col("transformer_id").cast("string")).alias("barangay"),
            F.col("transformer_id").cast("int").alias("barangay_id"),
            "lat",
            "lon",
            (F.lit(5.0) + F.col("meter_id") % 50).alias("kVA"),
        )

    def transformer_table(self) -> DataFrame:
        """Nations as transformers of feeders (regions)."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("long").alias("transformer_id"),
            F.col("r_name").alias("feeder_id"),
            F.col("n_name").alias("barangay"),
            *gps("n_nationkey"),
            (F.col("n_nationkey") * 50.0).alias("capacity_kVA"),
        )

    def label_table(self) -> DataFrame:
        """Customers in debt as anomalous meters."""
        return self.table("customer").where("c_acctbal < 0").select(
            F.col("c_custkey").alias("meter_id"),
            F.lit(1).alias("anomaly_flag"),
            F.when(F.col("c_acctbal") < -500, F.lit("High")).otherwise(F.lit("Medium")).alias("risk_band"),
            F.lit("low_consumption").alias("anomaly_type"),
        )

    def rollup_meters(self) -> DataFrame:
        """Customers scored by account balance under four transformers per nation."""
        stats = self.table("customer").agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
        scored = with_scalars(self.table("customer"), stats).select(
            F.col("c_custkey").alias("meter_id"),
            (F.col("c_nationkey") * 4 + F.col("c_custkey") % 4).alias("transformer_id"),
            F.col("c_nationkey").alias("_nation"),
            F.lower("c_mktsegment").alias("customer_class"),
            *gps("c_custkey"),
            (F.lit(5.0) + F.col("c_custkey") % 50).alias("kva"),
            ((F.col("c_acctbal") - F.col("_g.a")) / (F.col("_g.b") - F.col("_g.a"))).alias("anomaly_score"),
        )
        places = self.geography().withColumnRenamed("transformer_id", "_nation")
        return scored.join(places, "_nation").drop("_nation").withColumn("risk_level", level_of(F.col("anomaly_score")))

    def rollup_long(self) -> DataFrame:
        """Monthly readings of the roll-up meters."""
        long = self.sparse(keep=True)
        finer = F.col("transformer_id") * 4 + F.col("meter_id") % 4
        return no_larger(long.withColumn("transformer_id", finer), long)

    def geography(self) -> DataFrame:
        """Transformer → district / city dimension: nations within regions."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("transformer_id"),
            F.col("n_name").alias("barangay"),
            F.lower(F.regexp_replace("r_name", " ", "_")).alias("city_id"),
        )


#: SQL text of the same views, by name.
VIEWS = {
    "dense": """SELECT l_suppkey AS meter_id, s_nationkey AS transformer_id,
        date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS kwh
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
    "daily": """SELECT user_id AS meter_id, ts::DATE AS month, round(sum(value), 2) AS kwh
        FROM events GROUP BY ALL""",
    "calendar": """SELECT meter_id, unnest(generate_series((SELECT min(ts)::DATE FROM events),
        (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS month
        FROM (SELECT DISTINCT meter_id FROM daily)""",
    "gaps": """SELECT c.meter_id, c.meter_id % 10 AS transformer_id, c.month, d.kwh
        FROM calendar c LEFT JOIN daily d ON d.meter_id = c.meter_id AND d.month = c.month""",
    "meters": f"""SELECT c_custkey AS meter_id, c_nationkey AS transformer_id,
        lower(c_mktsegment) AS customer_class, c_acctbal AS raw_score,
        {GPS_SQL.format(k='c_custkey')} FROM customer""",
    "sparse": """SELECT o_custkey AS meter_id, c_nationkey AS transformer_id,
        date_trunc('month', o_orderdate)::DATE AS month, floor(round(sum(o_totalprice), 2) / 100)::DOUBLE AS kwh
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "baseline": """SELECT transformer_id, quantile_cont(kwh, 0.5) AS baseline FROM sparse
        WHERE kwh > 0 GROUP BY transformer_id""",
    "facts": """SELECT m.*, a.mean_kwh, CASE WHEN b.baseline > 0 THEN a.mean_kwh / b.baseline END AS ratio
        FROM meters m LEFT JOIN (SELECT meter_id, avg(kwh) AS mean_kwh FROM sparse GROUP BY 1) a
        ON a.meter_id = m.meter_id LEFT JOIN baseline b ON b.transformer_id = m.transformer_id""",
    "geography": """SELECT n_nationkey AS transformer_id, n_name AS barangay,
        lower(replace(r_name, ' ', '_')) AS city_id FROM nation JOIN region ON r_regionkey = n_regionkey""",
}
VIEWS |= {
    "wide": f"""SELECT c_custkey AS meter_id, c_nationkey::BIGINT AS transformer_id, lower(c_mktsegment) AS customer_class,
        'NATION_' || c_nationkey AS barangay, c_nationkey::INT AS barangay_id, {GPS_SQL.format(k='c_custkey')},
        5.0::DOUBLE + c_custkey % 50 AS kVA FROM customer""",
    "txs": f"""SELECT n_nationkey::BIGINT AS transformer_id, r_name AS feeder_id, n_name AS barangay,
        {GPS_SQL.format(k='n_nationkey')}, n_nationkey * 50.0::DOUBLE AS capacity_kVA
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "marked": """SELECT c_custkey AS meter_id, 1 AS anomaly_flag,
        CASE WHEN c_acctbal < -500 THEN 'High' ELSE 'Medium' END AS risk_band FROM customer WHERE c_acctbal < 0""",
    "rm": f"""SELECT c_custkey AS meter_id, c_nationkey * 4 + c_custkey % 4 AS transformer_id,
        lower(c_mktsegment) AS customer_class, {GPS_SQL.format(k='c_custkey')}, 5.0::DOUBLE + c_custkey % 50 AS kva,
        (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS anomaly_score,
        barangay, city_id FROM customer JOIN geography ON geography.transformer_id = c_nationkey""",
    "rmeters": """SELECT *, CASE WHEN anomaly_score >= 0.7 THEN 'HIGH' WHEN anomaly_score >= 0.4 THEN 'MEDIUM'
        ELSE 'LOW' END AS risk_level FROM rm""",
    "rlong": "SELECT meter_id, transformer_id * 4 + meter_id % 4 AS transformer_id, month, kwh FROM sparse",
}
NEEDS = {
    "rm": ["geography"],
    "rmeters": ["rm"],
    "rlong": ["sparse"],
    "gaps": ["daily", "calendar"],
    "calendar": ["daily"],
    "baseline": ["sparse"],
    "facts": ["meters", "sparse", "baseline"],
}


def views(names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named views, those they need, and ``more`` of the caller."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in (more or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
