"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query is built and run to the end into a no-op sink; session start and the
warm-up are not counted.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from ampledger.plans import load_all
from ampledger.session import SETTINGS

HEADLINE = [
    "flagship_low_consumers",
    "v4_ranges",
    "i5_forward_backward_fill",
    "o1_sigma_bounds",
    "n5_preprocess",
    "f1_meter_statistics",
    "f5_theil_sen",
    "f10_engineer_features",
    "m5_isolation_forest",
    "g2_dbscan",
    "c9_score_meters",
    "r2_risk_level",
    "k1_confidence",
    "k2_top_by_composite_score",
    "a1_transformer_rollup",
    "a3_city_rollup",
    "m12_train_isolation_forest",
    "x3_upload_run",
]


WARM_UP = ["j5_group_statistics", "flagship_low_consumers"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()

    def run(name: str) -> float:
        began = time.perf_counter()
        registry[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    for name in WARM_UP:
        run(name)
    seconds = {name: run(name) for name in HEADLINE}
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
