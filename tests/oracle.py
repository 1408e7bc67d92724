"""Run a registered query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT:
        return "NULL"
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return "NULL" if math.isnan(value) else repr(float(value))
    if type(value).__name__.startswith(("int", "uint")):
        return str(int(value))
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    return str(value)


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    kinds = {c: str(frame[c].dtype)[:3] for c in columns}
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False)), kinds


def compare(spark, con, q, folder: str) -> str:
    """'' when both sides agree, else what differs."""
    got_df = q.build(spark, folder).toPandas()
    if q.sql is None:
        return "" if len(got_df) else "no rows"
    want_df = con.execute(q.sql).df()
    if sorted(got_df.columns) != sorted(want_df.columns):
        return f"columns {sorted(got_df.columns)} != {sorted(want_df.columns)}"
    (got, kg), (want, kw) = canonical(got_df), canonical(want_df)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "both empty"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ on {sorted(got_df.columns)}, e.g. {bad[0][0]} != {bad[0][1]}"
    if kg != kw:
        return f"dtypes {kg} != {kw}"
    return ""


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, wanted: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ampledger.plans import load_all

    registry = load_all()
    spark, con = session(), connect(folder)
    failed = 0
    for name, q in registry.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, q, folder)
        except Exception as error:  # report every query of the run
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - began:6.2f}s {name} {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
