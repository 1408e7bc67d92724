"""Runs that are saved and deleted by several writers."""

import os
import threading

from pyspark.sql import functions as F

from ampledger.operators import runs as H
from ampledger.sources import writers as W


def test_concurrent_writers_are_all_kept(spark, tmp_path):
    folder, n = str(tmp_path / "runs"), 8
    tables = {"meters": spark.range(3).withColumn("v", F.lit(1.5))}
    failures = []

    def save(i):
        try:
            W.save_run(f"r{i}", tables, folder)
        except Exception as error:  # seen by the test's own thread
            failures.append(error)

    threads = [threading.Thread(target=save, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    log = W.run_log(spark, folder).collect()
    assert sorted(r.event_no for r in log) == list(range(1, n + 1))
    assert {r.run_id for r in H.live_runs(W.run_log(spark, folder)).collect()} == {f"r{i}" for i in range(n)}
    assert not [f for f in os.listdir(f"{folder}/{W.COMMITS}") if f.startswith(".") and not f.endswith(".crc")]


def test_a_deleted_run_is_gone(spark, tmp_path):
    folder = str(tmp_path / "runs")
    tables = {"meters": spark.range(3), "summary": spark.range(1).withColumn("total", F.lit(3))}
    W.save_run("a", tables, folder)
    W.save_run("b", tables, folder)
    W.delete_run(spark, folder, "a")
    for table in tables:
        assert os.listdir(f"{folder}/{table}") == ["run_id=b"]
        assert W.read_run(spark, folder, table, "a").count() == 0
    assert W.read_run(spark, folder, "meters", "b").count() == 3
    assert [r.run_id for r in H.live_runs(W.run_log(spark, folder)).collect()] == ["b"]
    # The last run goes as well: its table is empty and keeps its columns.
    W.delete_run(spark, folder, "b")
    W.delete_run(spark, folder, "b")
    empty = W.read_run(spark, folder, "summary", "b")
    assert empty.count() == 0 and {"id", "total", "run_id"} == set(empty.columns)
    assert W.latest_run_id(spark, folder) is None
    # A name may be used again.
    W.save_run("b", {"meters": spark.range(5)}, folder)
    assert W.read_run(spark, folder, "meters", "b").count() == 5 and W.latest_run_id(spark, folder) == "b"


def test_numbers_decide_not_clocks(spark):
    log = spark.createDataFrame(
        [("a", "saved", "2024-01-02 00:00:00", 1), ("a", "deleted", "2024-01-01 00:00:00", 2), ("b", "saved", "2024-01-01 00:00:00", 3)],
        "run_id string, event string, created_at string, event_no long",
    )
    assert [r.run_id for r in H.live_runs(log).collect()] == ["b"]
