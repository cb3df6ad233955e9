"""Versions of sessions over killed and competing writes, and runs that are counted and stopped."""

import threading
import time

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from dossierlake.operators.versions import Conflict, Sessions
from dossierlake.workspace import job_tag, materialize, row_counts, stop_jobs


def test_versions_killed_and_competing_writes(spark, tmp_path):
    sessions = Sessions(spark, f"file://{tmp_path}/session")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    values = lambda frame: sorted(r.n for r in frame.collect())
    assert sessions.versions() == [] and sessions.read() == {}
    assert sessions.commit({"claims": rows(1, 2), "scores": rows(7)}) == 1
    broken = rows(3).select(F.raise_error(F.lit("killed")).cast("long").alias("n"))
    with pytest.raises(Exception, match="killed"):
        sessions.commit({"claims": rows(3), "scores": broken})
    assert sessions.versions() == [1] and values(sessions.read()["claims"]) == [1, 2]
    assert sessions.commit({"scores": rows(8, 9)}) == 2
    assert {n: values(f) for n, f in sessions.read().items()} == {"claims": [1, 2], "scores": [8, 9]}
    with pytest.raises(Conflict):
        sessions.commit({"scores": rows(5)}, base=1)
    assert values(sessions.read(1)["scores"]) == [7] and values(sessions.read()["scores"]) == [8, 9]
    assert Sessions(spark, f"file://{tmp_path}/session").versions() == [1, 2]
    with pytest.raises(KeyError):
        sessions.read(5)
    assert sessions.commit({"empty": rows()}) == 3 and values(sessions.read()["empty"]) == []


def test_rows_are_counted_by_the_jobs_that_write_them(spark):
    with row_counts() as counts:
        materialize(spark.range(7), "seven")
        materialize(spark.range(0), "none")
    materialize(spark.range(3), "seven")
    assert counts == {"seven": 7, "none": 0}


def test_a_tagged_job_stops(spark):
    failed = []

    def work():
        slow = F.udf(lambda n: time.sleep(30) or n, "long")
        with job_tag(spark, "slow-run"):
            try:
                spark.range(0, 8, 1, 2).select(slow("id")).write.format("noop").mode("overwrite").save()
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    began = time.time()
    while not failed and time.time() - began < 25:
        time.sleep(1)
        stop_jobs(spark, "slow-run")
    thread.join(40)
    assert failed and time.time() - began < 25
    assert spark.read.parquet(f"{SMALL}/nation.parquet").count() == 25
