"""What jobs carry through their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.streaming import queue

NOW = "2024-01-01 04:00:00"
KINDS = "job_id long, attempts int, status string, stage string, progress int, error_code string, error_message string, locked_by string, locked_at timestamp, next_run_at timestamp, finished_at timestamp, updated_at timestamp"


def test_messages_travel_as_digests(spark):
    jobs = spark.createDataFrame([(i, 1, "queued", "s", None, None, "m", "w", None, None, None, None) for i in range(6)], KINDS)
    said = [(0, "c", "x" * 2100), (1, "c", "x" * 2100), (2, "d", "y"), (3, "d", None), (4, "e", "")]
    out = queue.after_failure(jobs, spark.createDataFrame(said, "job_id long, error_code string, message string"), F.lit(NOW).cast("timestamp"))
    assert out.columns == jobs.columns
    got = {r.job_id: (r.error_code, r.error_message) for r in out.collect()}
    assert got == {0: ("c", "x" * 2000), 1: ("c", "x" * 2000), 2: ("d", "y"), 3: ("d", None), 4: ("e", ""), 5: (None, "m")}
    assert "sha2" in out._jdf.queryExecution().optimizedPlan().toString()


def test_reconciled_runs_check_jobs_once(spark):
    from folioforge.plans.queue_queries import reconciled_runs

    plan = reconciled_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
