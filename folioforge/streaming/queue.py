"""Work queues as event logs: batch folds and their Structured Streaming twins.

Every clock is an argument (``as_of``), so that results repeat. The streaming
forms keep one small state per key and let go of it by watermark or timeout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import first_wins, unless_any
from ..shipping import ship


def enqueue_once(requests: DataFrame, key: str, order: Sequence) -> DataFrame:
    """QS1: the first request of each idempotency key."""
    return first_wins(requests, [key], order)


def minute_bucket(ts: Column) -> Column:
    """DT2."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 60).cast("long")


def start_jobs(requests: DataFrame, most_pages: int = 10) -> DataFrame:
    """QS2: one job per page of a request, keyed by URL, page and minute; equal keys once.

    ``requests`` has request_id, url, page_from, page_to, ts; a reversed range is one page.
    """
    last = F.least(F.greatest("page_to", "page_from"), F.col("page_from") + most_pages - 1)
    rows = requests.withColumn("page", F.explode(F.sequence("page_from", last)))
    key = F.sha2(F.concat_ws("|", "url", F.col("page").cast("string"), minute_bucket(F.col("ts")).cast("string")), 256)
    return enqueue_once(rows.withColumn("idempotency_key", key), "idempotency_key", ["ts", "request_id"])


def accepted_jobs(events: DataFrame, key: str, order: Sequence, start: str = "enqueue") -> DataFrame:
    """QS3: start events that open a job: there is one active job a key, from an accepted start to the next end.

    A start is accepted if the key's event before it is an end, or if there is none: a start behind an accepted
    or refused start finds the job still active.
    """
    before = F.lag("kind").over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("__b", before).filter((F.col("kind") == start) & (F.col("__b").isNull() | (F.col("__b") != start))).drop("__b")


def claim(jobs: DataFrame, as_of: Column, n: int = 1, blockers: DataFrame | None = None) -> DataFrame:
    """QS4: the next jobs to run: due, highest priority, then oldest; none while a blocking run is active."""
    due = jobs.filter((F.col("status") == "queued") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)))
    due = due if blockers is None else unless_any(due, blockers)
    head = due.orderBy(F.desc("priority"), "created_at", "job_id").limit(n)
    return head.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).withColumn("progress", F.greatest("progress", F.lit(5))).withColumn("locked_at", as_of)


def retry_delay_seconds(attempts: Column) -> Column:
    """DT3: half a minute for each attempt, ten minutes at most."""
    return F.least(F.lit(600), F.greatest(F.lit(1), attempts) * 30)


def succeed(jobs: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """QS5: finished jobs lose lock and error."""
    from ..operators.merge import mark

    null = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    return mark(jobs, done, ["job_id"], {"status": F.lit("processed"), "progress": F.lit(100), "finished_at": as_of, "locked_at": null("locked_at"), "error_code": null("error_code")})


def _freed(jobs: DataFrame, on: Column, as_of: Column, changes: dict[str, Column]) -> DataFrame:
    """Jobs for which ``on`` holds get ``changes``, lose their lock and are marked as changed; others stay as they are."""
    null = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("locked_by", "locked_at")}
    hit = F.coalesce(on, F.lit(False))
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in (changes | null | {"updated_at": as_of}).items()})


def after_failure(jobs: DataFrame, failures: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """QS6: jobs after the failures of their runs (job_id, error_code, message).

    While attempts are left a job is queued again after a delay, else it has failed for good. Either way its lock is
    freed, stage, error and time of change are set, progress stays (30 where there is none). Only queued or
    running jobs change. Messages are long and often the same, so jobs meet their digests and each message travels once.
    """
    digest = F.sha2("message", 256).alias("__digest")
    said = failures.select("job_id", F.col("error_code").alias("__code"), digest)
    texts = failures.select(digest, F.substring("message", 1, 2000).alias("__message")).filter("__digest is not null").distinct()
    j = jobs.join(said, "job_id", "left").join(texts, "__digest", "left")
    on = F.col("__code").isNotNull() & F.col("status").isin("queued", "processing")
    again = F.col("attempts") < most
    state = F.when(again, "queued").otherwise("failed")
    changes = {
        "status": state, "stage": state, "progress": F.coalesce("progress", F.lit(30)), "error_code": F.col("__code"), "error_message": F.col("__message"),
        "next_run_at": F.when(again, F.timestamp_seconds(F.unix_timestamp(as_of) + retry_delay_seconds(F.col("attempts")))).otherwise(F.col("next_run_at")),
        "finished_at": F.when(again, F.col("finished_at")).otherwise(as_of),
    }
    return _freed(j, on, as_of, changes).select(*jobs.columns)


def after_stale_lock(jobs: DataFrame, as_of: Column, minutes: int = 90, most: int = 3) -> DataFrame:
    """QS7: running payload jobs whose lock is older than ``minutes``.

    With attempts left they are queued at once, with an error that says so, and keep stage and progress. Without, they
    have failed, and keep an error that they had.
    """
    old = F.col("locked_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    on = (F.col("type") == "apify_payload_processing") & (F.col("status") == "processing") & old
    again = F.col("attempts") < most
    keep = lambda c, again_, failed: F.when(again, again_).otherwise(F.coalesce(F.col(c), failed))
    changes = {
        "status": F.when(again, "queued").otherwise("failed"), "stage": F.when(again, F.col("stage")).otherwise("failed"),
        "progress": F.when(again, F.col("progress")).otherwise(F.coalesce("progress", F.lit(30))),
        "error_code": keep("error_code", F.lit("stale_lock_requeued"), F.lit("attempts_exhausted_stale_lock")),
        "error_message": keep("error_message", F.lit("Processing job lock was stale and has been requeued."), F.lit("Stale lock with max attempts reached; failed and released.")),
        "next_run_at": F.when(again, as_of).otherwise(F.col("next_run_at")), "finished_at": F.when(again, F.col("finished_at")).otherwise(as_of),
    }
    return _freed(jobs, on, as_of, changes)


#: Types of jobs that wait for a callback. Fixed values.
START_TYPES = ("apify_start_manual_ad", "apify_start_search_page")
#: States in which an external run has ended.
ENDED = ("SUCCEEDED", "FAILED", "ABORTED", "TIMED-OUT")


def after_missing_callback(jobs: DataFrame, as_of: Column, minutes: int = 120) -> DataFrame:
    """QS8: started runs that no callback ended in ``minutes`` from their start have failed for good, however many attempts are left."""
    old = F.col("started_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    on = F.col("type").isin(*START_TYPES) & (F.col("status") == "processing") & F.col("stage").isin("starting_apify", "apify_running") & old
    code = "apify_run_stale_no_webhook"
    text = "Apify run did not deliver a webhook before APIFY_RUN_STALE_MS; releasing the Apify queue."
    return _freed(jobs, on, as_of, {"status": F.lit("failed"), "stage": F.lit("failed"), "error_code": F.lit(code), "error_message": F.lit(text), "finished_at": as_of})


def after_run_check(jobs: DataFrame, runs: DataFrame, as_of: Column, after_seconds: int = 180, grace_seconds: int = 120) -> DataFrame:
    """QS8: active runs against their recorded state (apify_run_id, run_status, run_finished_at).

    Runs started more than ``after_seconds`` ago take over the stated status; those that ended more than
    ``grace_seconds`` ago, or at no stated time, without a callback have failed for good.
    """
    said = runs.select("apify_run_id", F.upper(F.trim("run_status")).alias("__status"), F.col("run_finished_at").alias("__ended"))
    j = jobs.join(said, "apify_run_id", "left")
    ago = lambda n: as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))
    active = F.col("type").isin(*START_TYPES) & (F.col("status") == "processing") & (F.col("stage") == "apify_running") & (F.col("started_at") < ago(after_seconds)) & (F.coalesce("__status", F.lit("")) != "")
    j = j.withColumns({"updated_at": F.when(active & ~F.col("__status").eqNullSafe(F.col("apify_status")), as_of).otherwise(F.col("updated_at")), "apify_status": F.when(active, F.col("__status")).otherwise(F.col("apify_status"))})
    over = active & F.col("__status").isin(*ENDED) & (F.col("__ended").isNull() | (F.col("__ended") <= ago(grace_seconds)))
    text = F.concat(F.lit("Apify run "), F.col("apify_run_id"), F.lit(" ended with status "), F.col("__status"), F.lit(" but no supported webhook completed the job; failed to release the Apify queue."))
    changes = {"status": F.lit("failed"), "stage": F.lit("failed"), "error_code": F.lit("apify_run_terminal_no_webhook"), "error_message": text, "finished_at": as_of}
    return _freed(j, over, as_of, changes).drop("__status", "__ended").select(*jobs.columns)


def merged_result(old: Column, new: Column) -> Column:
    """QS10: a shallow merge of two maps, the new one's values first."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def last_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """QS13: the last attempt of each item."""
    return first_wins(attempts, keys, [F.desc("attempt_no")])


def isolated(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """QS11: (good, dead letters)."""
    flag = F.coalesce(bad, F.lit(True))
    return rows.filter(~flag), rows.filter(flag)


# --- streams


def stream_once(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """QS1 on a stream: the first event of a key; state goes ``late`` after it. ``ts`` is cast to a timestamp."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_runs(starts: DataFrame, ends: DataFrame, within: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """QS9: every start with its end by run id, or without one: (columns of ``starts``, started_at, ended_at).

    Both have run_id and ts. An end counts from its start until ``within`` after it. On a stream a start without end
    comes out once the watermark, ``late`` behind the newest of the slower side, has passed the time that an end
    would have had; state is kept that long. Several ends of a run give a row each: the first is the run's, see
    :func:`first_ends`. Null run ids and times have no end, and on a stream null times are dropped.
    """
    s = starts.withColumn("started_at", F.col("ts").cast("timestamp")).drop("ts").withWatermark("started_at", late).alias("s")
    e = ends.select(F.col("run_id").alias("end_run_id"), F.col("ts").cast("timestamp").alias("ended_at")).withWatermark("ended_at", late).alias("e")
    on = (F.col("run_id") == F.col("end_run_id")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.expr(f"started_at + interval {within}"))
    return s.join(e, on, "leftOuter").drop("end_run_id")


def first_ends(runs: DataFrame, keys: Sequence[str] = ("run_id", "started_at")) -> DataFrame:
    """QS9 in batch: the first end of each start of :func:`stream_runs`; a partial aggregate, no pairs."""
    rest = [c for c in runs.columns if c not in (*keys, "ended_at")]
    return runs.groupBy(*keys, *rest).agg(F.min("ended_at").alias("ended_at"))


class ActiveJobs(StatefulProcessor):
    """One flag a key, there while its job is active: state follows the active jobs."""

    def __init__(self, key: str, order: str, start: str) -> None:
        self.key, self.order, self.start = key, order, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("active", "active boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        active = self.state.exists()
        for r in sorted(rows, key=lambda r: r[self.order]):
            if r["kind"] == self.start and not active:
                yield Row(**{self.key: key[0], self.order: r[self.order]})
            active = r["kind"] == self.start
        if active:
            self.state.update((True,))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def stream_active_jobs(events: DataFrame, key: str, order: str, start: str = "enqueue") -> DataFrame:
    """QS3 on a stream: accepted starts (key, order). ``key`` and ``order`` are long columns, ``kind`` names the event; inside
    a micro-batch a key's events go in order. Needs the RocksDB state store."""
    ship(events.sparkSession)
    return events.select(key, order, "kind").groupBy(key).transformWithState(ActiveJobs(key, order, start), f"{key} long, {order} long", "Append", "None")
