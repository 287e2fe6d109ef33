"""Registered queries of jobs: transitions, timeouts, choices in order, streams with timers, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isbn
from ..shipping import stored
from ..streaming import queue
from . import pipelines
from .registry import query
from .tables import read

#: Jobs from line items: every column that a transition reads or sets; times in seconds from the first ship date.
_FIELDS = {
    "attempts": ("l_linenumber % 5", "CAST(l_linenumber % 5 AS INT)"),
    "status": ("CASE l_suppkey % 4 WHEN 0 THEN 'queued' WHEN 3 THEN 'processed' ELSE 'processing' END",) * 2,
    "stage": ("CASE l_partkey % 4 WHEN 0 THEN 'starting_apify' WHEN 1 THEN 'apify_running' WHEN 2 THEN 'webhook_received' ELSE 'apify_running' END",) * 2,
    "type": ("CASE l_suppkey % 5 WHEN 0 THEN 'apify_start_manual_ad' WHEN 1 THEN 'apify_start_search_page' ELSE 'apify_payload_processing' END",) * 2,
    "progress": ("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS INT) END",) * 2,
    "error_code": ("CASE WHEN l_suppkey % 3 = 0 THEN 'before' END",) * 2,
    "locked": ("CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 241 AS INT) END",) * 2,
}
_JOBS = "j AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS job_id, " + ", ".join(f"{e} AS {n}" for n, (e, _) in _FIELDS.items()) + " FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"
#: The clock: minute 240 of the day that ``locked`` counts from.
_NOW = "2024-01-01 04:00:00"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import relational

    li = relational.first_wins(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("locked") * 60)
    none = lambda kind: F.lit(None).cast(kind)
    jobs = li.selectExpr("l_orderkey * 8 + l_linenumber AS job_id", *[f"{e} AS {n}" for n, (_, e) in _FIELDS.items()])
    return jobs.withColumns({"locked_at": at, "started_at": at, "locked_by": F.lit("w"), "error_message": F.lit("m"), "next_run_at": none("timestamp"), "finished_at": none("timestamp"), "updated_at": none("timestamp")}).drop("locked")


def _shown(jobs: DataFrame, *more: Column) -> DataFrame:
    """What a transition sets, with times in seconds from the clock, and ``more``."""
    second = lambda c: (F.unix_timestamp(c) - F.unix_timestamp(F.lit(_NOW).cast("timestamp"))).alias(c)
    return jobs.select("job_id", "status", "stage", "progress", "error_code", F.col("error_message").alias("message"), F.col("locked_at").isNotNull().alias("locked"), F.col("locked_by").isNotNull().alias("owned"), second("next_run_at"), second("finished_at"), second("updated_at"), *more)


_FAILED = "(job_id % 3 = 0 AND status IN ('queued', 'processing'))"


@query(f"""WITH {_JOBS}, h AS (SELECT *, {_FAILED} AS hit, attempts < 3 AS again FROM j)
SELECT job_id, CASE WHEN NOT hit THEN status WHEN again THEN 'queued' ELSE 'failed' END AS status, CASE WHEN NOT hit THEN stage WHEN again THEN 'queued' ELSE 'failed' END AS stage,
  CASE WHEN hit THEN coalesce(progress, 30) ELSE progress END AS progress, CASE WHEN hit THEN 'payload_processing_timeout' ELSE error_code END AS error_code, CASE WHEN hit THEN repeat('x', 2000) ELSE 'm' END AS message,
  NOT hit AND locked IS NOT NULL AS locked, NOT hit AS owned, CASE WHEN hit AND again THEN CAST(least(600, 30 * greatest(1, attempts)) AS BIGINT) END AS next_run_at,
  CASE WHEN hit AND NOT again THEN CAST(0 AS BIGINT) END AS finished_at, CASE WHEN hit THEN CAST(0 AS BIGINT) END AS updated_at FROM h""")
def retried_jobs(spark: SparkSession, d: str) -> DataFrame:
    """QS6, DT3, PRD13: jobs after failures: lock, stage, progress, error and times."""
    jobs = _jobs(spark, d)
    failures = jobs.filter("job_id % 3 = 0").select("job_id", F.lit("payload_processing_timeout").alias("error_code"), F.lit("x" * 2100).alias("message"))
    return _shown(queue.after_failure(jobs, failures, F.lit(_NOW).cast("timestamp")))


@query(f"""WITH {_JOBS}, h AS (SELECT *, type = 'apify_payload_processing' AND status = 'processing' AND coalesce(locked < 150, false) AS hit, attempts < 3 AS again FROM j)
SELECT job_id, CASE WHEN NOT hit THEN status WHEN again THEN 'queued' ELSE 'failed' END AS status, CASE WHEN hit AND NOT again THEN 'failed' ELSE stage END AS stage, CASE WHEN hit AND NOT again THEN coalesce(progress, 30) ELSE progress END AS progress,
  CASE WHEN NOT hit THEN error_code WHEN again THEN 'stale_lock_requeued' ELSE coalesce(error_code, 'attempts_exhausted_stale_lock') END AS error_code, CASE WHEN hit AND again THEN 'Processing job lock was stale and has been requeued.' ELSE 'm' END AS message,
  NOT hit AND locked IS NOT NULL AS locked, NOT hit AS owned, CASE WHEN hit AND again THEN CAST(0 AS BIGINT) END AS next_run_at, CASE WHEN hit AND NOT again THEN CAST(0 AS BIGINT) END AS finished_at, CASE WHEN hit THEN CAST(0 AS BIGINT) END AS updated_at FROM h""")
def stale_lock_reset(spark: SparkSession, d: str) -> DataFrame:
    """QS7: stale locks of payload jobs: queued again, or failed and freed."""
    return _shown(queue.after_stale_lock(_jobs(spark, d), F.lit(_NOW).cast("timestamp")))


@query(f"""WITH {_JOBS}, h AS (SELECT *, type <> 'apify_payload_processing' AND status = 'processing' AND stage IN ('starting_apify', 'apify_running') AND coalesce(locked < 120, false) AS hit FROM j)
SELECT job_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'failed' ELSE stage END AS stage, progress, CASE WHEN hit THEN 'apify_run_stale_no_webhook' ELSE error_code END AS error_code,
  CASE WHEN hit THEN 'Apify run did not deliver a webhook before APIFY_RUN_STALE_MS; releasing the Apify queue.' ELSE 'm' END AS message, NOT hit AND locked IS NOT NULL AS locked, NOT hit AS owned,
  CAST(NULL AS BIGINT) AS next_run_at, CASE WHEN hit THEN CAST(0 AS BIGINT) END AS finished_at, CASE WHEN hit THEN CAST(0 AS BIGINT) END AS updated_at FROM h""")
def runs_without_callback(spark: SparkSession, d: str) -> DataFrame:
    """QS8: runs that no callback ended in two hours have failed, whatever attempts are left."""
    return _shown(queue.after_missing_callback(_jobs(spark, d), F.lit(_NOW).cast("timestamp")))


@query(f"""WITH {_JOBS}, s AS (SELECT *, CASE WHEN job_id % 6 <> 5 THEN 'r' || job_id END AS run, upper(trim((['RUNNING', ' succeeded', 'FAILED', 'READY', 'timed-out', ''])[CAST(job_id % 6 + 1 AS INT)])) AS said, CASE WHEN job_id % 2 = 0 THEN CAST((job_id % 7) * 60 AS INT) END AS ended_ago FROM j),
a AS (SELECT *, coalesce(run IS NOT NULL AND type <> 'apify_payload_processing' AND status = 'processing' AND stage = 'apify_running' AND locked < 237 AND said <> '', false) AS active FROM s),
h AS (SELECT *, active AND said IN ('SUCCEEDED', 'FAILED', 'ABORTED', 'TIMED-OUT') AND (ended_ago IS NULL OR ended_ago >= 120) AS hit FROM a)
SELECT job_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'failed' ELSE stage END AS stage, progress, CASE WHEN hit THEN 'apify_run_terminal_no_webhook' ELSE error_code END AS error_code,
  CASE WHEN hit THEN 'Apify run ' || run || ' ended with status ' || said || ' but no supported webhook completed the job; failed to release the Apify queue.' ELSE 'm' END AS message, NOT hit AND locked IS NOT NULL AS locked, NOT hit AS owned,
  CAST(NULL AS BIGINT) AS next_run_at, CASE WHEN hit THEN CAST(0 AS BIGINT) END AS finished_at, CASE WHEN active AND (hit OR said <> 'READY') THEN CAST(0 AS BIGINT) END AS updated_at, CASE WHEN active THEN said ELSE 'READY' END AS run_status FROM h""")
def reconciled_runs(spark: SparkSession, d: str) -> DataFrame:
    """QS8: active runs against their recorded state, with the grace that a callback has."""
    jobs = _jobs(spark, d).withColumns({"apify_run_id": F.when(F.col("job_id") % 6 != 5, F.concat(F.lit("r"), "job_id")), "apify_status": F.lit("READY")})
    said = F.get(F.array(*[F.lit(x) for x in ("RUNNING", " succeeded", "FAILED", "READY", "timed-out", "")]), (F.col("job_id") % 6).cast("int"))
    ended = F.when(F.col("job_id") % 2 == 0, F.timestamp_seconds(F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.col("job_id") % 7 * 60))
    runs = jobs.filter("apify_run_id is not null").select("apify_run_id", said.alias("run_status"), ended.alias("run_finished_at"))
    return _shown(queue.after_run_check(jobs, runs, F.lit(_NOW).cast("timestamp")), F.col("apify_status").alias("run_status"))


# --- choices in order

_EDITIONS = """b AS (SELECT l_orderkey AS ads_id, l_orderkey * 8 + l_linenumber AS book_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
c AS (SELECT ads_id, book_id, ord, CAST(CASE ord WHEN 0 THEN part % 3 WHEN 1 THEN supplier % 4 WHEN 2 THEN (part + line) % 5 WHEN 3 THEN part % 3 ELSE 5 + part % 4 END AS BIGINT) AS number, line FROM b, range(0, 5) AS o(ord)
  WHERE (part + supplier) % 5 <> 0 AND supplier % 6 <> 0 AND (ord + line) % 4 <> 0),
held AS (SELECT DISTINCT ads_id, part % 9 AS number FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY ads_id ORDER BY book_id, ord) AS i FROM c ANTI JOIN held USING (ads_id, number))"""


@query(f"""WITH RECURSIVE {_EDITIONS},
fold(ads_id, i, book_id, n, total, taken, took) AS (
  SELECT DISTINCT ads_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, 0, CAST([] AS BIGINT[]), false FROM f
  UNION ALL SELECT z.ads_id, z.i, z.book_id, CASE WHEN ok THEN used + 1 ELSE used END, CASE WHEN ok THEN total + 1 ELSE total END, CASE WHEN ok THEN list_append(taken, z.number) ELSE taken END, ok FROM (
    SELECT f.*, total, taken, CASE WHEN fold.book_id = f.book_id THEN fold.n ELSE 0 END AS used, (CASE WHEN fold.book_id = f.book_id THEN fold.n ELSE 0 END) < 2 AND total < 4 AND NOT list_contains(taken, f.number) AS ok FROM fold JOIN f ON f.ads_id = fold.ads_id AND f.i = fold.i + 1) z)
SELECT ads_id, book_id, total AS place, taken[len(taken)] AS number, 'image_mismatch_alternative' AS source FROM fold WHERE took""")
def mismatch_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """JN25, QS17: a book's other editions, where each choice rules out later ones of its listing; two a book and four a listing (the caps are the feature)."""
    from ..operators import relational

    li = relational.first_wins(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    b = li.select(F.col("l_orderkey").alias("ads_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("book_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"))
    b = stored(b, "editions")  # read as books, as numbers that are held and for candidates
    text = lambda c: F.lit(None).cast("string").alias(c)
    books = isbn.with_synthetic(b, F.col("part") % 9, "isbn").select(
        "ads_id", "book_id", "isbn", F.when((F.col("part") + F.col("supplier")) % 5 != 0, "mismatch").otherwise("match").alias("provider_match_status"),
        F.when(F.col("supplier") % 2 == 0, F.col("supplier") % 3).alias("momox_price"), F.when(F.col("supplier") % 2 != 0, 1).when(F.col("supplier") % 6 == 0, 0).otherwise(F.col("supplier") % 3).alias("gibert_price"), text("lookup_title"), text("title"), F.lit(1.0).alias("cost"), text("source_image_url"),
    )
    o, part = F.col("ord"), F.col("part")
    number = F.when(o == 0, part % 3).when(o == 1, F.col("supplier") % 4).when(o == 2, (part + F.col("line")) % 5).when(o == 3, part % 3).otherwise(5 + part % 4)
    found = isbn.with_synthetic(b.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4)))), number, "n")
    found = isbn.with_ten(found, F.when(o % 3 == 2, F.col("n")), "ten")
    same = (o + F.col("line")) % 4
    # one candidate in four has another title; numbers come under each of their three names
    found = found.select("book_id", "ord", F.when(o % 3 == 0, F.col("n")).alias("isbn13"), F.when(o % 3 == 1, F.col("n")).otherwise("").alias("isbn"), F.col("ten").alias("isbn10"), text("title"), (same == 1).alias("exact_title_match"), (same > 1).alias("article_insensitive_title_match"))
    out = pipelines.mismatch_alternatives(books, found)
    back = F.substring("isbn", 4, 9).cast("long")
    return out.select("ads_id", "book_id", "place", back.alias("number"), F.col("isbn_source").alias("source"))


# --- streams

#: Roles of event types in a job's life.
_KINDS = {"view": "claim", "signup": "start", "error": "fail", "click": "done"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE 'other' END"


def streamed(spark: SparkSession, d: str, make, **conf: str) -> DataFrame:
    """All events through a stream into a Parquet sink of the shared folder."""
    import uuid

    from ..shipping import shared_dir

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        run = make(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{out}/rows")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_LIFE = f"""WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) AS tm, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
-- one step: what the deadline does before the event (twice, for a lock that goes stale and is then dropped), then the event
fold(job, i, status, attempts, deadline, x1, x1_at, x1_n, x2, x2_at, x2_n, change, tm, n) AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), 0 FROM e
  UNION ALL
  SELECT job, i, CASE change WHEN 'claimed' THEN 'processing' WHEN 'started' THEN 'running' WHEN 'retried' THEN 'queued' WHEN 'failed' THEN NULL WHEN 'processed' THEN NULL ELSE s2 END,
    CASE WHEN change IN ('claimed', 'started') THEN a2 + 1 WHEN change IN ('failed', 'processed') THEN 0 ELSE a2 END,
    CASE change WHEN 'claimed' THEN tm + 5400000000 WHEN 'started' THEN tm + 7200000000 WHEN 'retried' THEN tm + 604800000000 WHEN 'failed' THEN 0 WHEN 'processed' THEN 0 ELSE d2 END,
    x1, x1_at, x1_n, x2, x2_at, x2_n, change, tm, CASE WHEN change IN ('claimed', 'started') THEN a2 + 1 ELSE a2 END
  FROM (SELECT *, CASE WHEN kind = 'claim' AND coalesce(s2, 'queued') = 'queued' THEN 'claimed' WHEN kind = 'start' AND coalesce(s2, 'queued') = 'queued' THEN 'started'
      WHEN kind = 'fail' AND s2 IN ('processing', 'running') THEN CASE WHEN a2 < 3 THEN 'retried' ELSE 'failed' END WHEN kind = 'done' AND s2 IN ('processing', 'running') THEN 'processed' END AS change
    FROM (SELECT *, CASE WHEN x2 IS NOT NULL THEN NULL ELSE s1 END AS s2, CASE WHEN x2 IS NOT NULL THEN 0 ELSE a1 END AS a2, CASE WHEN x2 IS NOT NULL THEN 0 ELSE d1 END AS d2, d1 AS x2_at, a1 AS x2_n
      FROM (SELECT *, CASE WHEN x1 = 'stale_requeued' AND d1 <= tm THEN 'dropped' END AS x2
        FROM (SELECT *, CASE WHEN x1 = 'stale_requeued' THEN 'queued' WHEN x1 IS NOT NULL THEN NULL ELSE status END AS s1, CASE WHEN x1 = 'stale_requeued' OR x1 IS NULL THEN attempts ELSE 0 END AS a1,
            CASE WHEN x1 = 'stale_requeued' THEN deadline + 604800000000 WHEN x1 IS NOT NULL THEN 0 ELSE deadline END AS d1, deadline AS x1_at, attempts AS x1_n
          FROM (SELECT e.job, e.i, e.tm, e.kind, fold.status, fold.attempts, fold.deadline,
              CASE WHEN fold.status IS NULL OR fold.deadline > e.tm THEN NULL WHEN fold.status = 'running' THEN 'no_callback' WHEN fold.status = 'queued' THEN 'dropped' WHEN fold.attempts < 3 THEN 'stale_requeued' ELSE 'stale_failed' END AS x1
            FROM fold JOIN e ON e.job = fold.job AND e.i = fold.i + 1)))))
), last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1), mark AS (SELECT max(tm) - 600000000 AS mark FROM e),
-- after the last event the watermark decides
t1 AS (SELECT job, deadline AS tm, CASE WHEN status = 'running' THEN 'no_callback' WHEN status = 'queued' THEN 'dropped' WHEN attempts < 3 THEN 'stale_requeued' ELSE 'stale_failed' END AS change, attempts AS n FROM last, mark WHERE status IS NOT NULL AND deadline <= mark),
t2 AS (SELECT job, tm + 604800000000 AS tm, 'dropped' AS change, n FROM t1, mark WHERE change = 'stale_requeued' AND tm + 604800000000 <= mark),
every AS (SELECT job, tm, change, n FROM fold WHERE change IS NOT NULL UNION ALL SELECT job, x1_at, x1, x1_n FROM fold WHERE x1 IS NOT NULL UNION ALL SELECT job, x2_at, x2, x2_n FROM fold WHERE x2 IS NOT NULL UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)
SELECT job, tm AS at_us, change, n AS attempts, CASE change WHEN 'retried' THEN tm + 1000000 * least(600, 30 * greatest(1, n)) WHEN 'stale_requeued' THEN tm END AS next_run_us FROM every"""


@query(_LIFE)
def stream_job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """QS6, QS7, QS8 on a stream: retries, stale locks and missing callbacks by event-time timers."""
    from ..streaming import lifecycle

    kind = F.lit("other")
    for name, role in _KINDS.items():
        kind = F.when(F.col("event_type") == name, role).otherwise(kind)
    return streamed(spark, d, lambda ev: lifecycle.transitions(ev.select(F.col("user_id").alias("job"), "event_id", kind.alias("kind"), "ts")), **ROCKS)


_STARTS = "s AS (SELECT event_id, event_id // 6 AS run_id, ts FROM events WHERE event_type IN ('view', 'signup')), f AS (SELECT event_id // 6 AS run_id, ts FROM events WHERE event_type = 'click')"


@query(f"""WITH {_STARTS}, mark AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM f)) - INTERVAL 10 MINUTE AS mark)
SELECT s.event_id, s.run_id, epoch_us(f.ts) AS ended_us FROM s LEFT JOIN f ON s.run_id = f.run_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 15 MINUTE, mark WHERE f.ts IS NOT NULL OR s.ts + INTERVAL 15 MINUTE < mark""")
def stream_run_ends(spark: SparkSession, d: str) -> DataFrame:
    """QS9 on a stream: both sides with watermarks; starts with their ends, and those for which none can come any more."""

    def make(ev: DataFrame) -> DataFrame:
        ev = ev.withColumn("run_id", F.floor(F.col("event_id") / 6).cast("long"))
        starts, ends = ev.filter("event_type in ('view', 'signup')").select("run_id", "event_id", "ts"), ev.filter("event_type = 'click'").select("run_id", "ts")
        return queue.stream_runs(starts, ends, "15 minutes").select("event_id", "run_id", F.unix_micros("ended_at").alias("ended_us"))

    return streamed(spark, d, make)


@query(f"WITH {_STARTS} SELECT s.event_id, min(epoch_us(f.ts)) AS ended_us FROM s LEFT JOIN f ON s.run_id = f.run_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 15 MINUTE GROUP BY 1")
def completed_runs(spark: SparkSession, d: str) -> DataFrame:
    """QS9 in batch: every start with its first end."""
    ev = read(spark, d, "events").withColumn("run_id", F.floor(F.col("event_id") / 6).cast("long"))
    runs = queue.stream_runs(ev.filter("event_type in ('view', 'signup')").select("run_id", "event_id", "ts"), ev.filter("event_type = 'click'").select("run_id", "ts"), "15 minutes")
    return queue.first_ends(runs).select("event_id", F.unix_micros("ended_at").alias("ended_us"))


# --- sinks


def _in_files(spark: SparkSession, d: str, out: str, n: int) -> DataFrame:
    """The events as a stream of ``n`` files, a file a micro-batch."""
    ev = read(spark, d, "events")
    ev.repartition(n, F.col("event_id") % n).write.parquet(f"{out}/in")
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")


@query("""WITH c AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_type = 'purchase') AS DOUBLE) AS usd, count(*) FILTER (event_type = 'purchase') AS costs FROM events GROUP BY 1),
n AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, n.event_id AS last_event, n.event_type AS last_type, usd, costs FROM n JOIN c USING (user_id)""")
def stream_committed_totals(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK13: micro-batches merged into listings, and costs with their totals, in one commit a batch."""
    import uuid

    from ..shipping import shared_dir
    from ..streaming import sinks

    out = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    store = sinks.Store(spark, f"{out}/store", 8)
    rows = lambda b: b.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("l")).select("user_id", "l.*")
    paid = lambda b: b.filter("event_type = 'purchase'").select(F.col("user_id").alias("ads_id"), "event_id", F.col("value").alias("amount_usd"))
    newest, costs = sinks.newest(["user_id"], "event_id"), sinks.costs()
    totals = costs["cost_totals"]
    tables = {
        "users": sinks.Merged(newest.keys, newest.change, rows), "cost_events": sinks.Appended(paid),
        "cost_totals": sinks.Merged(totals.keys, totals.change, lambda b: totals.rows(paid(b))),
    }
    empty = lambda schema: spark.createDataFrame([], schema)
    store.create({"users": (empty("user_id long, event_id long, event_type string"), tables["users"]), "cost_events": (empty("ads_id long, event_id long, amount_usd double"), tables["cost_events"]), "cost_totals": (empty("ads_id long, usd decimal(28,6), events long"), tables["cost_totals"])})
    stream = _in_files(spark, d, out, 3)
    stream.writeStream.foreachBatch(store.sink(tables)).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    sums = store.read("cost_events").groupBy("ads_id").agg(F.count("*").alias("costs"))  # as many events as the totals say
    both = store.read("cost_totals").join(sums, "ads_id").filter("events = costs").select(F.col("ads_id").alias("user_id"), F.col("usd").cast("double").alias("usd"), "costs")
    out = store.read("users").join(both, "user_id", "left")
    return out.select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"), "usd", F.coalesce("costs", F.lit(0)).alias("costs"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS total FROM orders UNION ALL SELECT -o_orderkey, 'new', CASE WHEN o_orderkey % 2 = 0 THEN 0 END FROM orders WHERE o_orderkey % 3 = 0")
def bucketed_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK2: a merge into a target that is bucketed by its key and stays where it is."""
    import uuid

    from ..operators import merge
    from ..shipping import shared_dir

    o = read(spark, d, "orders")
    name = f"orders_{uuid.uuid4().hex}"
    target = merge.bucketed(o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")), name, ["o_orderkey"], int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/{name}")
    some = o.filter("o_orderkey % 3 = 0").withColumn("k", F.explode(F.array("o_orderkey", -F.col("o_orderkey"))))
    source = some.select(F.col("k").alias("o_orderkey"), F.lit("new").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, 0.0).alias("total"))
    return merge.merge(target, source, ["o_orderkey"], {}, null_keys=False)
