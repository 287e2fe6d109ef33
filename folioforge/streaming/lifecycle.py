"""Life of jobs on a stream: retries, stale locks and missing callbacks by event-time timers (QS6, QS7, QS8).

One value state a job holds its status, attempts and deadline; a timer stands at
the deadline. Timers fire when the watermark passes them, so before an event the
deadline is looked at too: what comes out depends on the events alone, not on how
they fall into micro-batches. State goes when a job ends, and a queued job that
nobody claims is let go after a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

MINUTE = 60_000_000  # microseconds
#: What :func:`transitions` returns.
OUTPUT = "job long, at_us long, change string, attempts int, next_run_us long"


@dataclass(frozen=True)
class Rules:
    most_attempts: int = 3
    lock_minutes: int = 90
    callback_minutes: int = 120
    kept_minutes: int = 7 * 24 * 60

    def expired(self, status: str, attempts: int) -> tuple[str, str | None, int]:
        """(change, next status, next attempts) at a deadline: a run without callback fails for good, a lock without
        attempts left too, a queued job is dropped."""
        if status == "running":
            return "no_callback", None, 0
        if status == "queued":
            return "dropped", None, 0
        return ("stale_requeued", "queued", attempts) if attempts < self.most_attempts else ("stale_failed", None, 0)

    def after(self, status: str | None, attempts: int, kind: str) -> tuple[str, str | None, int] | None:
        """The same for an event; None where it changes nothing. Claims and starts ask for an idle or queued job,
        failures and ends for an active one."""
        active = status in ("processing", "running")
        if kind == "claim" and not active:
            return "claimed", "processing", attempts + 1
        if kind == "start" and not active:
            return "started", "running", attempts + 1
        if kind == "fail" and active:
            return ("retried", "queued", attempts) if attempts < self.most_attempts else ("failed", None, 0)
        if kind == "done" and active:
            return "processed", None, 0
        return None

    def deadline(self, status: str, at: int) -> int:
        return at + MINUTE * {"processing": self.lock_minutes, "running": self.callback_minutes, "queued": self.kept_minutes}[status]

    def delay(self, attempts: int) -> int:
        return 1_000_000 * min(600, 30 * max(1, attempts))


class Lifecycle(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, deadline_us long")

    def _held(self) -> tuple[str | None, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (None, 0, 0)

    def _keep(self, old: tuple, new: tuple) -> None:
        """Store the state and move its timer."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if new[0] is None:
            self.state.clear()
        else:
            self.state.update(new)
            self.handle.registerTimer(-(-new[2] // 1000))

    def _expire(self, job: int, state: tuple[str | None, int, int], now: int) -> tuple[list[Row], tuple[str | None, int, int]]:
        """Changes of the deadlines that are over at ``now``, one after the other."""
        out = []
        while state[0] is not None and state[2] <= now:
            at = state[2]
            change, status, attempts = self.rules.expired(state[0], state[1])
            out.append(Row(job=job, at_us=at, change=change, attempts=state[1], next_run_us=at if status == "queued" else None))
            state = (status, attempts, self.rules.deadline(status, at) if status else 0)
        return out, state

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        job, old = key[0], self._held()
        state = old
        for r in sorted(rows, key=lambda r: (r["at_us"], r["event_id"])):
            over, state = self._expire(job, state, r["at_us"])
            yield from over
            done = self.rules.after(state[0], state[1], r["kind"])
            if done is None:
                continue
            change, status, attempts = done
            tries = attempts if change in ("claimed", "started") else state[1]
            next_run = r["at_us"] + self.rules.delay(attempts) if change == "retried" else None
            yield Row(job=job, at_us=r["at_us"], change=change, attempts=tries, next_run_us=next_run)
            state = (status, attempts, self.rules.deadline(status, r["at_us"]) if status else 0)
        self._keep(old, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self._held()
        over, state = self._expire(key[0], old, 1000 * timerValues.getCurrentWatermarkInMs())
        yield from over
        self._keep(old, state)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """Changes of each job: (job, at_us, change, attempts, next_run_us), on a stream.

    ``events`` has job long, event_id long, kind (claim, start, fail, done; others change nothing) and ts; events
    more than ``late`` behind the newest are dropped. Null jobs and times do not count. Needs the RocksDB state store.
    """
    ship(events.sparkSession)
    rows = events.filter("job is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("job", "event_id", "kind", "ts", F.unix_micros("ts").alias("at_us"))
    return rows.groupBy("job").transformWithState(Lifecycle(rules), OUTPUT, "Append", "EventTime")
