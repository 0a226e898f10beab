"""Jobs as keyed state with timers: moves that come late wait for their turn, stuck and failed jobs go back to the queue by themselves.

Event time: a job's moves wait in list state until the watermark passes them, and then count in the order of time and
number, so that the order of arrival does not matter. Processing time: they wait for `hold` and count from when they are due. A timer
for each stuck state fires without any event. Ended jobs are forgotten after `keep`: by a timer in event
time, by the state's time to live in processing time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..operators.jobs import ATTEMPTS, DISPATCH_MINUTES, MOVES, PROCESS_MINUTES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000
_OUT = "record_key string, status string, attempt int, worker string, changed_at timestamp, cause string, change long"
_JOB = "status string, attempt int, worker string, since long, changes long"
_MOVE = "due long, time long, number long, move string, worker string"
STEPS = {(move, source): to for move, source, to in MOVES}


@dataclass(frozen=True)
class Limits:
    """Minutes after which a state is left by itself, attempts, and how long ended jobs and waiting moves are kept."""

    dispatch_minutes: float = DISPATCH_MINUTES
    process_minutes: float = PROCESS_MINUTES
    attempts: int = ATTEMPTS
    keep_minutes: float = 30 * 24 * 60
    hold_minutes: float = 0

    def due(self, status: str, attempt: int, since: int) -> int | None:
        """When the state is left without an event, in microseconds."""
        if status == "dispatching":
            return since + int(self.dispatch_minutes * MINUTE)
        if status == "processing":
            return since + int(self.process_minutes * MINUTE)
        return since if status == "failed" and attempt < self.attempts else None


def advanced(job: tuple, moves: list[tuple], upto: int, limits: Limits) -> tuple[tuple, list[tuple]]:
    """The job (status, attempt, worker, since, changes) after its moves (at, move, worker) and timeouts before `upto`, and each change with its number."""
    status, attempt, worker, since, n = job
    changes = []
    for at, move, by in [*moves, (upto, None, "")]:
        due = limits.due(status, attempt, since)
        if due is not None and at > due:
            status, since, n = "queued", due, n + 1
            changes.append((status, attempt, worker, since, "timeout", n))
        to = STEPS.get((move, status))
        if to is None or (move in ("complete", "fail") and by != worker):
            continue
        status, since, n = to, at, n + 1
        if move == "claim":
            attempt, worker = attempt + 1, by
        changes.append((status, attempt, worker, since, move, n))
    return (status, attempt, worker, since, n), changes


class JobProcessor(StatefulProcessor):
    """The state of one job: value state for the job, list state for moves whose time has not come."""

    def __init__(self, limits: Limits, event_time: bool):
        self.limits, self.event_time = limits, event_time

    def init(self, handle) -> None:
        ttl = None if self.event_time else int(self.limits.keep_minutes * MINUTE / 1000)
        self.handle = handle
        self.job = handle.getValueState("job", _JOB, ttl)
        self.waiting = handle.getListState("waiting", _MOVE, ttl)

    def _now(self, times) -> int:
        return 1000 * (times.getCurrentWatermarkInMs() if self.event_time else times.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held = self._now(timerValues), list(self.waiting.get())
        waited = len(held)
        for batch in rows:
            times = batch["event_time"].astype("datetime64[us]").astype("int64").tolist()
            for time, number, move, worker in zip(times, batch["event_id"].tolist(), batch["move"].tolist(), batch["worker"].fillna("").tolist(), strict=True):
                due = time if self.event_time else now + int(self.limits.hold_minutes * MINUTE)
                held.append((due, time, int(number), move or "", worker))
        yield from self._advance(key, held, now, waited)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        yield from self._advance(key, held, self._now(timerValues))

    def _advance(self, key, held: list[tuple], now: int, waited: int | None = None) -> Iterator[pd.DataFrame]:
        """waited: how many of the moves were in the state before (all, if not given). Each call of a state is a round trip, so none is made that changes nothing."""
        waited = len(held) if waited is None else waited
        before = self.job.get()
        known = before is not None
        job = before = tuple(before) if known else ("queued", 0, "", 0, 0)
        held = [tuple(x) for x in held]
        ready = sorted((x for x in held if x[0] <= now), key=lambda x: (x[1], x[2]))
        later = [x for x in held if x[0] > now]
        job, changes = advanced(job, [(x[1] if self.event_time else x[0], x[3], x[4]) for x in ready], now, self.limits)
        if known or waited:  # else no timer has been set
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if known and not later and self.event_time and job[0] in ("completed", "failed", "queued") and not changes and now > job[3] + self.limits.keep_minutes * MINUTE:
            self.job.clear()
            self.waiting.clear()
            return
        if job != before or ready and not known:
            self.job.update(job)
        if later:
            self.waiting.put(later)
        elif waited:
            self.waiting.clear()
        due = self.limits.due(job[0], job[1], job[3])
        ends = due if due is not None else job[3] + int(self.limits.keep_minutes * MINUTE) if self.event_time and (known or ready) else None
        for at in {x for x in (ends, min((x[0] for x in later), default=None)) if x is not None}:
            self.handle.registerTimer(max(at // 1000 + 1, now // 1000 + 1))
        if changes:
            yield pd.DataFrame({
                "record_key": [key[0]] * len(changes), "status": [c[0] for c in changes], "attempt": [c[1] for c in changes], "worker": [c[2] or None for c in changes],
                "changed_at": pd.to_datetime([c[3] for c in changes], unit="us"), "cause": [c[4] for c in changes], "change": [c[5] for c in changes],
            })

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def job_changes(moves: DataFrame, limits: Limits = Limits(), event_time: bool = True) -> DataFrame:
    """Each change of a job's state: record_key, status, attempt, worker, changed_at, cause (a move, or timeout) and the change's number.

    moves: a stream of record_key, event_time (with a watermark in event time), event_id, move, worker. To be started within
    keyed_state().
    """
    return moves.groupBy("record_key").transformWithStateInPandas(statefulProcessor=JobProcessor(limits, event_time), outputStructType=_OUT, outputMode="Update", timeMode="EventTime" if event_time else "ProcessingTime")
