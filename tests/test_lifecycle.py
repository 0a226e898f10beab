"""Job states with timers: the stream against the batch, timers without events, state that ends."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.operators import jobs
from lotwise.streaming import lifecycle
from lotwise.streaming.events import drained

MOVES = "record_key string, event_time timestamp, event_id long, move string, worker string"
START = datetime(2024, 1, 1)


def some_moves(seed, n=260):
    r = random.Random(seed)
    names = ["dispatch", "claim", "complete", "fail", "release", "requeue", "nonsense", None]
    at = sorted(r.uniform(0, 150) for _ in range(n))
    return [(f"k{r.randint(0, 11)}", START + timedelta(minutes=at[i]), i, r.choice(["dispatch", "claim", "complete"] * 4 + names), r.choice(["w", "w", "v", None])) for i in range(n)]


def latest(changes):
    """The last change of each job."""
    out = {}
    for x in sorted(changes.collect(), key=lambda x: x.change):
        out[x.record_key] = (x.status, x.attempt, x.worker)
    return out


def test_stream_equals_batch_on_shuffled_input(spark, tmp_path):
    """Rows come in any order within the watermark's delay, in several batches, and a last row lets the time pass."""
    rows, r = some_moves(3), random.Random(1)
    schema = spark.createDataFrame([], MOVES).schema
    for part in range(3):
        own = rows[part * 90 : part * 90 + 90]
        r.shuffle(own)
        spark.createDataFrame(own, MOVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    until = START + timedelta(minutes=1500)
    spark.createDataFrame([("clock", until + timedelta(minutes=401), 9999, "none", None)], MOVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("event_time", "400 minutes")
    with lifecycle.keyed_state(spark):
        got = latest(drained(lifecycle.job_changes(stream), "changes", "update"))
    batch = jobs.lifecycle(spark.createDataFrame(rows, MOVES), F.lit(until))
    want = {x.record_key: (x.status, x.attempt, x.worker) for x in batch.collect() if x.since is not None}
    assert got == want and {"queued", "completed"} <= {s for s, _, _ in want.values()} and max(a for _, a, _ in want.values()) > 1


def test_batch_lifecycle(spark):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("a", at(0), 1, "dispatch", "w"), ("a", at(11), 2, "claim", "w"), ("b", at(0), 3, "dispatch", "w"), ("b", at(10), 4, "claim", "w"), ("b", at(41), 5, "complete", "w"), ("c", at(0), 6, "dispatch", "w"), ("c", at(1), 7, "claim", "w"), ("c", at(2), 8, "fail", "w"), ("d", at(0), 9, "dispatch", "w"), ("d", at(1), 10, "claim", "w"), ("d", at(31), 11, "complete", "w")]
    got = {x.record_key: (x.status, x.attempt) for x in jobs.lifecycle(spark.createDataFrame(rows, MOVES), F.lit(at(100))).collect()}
    assert got == {"a": ("queued", 0), "b": ("queued", 1), "c": ("queued", 1), "d": ("completed", 1)}


@pytest.mark.parametrize("seed", range(4))
def test_plain_fold_equals_batch(spark, seed):
    """What the stream's processor computes, without Spark, against the column fold."""
    rows, until = some_moves(seed + 10), START + timedelta(minutes=2000)
    micro = lambda t: round((t - START).total_seconds() * 1_000_000)
    by = {}
    for k, t, i, m, w in rows:
        by.setdefault(k, []).append((micro(t), m, w or ""))
    got = {k: lifecycle.advanced(("queued", 0, "", 0, 0), sorted(moves), micro(until), lifecycle.Limits())[0][:3] for k, moves in by.items()}
    want = {x.record_key: (x.status, x.attempt, x.worker or "") for x in jobs.lifecycle(spark.createDataFrame(rows, MOVES), F.lit(until)).collect()}
    assert got == want


def test_timers_fire_without_events(spark, tmp_path):
    """In processing time a dispatched job goes back to the queue although nothing more arrives."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", START, 1, "dispatch", None), ("b", START, 3, "claim", "w"), ("b", START, 2, "dispatch", None)], MOVES).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame([], MOVES).schema).parquet(source)
    limits = lifecycle.Limits(dispatch_minutes=2 / 60, process_minutes=60)
    write = lambda rows, batch: rows.write.mode("append").parquet(out)
    with lifecycle.keyed_state(spark):
        query = lifecycle.job_changes(stream, limits, event_time=False).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        try:
            end = time.time() + 90
            while time.time() < end:
                time.sleep(2)
                found = {(x.record_key, x.status, x.cause) for x in spark.read.schema(lifecycle._OUT).parquet(out).collect()} if (tmp_path / "out").exists() else set()
                if ("a", "queued", "timeout") in found:
                    break
        finally:
            query.stop()
    assert found == {("a", "dispatching", "dispatch"), ("a", "queued", "timeout"), ("b", "dispatching", "dispatch"), ("b", "processing", "claim")}


def test_ended_jobs_are_forgotten():
    """After `keep` the processor clears a job's state; one that waits for a timeout stays."""

    class State:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = put = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getValueState(self, name, *_):  # noqa: N802
            return self.states.setdefault(name, State())

        getListState = getValueState  # noqa: N815
        listTimers = lambda self: list(self.timers)  # noqa: E731, N815
        deleteTimer = lambda self, t: self.timers.remove(t)  # noqa: E731, N815
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815

    p, h = lifecycle.JobProcessor(lifecycle.Limits(keep_minutes=60), True), Handle()
    p.init(h)
    moves = [(1, 1, 1, "dispatch", "w"), (2, 2, 2, "claim", "w"), (3, 3, 3, "complete", "w")]
    assert len(pd_rows(p._advance(("k",), moves, 10))) == 3 and h.states["job"].value[0] == "completed" and h.timers == [3600001]
    assert pd_rows(p._advance(("k",), [], 3_600_001_000)) == [] and h.states["job"].value is None and h.timers == []


def pd_rows(frames):
    return [row for f in frames for row in f.itertuples()]


def test_a_new_job_takes_few_round_trips():
    """Moves of a job that has no state yet: both states are read, the moves put, a timer set, and nothing else is asked."""
    import pandas as pd

    asked = []

    class Recorder:
        def __init__(self, of, value=None):
            self.of, self.value = of, value

        def __getattr__(self, name):
            return lambda *args: asked.append(f"{self.of}.{name}") or self.value

    p, handle = lifecycle.JobProcessor(lifecycle.Limits(), True), Recorder("handle")
    handle.getValueState, handle.getListState = lambda *_: Recorder("job"), lambda *_: Recorder("waiting", [])
    p.init(handle)
    rows = pd.DataFrame({"event_time": [pd.Timestamp(START)], "event_id": [1], "move": ["dispatch"], "worker": ["w"]})
    assert list(p.handleInputRows(("k",), iter([rows]), Recorder("times", 0))) == []
    assert sorted(x for x in asked if not x.startswith("times")) == ["handle.registerTimer", "job.get", "waiting.get", "waiting.put"]
