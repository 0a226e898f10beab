"""Jobs: validation of a batch, dispatch, the state machine as a fold, progress and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import fresh

#: From which state a transition leads to which.
MOVES = (("dispatch", "queued", "dispatching"), ("claim", "dispatching", "processing"), ("complete", "processing", "completed"), ("fail", "processing", "failed"), ("release", "dispatching", "queued"), ("requeue", "failed", "queued"))
TERMINAL = ("completed", "failed")
#: Minutes after which a job is stuck, and attempts that a failed one has.
DISPATCH_MINUTES, PROCESS_MINUTES, ATTEMPTS = 10, 30, 3


def validated(batch: DataFrame, key: str = "record_key", within: tuple[str, ...] = ()) -> DataFrame:
    """Trims keys and adds error: blank keys and keys that are repeated (within a request, if its columns are named) are refused, not dropped."""
    out = batch.withColumn(key, F.trim(key))
    n = F.count(F.lit(1)).over(Window.partitionBy(*within, key))
    return out.withColumn("error", F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "blank_key").when(n > 1, "duplicate_key"))


def classified(requested: DataFrame, jobs: DataFrame, key: str = "record_key") -> DataFrame:
    """Adds outcome to requested keys: accepted, not_found, or status_<s> for jobs that are not dispatching."""
    known = jobs.select(F.col(key).alias("_key"), F.col("status").alias("_status"))
    out = requested.join(known, F.col(key) == F.col("_key"), "left")
    outcome = F.when(F.col("_status").isNull(), "not_found").when(F.col("_status") == "dispatching", "accepted").otherwise(F.concat(F.lit("status_"), F.col("_status")))
    return out.withColumn("outcome", outcome).drop("_key", "_status")


def batch_outcome(classified_jobs: DataFrame, keys: list[str]) -> DataFrame:
    """accepted, rejected and the verdict on each batch."""
    yes = F.count_if(F.col("outcome") == "accepted")
    out = classified_jobs.groupBy(*keys).agg(yes.alias("accepted"), (F.count(F.lit(1)) - yes).alias("rejected"))
    return out.withColumn("verdict", F.when(F.col("rejected") == 0, "accepted").when(F.col("accepted") == 0, "rejected").otherwise("partially_accepted"))


def never(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right, on, "left_anti")


def folded(transitions: DataFrame, key: str = "record_key", order: tuple[str, ...] = ("event_time", "event_id")) -> DataFrame:
    """status, attempt and worker of each job after its transitions in order; illegal ones are ignored.

    transitions: key, order columns, move and worker. A claim raises the attempt; completion
    and failure count only from the worker that holds the job. A job's transitions are few.
    """
    ordered = transitions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "move", "worker"))).alias("_moves"))
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("worker"))

    def step(acc: Column, x: Column) -> Column:
        target = None
        for move, source, to in MOVES:
            legal = (x["move"] == move) & (acc["status"] == source)
            if move in ("complete", "fail"):
                legal &= acc["worker"].eqNullSafe(x["worker"])
            target = F.when(legal, to) if target is None else target.when(legal, to)
        ok = target.isNotNull()
        claim = ok & (x["move"] == "claim")
        return F.struct(
            F.coalesce(target, acc["status"]).alias("status"), (acc["attempt"] + claim.cast("int")).alias("attempt"), F.when(claim, x["worker"]).otherwise(acc["worker"]).alias("worker")
        )

    return ordered.select(key, F.aggregate("_moves", start, step).alias("_s")).select(key, "_s.*")


def lifecycle(transitions: DataFrame, until: Column, key: str = "record_key", order: tuple[str, ...] = ("event_time", "event_id"), attempts: int = ATTEMPTS, dispatch_minutes: int = DISPATCH_MINUTES, process_minutes: int = PROCESS_MINUTES) -> DataFrame:
    """status, attempt, worker and since of each job at a time, as folded(), with what happens without an event in between.

    A job that is longer than the minutes in a state goes back to the queue when they are over, and a failed one with attempts
    left at once, before its next transition is looked at.
    """
    ordered = transitions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "move", "worker"))).alias("_moves"))
    at = order[0]
    last = F.array(F.struct(until.cast("timestamp").alias(at), F.lit(None).cast("string").alias("move"), F.lit(None).cast("string").alias("worker")))
    moves = F.concat(F.transform("_moves", lambda x: F.struct(x[at].cast("timestamp").alias(at), x["move"].alias("move"), x["worker"].alias("worker"))), last)
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp").alias("since"))

    def step(acc: Column, x: Column) -> Column:
        stuck = lambda status, n: F.when(acc["status"] == status, acc["since"] + F.expr(f"interval {int(n)} minutes"))
        due = F.coalesce(stuck("dispatching", dispatch_minutes), stuck("processing", process_minutes), F.when((acc["status"] == "failed") & (acc["attempt"] < attempts), acc["since"]))
        over = F.coalesce(x[at] > due, F.lit(False))
        status, target = F.when(over, "queued").otherwise(acc["status"]), None
        for move, source, to in MOVES:
            legal = (x["move"] == move) & (status == source)
            if move in ("complete", "fail"):
                legal &= acc["worker"].eqNullSafe(x["worker"])
            target = F.when(legal, to) if target is None else target.when(legal, to)
        claim = target.isNotNull() & (x["move"] == "claim")
        return F.struct(
            F.coalesce(target, status).alias("status"), (acc["attempt"] + claim.cast("int")).alias("attempt"), F.when(claim, x["worker"]).otherwise(acc["worker"]).alias("worker"),
            F.when(target.isNotNull(), x[at]).when(over, due).otherwise(acc["since"]).alias("since"),
        )

    return ordered.select(key, F.aggregate(moves, start, step).alias("_s")).select(key, "_s.*")


def progress(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """completed, failed, total and whether all of a batch's jobs have ended."""
    ended = F.col("status").isin(*TERMINAL)
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(ended).alias("terminal")
    )


def claimable(jobs: DataFrame, slots: int, order: list[Column], partition: tuple[str, ...] = (), active: Column | None = None) -> DataFrame:
    """Queued jobs that fit into the free slots, oldest first, per partition or overall.

    Each task first keeps its own `slots` jobs of a partition, so no task gets the whole queue; active jobs are counted apart.
    """
    rn, busy, *of = fresh(jobs, "_rn", "_busy", *[f"_of{i}" for i in range(len(partition))])
    first = jobs.where(F.col("status") == "queued").withColumn(rn, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rn) <= slots)
    if active is None:
        return first.drop(rn)
    counted = jobs.where(active).groupBy(*[F.col(c).alias(o) for c, o in zip(partition, of, strict=True)]).agg(F.count(F.lit(1)).alias(busy))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(partition, of, strict=True)]
    met = first.join(counted, same, "left") if partition else first.crossJoin(F.broadcast(counted))  # one row of counts
    return met.where(F.col(rn) <= F.lit(slots) - F.coalesce(busy, F.lit(0))).drop(rn, busy, *of)


def requeued(jobs: DataFrame, ref: Column, attempts: int = ATTEMPTS, dispatch_minutes: int = DISPATCH_MINUTES, process_minutes: int = PROCESS_MINUTES) -> DataFrame:
    """Adds next_status: jobs stuck in a state or failed with attempts left go back to the queue."""
    late = lambda n: F.col("updated_at") < ref - F.expr(f"interval {int(n)} minutes")
    back = ((F.col("status") == "dispatching") & late(dispatch_minutes)) | ((F.col("status") == "processing") & late(process_minutes)) | ((F.col("status") == "failed") & F.col("input_valid") & (F.col("attempt") < attempts))
    return jobs.withColumn("next_status", F.when(back, "queued").otherwise(F.col("status")))


def models_for_attempt(models: Column, attempt: Column) -> Column:
    """The model list rotated by the attempt, without repeats."""
    shift = F.pmod(attempt - 1, F.size(models))
    return F.array_distinct(F.concat(F.slice(models, shift + 1, F.size(models)), F.slice(models, F.lit(1), shift)))
