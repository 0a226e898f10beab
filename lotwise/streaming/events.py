"""Structured Streaming over event files: hourly counts, counters, job states."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.audit import metric_increments
from ..operators.jobs import MOVES
from ..shared import shared_dir


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts", delay: str = "10 minutes", files: int = 100, glob: str = "*") -> DataFrame:
    """Parquet events as a stream with a watermark; times without a zone count as the session's."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def hourly_counts(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Rows by tumbling hour and key."""
    out = events.groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("hour"), key, "n")


def sessions(events: DataFrame, key: str, gap: str, time: str = "ts") -> DataFrame:
    """Rows by key and session: a gap without a beat ends it."""
    out = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("beats"))
    return out.select(F.col("w.start").alias("first"), F.col("w.end").alias("last"), key, "beats")


def counters(events: DataFrame) -> DataFrame:
    """Counter values as events arrive (complete or update mode)."""
    return metric_increments(events).groupBy("metric", "model", "status").agg(F.sum("increment").alias("value"))


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def stage_intervals(events: DataFrame, keys: list[str], longest: str = "2 hours", delay: str = "1 hour", time: str = "ts", kind: str = "kind") -> DataFrame:
    """Stages with their start and end as both sides arrive: keys, started, finished, seconds; an end more than `longest` after its start is none.

    Two watermarked sides and a time range between them bound what is kept; a stage without an end is given once the
    watermark has passed the range. Rows later than the delay are dropped, as in any stream with a watermark.
    """
    side = lambda value, name: events.where(F.col(kind) == value).select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col(time).alias(name)).withWatermark(name, delay)
    started, finished = side("stage_started", "started"), side("stage_finished", "finished")
    same = [F.col(f"started_{k}") == F.col(f"finished_{k}") for k in keys]
    met = started.join(finished, [*same, F.col("finished") >= F.col("started"), F.col("finished") <= F.col("started") + F.expr(f"interval {longest}")], "leftOuter")
    return met.select(*[F.col(f"started_{k}").alias(k) for k in keys], "started", "finished", (F.unix_micros("finished") - F.unix_micros("started")).alias("micros")).withColumn("seconds", F.col("micros") / 1e6).drop("micros")


def job_states(transitions: DataFrame) -> DataFrame:
    """record_key, status, attempt after each batch of transitions (record_key, event_id, move, worker, and event_time if there is one); illegal moves are ignored.

    A batch's moves count in the order of time and number, as in jobs.folded().
    """
    order = [c for c in ("event_time", "event_id") if c in transitions.columns]
    steps = {(m, s): t for m, s, t in MOVES}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempt, worker = state.get if state.exists else ("queued", 0, "")
        rows = pd.concat(list(batches)).sort_values(order)
        for move, by in zip(rows["move"].tolist(), rows["worker"].fillna("").tolist(), strict=True):
            to = steps.get((move, status))
            if to is None or (move in ("complete", "fail") and by != worker):
                continue
            status = to
            if move == "claim":
                attempt, worker = attempt + 1, by
        state.update((status, attempt, worker))
        yield pd.DataFrame({"record_key": [key[0]], "status": [status], "attempt": [attempt]})

    return transitions.groupBy("record_key").applyInPandasWithState(fold, "record_key string, status string, attempt int", "status string, attempt int, worker string", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream gives once all available input is read, from Parquet in the shared folder: the last whole result, or all updates."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return rows.drop("batch")
